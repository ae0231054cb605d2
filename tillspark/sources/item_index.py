"""Index from receipts to the log's item documents.

Postings (receipt_id, document_id) lie in folders by a hash of the receipt. ``update`` reads the log
past the last indexed sequence and adds one run; when a level has ``fanout`` runs they become one
run of the next, so a posting is rewritten once a level. A document that moved between receipts is
posted for each of them; whoever reads it looks at its newest version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillspark.operators.sieve import matched
from tillspark.sources.manifest import Manifests

SCHEMA = "receipt_id string, document_id string"
BUCKETS, FANOUT = 64, 4
SLICES = 4  # of a bucket, by document, so that no receipt lies in one task


class ItemIndex(Manifests):
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS,
                 fanout: int = FANOUT):
        super().__init__(spark, root)
        self.buckets, self.fanout = buckets, fanout

    def manifest(self) -> dict:
        return self.newest() or {"version": 0, "upto": 0, "levels": []}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("receipt_id"), F.lit(self.buckets)).cast("int")

    def _folders(self, run: str, buckets: set[int] | None = None) -> list[str]:
        names = [n for n in self.listed(run) if n.startswith("bucket=")]
        return [f"{self.root}/{run}/{n}" for n in names
                if buckets is None or int(n.split("=")[1]) in buckets]

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*folders)

    def _write(self, run: str, postings: DataFrame) -> None:
        (self._dealt(postings).write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.root}/{run}", compression="zstd"))

    def _dealt(self, postings: DataFrame) -> DataFrame:
        """Each posting once, with its bucket; dealt out by bucket and slice only."""
        part = F.pmod(F.xxhash64("document_id"), F.lit(SLICES))
        rows = postings.withColumn("bucket", self._bucket()).withColumn("_slice", part)
        return rows.repartition("bucket", "_slice").distinct().drop("_slice")

    def update(self, log: DataFrame) -> None:
        """Indexes the log up to its present end; the end is read before the rows are."""
        now = self.manifest()
        items = log.where((F.col("collection_name") == "receipt_items")
                          & (F.col("server_sequence") > now["upto"]))
        last = items.agg(F.max("server_sequence").alias("last")).first().last
        if last is None:
            return
        receipt = F.get_json_object("document_json", "$.receiptId").alias("receipt_id")
        run = f"run-{now['version'] + 1}"
        self._write(run, items.where(F.col("server_sequence") <= last).select(
            receipt, "document_id").dropna())
        levels = [list(level) for level in now["levels"]] or [[]]
        levels[0].append(run)
        self.publish({"version": now["version"] + 1, "upto": last, "levels": levels})
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len((now := self.manifest())["levels"]):
            levels = [list(runs) for runs in now["levels"]]
            if len(levels[level]) >= self.fanout:
                run = f"run-{now['version'] + 1}"
                folders = [f for old in levels[level] for f in self._folders(old)]
                self._write(run, self._read(folders))
                levels[level] = []
                if level + 1 == len(levels):
                    levels.append([])
                levels[level + 1].append(run)
                self.publish(now | {"version": now["version"] + 1, "levels": levels})
            level += 1

    def folders_of(self, receipts: DataFrame) -> list[str]:
        """The folders that may hold postings of these receipts: their buckets of each run."""
        asked = receipts.select("receipt_id").dropna().select(self._bucket().alias("bucket"))
        hit = {r.bucket for r in asked.distinct().collect()}  # at most ``buckets`` numbers
        return [f for runs in self.manifest()["levels"] for run in runs
                for f in self._folders(run, hit)]

    def items_of(self, receipts: DataFrame) -> DataFrame:
        """The item documents ever posted for the receipts of column ``receipt_id``."""
        posted = matched(self._read(self.folders_of(receipts)), receipts, ["receipt_id"])
        return posted.select("document_id").distinct()
