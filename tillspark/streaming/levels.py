"""Followed state in levels of runs, for whole reads and for reads of single documents.

A micro-batch becomes one run on the first level: its newest version of each document, in folders
by a hash of the document. When a level has ``fanout`` runs they are merged into one run of the
next, so after N batches there are at most ``fanout`` runs on each of about log(N) levels, and a
row is rewritten once a level. A manifest names the runs. It is replaced by a rename after a run
is written, so an end between the two loses nothing: the old manifest still names the old runs,
and the batch or merge is written again under the same name.

Each run has a Bloom filter for each of its buckets, kept as rows (bucket, word, bits). A read of
given documents asks the filters first and scans only the folders that may hold one of them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillspark.model import REPLICATED_COLLECTIONS
from tillspark.operators.replication import DOCUMENT_KEYS
from tillspark.operators.sieve import matched
from tillspark.session import cut_lineage
from tillspark.sources.manifest import Manifests
from tillspark.streaming.sources import run_available

BUCKETS, FANOUT = 16, 4
PROBES, BITS_A_ROW = 5, 10
ASKED_FIRST = 10_000


def _merged(rows: DataFrame) -> DataFrame:
    """Newest version of each document, with the creation time of its first one.

    ``_first`` is the sequence that creation time belongs to: batches may bring versions late,
    and the newest row of a run does not tell how old its oldest one was.
    """
    if "_first" not in rows.columns:
        rows = rows.withColumn("_first", F.col("server_sequence"))
    kept = [c for c in rows.columns if c not in (*DOCUMENT_KEYS, "created_at", "_first")]
    first = [F.min_by("created_at", "_first").alias("created_at")] \
        if "created_at" in rows.columns else []
    return rows.groupBy(*DOCUMENT_KEYS).agg(
        F.max_by(F.struct(*kept), "server_sequence").alias("_row"), *first,
        F.min("_first").alias("_first"),
    ).select(*DOCUMENT_KEYS, "_row.*", *(["created_at"] if first else []), "_first")


def _probe(number: Column | int, bits: Column | int) -> Column:
    number, bits = (c if isinstance(c, Column) else F.lit(c) for c in (number, bits))
    return F.pmod(F.xxhash64(*DOCUMENT_KEYS, number), bits.cast("long"))


class Levels(Manifests):
    """``schema``: the columns of a version, as DDL; keys, server_sequence and any others."""

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = BUCKETS,
                 fanout: int = FANOUT):
        super().__init__(spark, root)
        self.schema, self.buckets, self.fanout = f"{schema}, _first long", buckets, fanout

    def manifest(self) -> dict:
        """Version, last batch, run names by level, and bits of a filter by run."""
        return self.newest() or {"version": 0, "batch": -1, "levels": [], "bits": {}}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*DOCUMENT_KEYS), F.lit(self.buckets)).cast("int")

    def _folders(self, run: str) -> dict[int, str]:
        names = [n for n in self.listed(f"runs/{run}") if n.startswith("bucket=")]
        return {int(n.split("=")[1]): f"{self.root}/runs/{run}/{n}" for n in names}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _read_runs(self, runs: list[str]) -> DataFrame:
        return self._read([f for run in runs for f in self._folders(run).values()])

    def _write(self, run: str, rows: DataFrame) -> int:
        """Writes a run and its filters; the bits of one filter.

        The rows come dealt out by document, and are not dealt out by bucket once more.
        """
        names = self._read([]).columns
        (rows.select(*names).withColumn("bucket", self._bucket())
         .write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.root}/runs/{run}", compression="zstd"))
        written = self._read_runs([run]).select(*DOCUMENT_KEYS)
        bits = 64
        while bits < BITS_A_ROW * written.count() / self.buckets:
            bits *= 2
        spots = F.array(*[_probe(i, bits) for i in range(PROBES)])
        spots = written.select(self._bucket().alias("bucket"), F.explode(spots).alias("spot"))
        (spots.groupBy("bucket", F.floor(F.col("spot") / 64).cast("long").alias("word"))
         .agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 AS int)))").alias("mask"))
         .repartitionByRange("bucket", "word").sortWithinPartitions("bucket", "word")
         .write.mode("overwrite").parquet(f"{self.root}/filters/run={run}"))
        return bits

    def append(self, rows: DataFrame, batch: int) -> None:
        """Adds the versions of one batch; a batch that is there already changes nothing."""
        now = self.manifest()
        if now["batch"] < batch:
            run = f"batch-{batch}"
            bits = self._write(run, _merged(rows))
            self._switch(now, batch, 0, [], run, bits)
        self.compact()

    def compact(self) -> None:
        """Merges every level that is full."""
        level = 0
        while level < len(self.manifest()["levels"]):
            now = self.manifest()
            runs = now["levels"][level]
            if len(runs) >= self.fanout:
                run = f"merge-{now['version'] + 1}-{level}"
                bits = self._write(run, _merged(self._read_runs(runs)))
                self._switch(now, now["batch"], level + 1, runs, run, bits)
            level += 1

    def _switch(self, now: dict, batch: int, level: int, gone: list[str], run: str,
                bits: int) -> None:
        after = json.loads(json.dumps(now))
        after["levels"] = [[r for r in runs if r not in gone] for runs in after["levels"]]
        after["levels"] += [[] for _ in range(level + 1 - len(after["levels"]))]
        after["levels"][level].append(run)
        after["bits"] = {r: b for r, b in after["bits"].items() if r not in gone} | {run: bits}
        after["version"], after["batch"] = now["version"] + 1, batch
        self.publish(after)

    def state(self) -> DataFrame:
        """Newest version of each document."""
        return _merged(self._read_runs(list(self.manifest()["bits"]))).drop("_first")

    def candidates(self, keys: DataFrame) -> list[str]:
        """The folders that may hold one of the documents; at most runs x buckets of them.

        All probes of a document must be set in its bucket's filter. Each run has its own
        number of bits, so a document is asked for once in each run. Of many documents some are
        asked for first; the others then need to be asked for in the remaining folders only.
        """
        now = self.manifest()
        if not now["bits"]:
            return []
        asked = keys.select(*DOCUMENT_KEYS).dropna()
        some = cut_lineage(asked.limit(ASKED_FIRST), "levels-asked")
        found = self._hit(now["bits"], some, {})
        if some.count() == ASKED_FIRST:
            found |= self._hit(now["bits"], asked, found)
        folders = {run: self._folders(run) for run in found}
        return sorted(folders[run][bucket] for run, hit in found.items() for bucket in hit)

    def _hit(self, bits: dict[str, int], asked: DataFrame, known: dict[str, set[int]]
             ) -> dict[str, set[int]]:
        """Run to the buckets whose filter lets a document pass; those of ``known`` stay as they
        are and are not asked.

        The number of a document stands for it: two with one number may let a folder pass that
        holds neither, and never keep one out.
        """
        none = F.array().cast("array<int>")
        runs = F.array(*[F.struct(
            F.lit(r).alias("run"), F.lit(b).cast("long").alias("bits"),
            (F.array(*map(F.lit, sorted(known[r]))) if known.get(r) else none).alias("known"))
            for r, b in bits.items()])
        asked = asked.select("*", self._bucket().alias("bucket"), F.inline(runs)).where(
            ~F.array_contains("known", F.col("bucket"))).drop("known").distinct()
        asked = asked.select(
            "run", "bucket", F.xxhash64(*DOCUMENT_KEYS).alias("number"),
            F.explode(F.array(*[_probe(i, F.col("bits")) for i in range(PROBES)])).alias("spot"))
        asked = asked.withColumn("word", F.floor(F.col("spot") / 64).cast("long"))
        filters = self.spark.read.schema("bucket int, word long, mask long, run string").parquet(
            f"{self.root}/filters").where(F.col("run").isin(*bits))
        hit = F.expr("(mask & shiftleft(1L, cast(spot % 64 AS int))) <> 0")
        found = (asked.join(filters, ["run", "bucket", "word"]).where(hit)
                 .groupBy("run", "bucket", "number").agg(F.count("*").alias("hits"))
                 .where(F.col("hits") >= PROBES).select("run", "bucket").distinct().collect())
        after = {run: set(buckets) for run, buckets in known.items()}
        for r in found:
            after.setdefault(r["run"], set()).add(r["bucket"])
        return after

    def documents(self, keys: DataFrame) -> DataFrame:
        """The newest version of each document of ``keys`` (both key columns); absent ones,
        null keys and repeated keys give no row of their own."""
        held = matched(self._read(self.candidates(keys)), keys, DOCUMENT_KEYS)
        return _merged(held).drop("_first")

    def vacuum(self) -> None:
        """Deletes runs and filters that the newest manifest does not name, and older manifests."""
        now = self.manifest()
        for folder, prefix in (("runs", ""), ("filters", "run=")):
            for name in self.listed(folder):
                if name.startswith(prefix) and name.removeprefix(prefix) not in now["bits"]:
                    self.delete(f"{folder}/{name}")
        self.forget_older(now)


def follow(changes: DataFrame, levels: Levels, checkpoint: str) -> None:
    """Keeps the newest version of each document of the replicated collections in ``levels``."""
    known = changes.where(F.col("collection_name").isin(*REPLICATED_COLLECTIONS))
    run_available(known.writeStream.foreachBatch(levels.append), checkpoint)
