"""Snapshots in hashed buckets under a tree of digests: bucket, table, root.

Tables lie in buckets by a hash of their id. A bucket's digest is its row count and an order-free
sum of row hashes, a table's digest is over its buckets' and the root's over the tables'. Backup,
verification and restore compare digests and touch only the buckets that differ. A manifest that
appears by a rename names the folder of each bucket, so a backup that ends early changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (AtomicType, DataType, DoubleType, FloatType, StructType,
                               VariantType)

from tillspark.sources.manifest import Manifests

BUCKETS = 64
MOST_TASKS = 256  # that write to all buckets, a file to each
# How a manifest's rows were hashed; older manifests do not say so and have JSON texts.
JSON, VALUES = "json", "values"
Digests = dict[str, list]


def _over(parts: dict) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _hashed(value: Column, kind: DataType) -> list[Column]:
    """What stands for a value in a row's hash; nulls are marked, as a hash passes over them."""
    if isinstance(kind, StructType):
        return [value.isNull(), *[part for field in kind for part in _hashed(
            value.getField(field.name), field.dataType)]]
    if not isinstance(kind, AtomicType) or isinstance(kind, VariantType):
        return [F.to_json(F.struct(value.alias("value")), {"ignoreNullFields": "false"})]
    if isinstance(kind, (DoubleType, FloatType)):
        value = value.cast("string")  # a hash takes -0.0 and 0.0 as equal
    return [value.isNull(), value]


def _row_hash(df: DataFrame, way: str) -> Column:
    """Hash of a row and its column names, from the values themselves or from their JSON."""
    names = sorted(df.columns)
    parts = [F.to_json(F.struct(*names), {"ignoreNullFields": "false"})] if way == JSON else [
        part for name in names for part in _hashed(F.col(name), df.schema[name].dataType)]
    return F.xxhash64(F.lit("\n".join(names)), *parts)


def tree(digests: dict[str, Digests]) -> dict:
    """Table digests and the root over the bucket digests."""
    tables = {name: _over(found) for name, found in digests.items()}
    return {"tables": tables, "root": _over(tables)}


class Snapshots(Manifests):
    """Tables with a column ``id``; at most ``buckets`` digests of each come to the driver."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        super().__init__(spark, root)
        self.buckets = buckets

    def manifest(self) -> dict:
        return self.newest() or {"version": 0, "schemas": {}, "folders": {}, "digests": {},
                                 "hashes": {}}

    def _bucket(self) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(self.buckets)),
                          F.lit(0)).cast("int")

    def digests(self, df: DataFrame, stored: bool = False, way: str = VALUES) -> Digests:
        """Bucket to [rows, digest]; the column names are part of each row's hash.

        Stored rows count for the folder that they lie in, their ``_bucket``, so one in the wrong
        folder is found there.
        """
        bucket = F.col("_bucket") if stored else self._bucket()
        row = _row_hash(df.drop("_bucket") if stored else df, way)
        found = df.select(bucket.alias("bucket"), row.alias("row")).groupBy(
            "bucket").agg(
            F.count("*").alias("rows"),
            F.sum(F.col("row").cast("decimal(20,0)")).cast("string").alias("digest")).collect()
        return {str(r["bucket"]): [r["rows"], r["digest"]] for r in found}

    def _dealt(self, rows: DataFrame, buckets: Iterable[str]) -> DataFrame:
        """Rows of some buckets. Where these are few, each bucket's are brought together; where
        they are most of the table each task writes its own files, and nothing is shuffled."""
        wanted = [int(b) for b in buckets]
        found = rows.withColumn("_bucket", self._bucket()).where(F.col("_bucket").isin(wanted))
        if 2 * len(wanted) < self.buckets:
            return found.hint("rebalance", "_bucket")
        return found.coalesce(MOST_TASKS)

    def _folder(self, folder: str, schema: str, buckets: Iterable[str]) -> DataFrame:
        """Rows of some buckets of one written folder; the others are pruned by their names."""
        return self.spark.read.schema(f"{schema}, `_bucket` int").parquet(
            f"{self.root}/{folder}").where(F.col("_bucket").isin([int(b) for b in buckets]))

    def _in_folders(self, table: str, buckets: Iterable[str]) -> DataFrame:
        """Rows of some buckets with their ``_bucket``, read from the manifest's folders."""
        now, written = self.manifest(), {}
        for bucket in buckets:
            folder = now["folders"][table][bucket].rpartition("/")[0]
            written.setdefault(folder, []).append(bucket)
        return reduce(DataFrame.union, [self._folder(folder, now["schemas"][table], found)
                                        for folder, found in written.items()])

    def _put(self, table: str, rows: DataFrame, expected: Digests, way: str) -> dict[str, str]:
        """Writes rows with their ``_bucket`` and reads them back; bucket to its folder."""
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}", compression="zstd")
        written = self._folder(folder, _ddl(rows.drop("_bucket")), expected)
        if self.digests(written, True, way) != expected:
            raise OSError(f"{table} differs from what was written")
        return {b: f"{folder}/_bucket={b}" for b in expected}

    def _replace(self, after: dict, table: str, rows: Callable[[Iterable[str]], DataFrame],
                 schema: str, found: Digests, wanted: Digests, way: str = VALUES) -> int:
        """Puts the buckets of ``wanted`` that differ from ``found`` into a manifest; their number.

        ``rows`` gives the rows of buckets with their ``_bucket``.
        """
        differ = {b: d for b, d in wanted.items() if found.get(b) != d}
        kept = {b: p for b, p in after["folders"].get(table, {}).items() if b in wanted}
        put = self._put(table, rows(differ), differ, way) if differ else {}
        after["folders"][table] = kept | put
        after["digests"][table], after["schemas"][table] = wanted, schema
        after.setdefault("hashes", {})[table] = way
        return len(differ)

    def _switch(self, before: dict, after: dict) -> None:
        after["tree"] = tree(after["digests"])
        if after != before:
            after["version"] += 1
            self.publish(after)

    def read(self, table: str) -> DataFrame:
        now = self.manifest()
        paths = [f"{self.root}/{p}" for p in now["folders"][table].values()]
        schema = now["schemas"][table]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _way(self, table: str) -> str:
        return self.manifest().get("hashes", {}).get(table, JSON)

    def _stored(self, table: str, way: str) -> Digests:
        folders = self.manifest()["folders"][table]
        return self.digests(self._in_folders(table, folders), True, way) if folders else {}

    def backup(self, tables: dict[str, DataFrame]) -> DataFrame:
        """Writes the buckets that differ from the newest manifest, reads them back, and then
        switches. Returns table, buckets, rewritten."""
        before = self.manifest()
        after, report = json.loads(json.dumps(before)), []
        for name, df in tables.items():
            wanted = self.digests(df)
            same = before["schemas"].get(name) == _ddl(df) and self._way(name) == VALUES
            found = before["digests"][name] if same else {}
            report.append((name, len(wanted), self._replace(
                after, name, partial(self._dealt, df), _ddl(df), found, wanted)))
        self._switch(before, after)
        return self.spark.createDataFrame(report, "`table` string, buckets int, rewritten int")

    def damaged(self, table: str) -> list[str]:
        """Buckets whose stored rows do not give the digest of the manifest."""
        found = self._stored(table, self._way(table))
        kept = self.manifest()["digests"][table]
        return sorted(b for b in found.keys() | kept.keys() if found.get(b) != kept.get(b))

    def _verified(self) -> list[tuple[str, int, bool]]:
        now = self.manifest()
        whole = now.get("tree") == tree(now["digests"])
        return [(name, sum(n for n, _ in kept.values()), whole and not self.damaged(name))
                for name, kept in now["digests"].items()]

    def verify(self) -> DataFrame:
        """Table, rows and ``matches``: each bucket read back, and the tree over the digests."""
        return self.spark.createDataFrame(
            self._verified(), "`table` string, rows long, matches boolean")

    def restore(self, live: Snapshots) -> DataFrame:
        """Makes the tables of ``live`` equal to this snapshot's; returns table and copied buckets.

        This snapshot is verified first. The rows of ``live`` are read, its manifest is not
        trusted; only buckets that differ are copied, from folder to folder without a shuffle,
        and read back before it is switched.
        """
        if live.buckets != self.buckets:
            raise ValueError("Both sides need the same number of buckets")
        if not all(matches for _, _, matches in self._verified()):
            raise ValueError(f"Snapshot {self.root} failed its integrity check")
        now, before = self.manifest(), live.manifest()
        after, report = json.loads(json.dumps(before)), []
        for name, wanted in now["digests"].items():
            same = before["schemas"].get(name) == now["schemas"][name]
            found = live._stored(name, self._way(name)) if same else {}
            report.append((name, live._replace(
                after, name, partial(self._in_folders, name), now["schemas"][name], found, wanted,
                self._way(name))))
        live._switch(before, after)
        return self.spark.createDataFrame(report, "`table` string, copied int")

    def vacuum(self) -> None:
        """Deletes folders that the newest manifest does not name, and older manifests."""
        now = self.manifest()
        for table, folders in now["folders"].items():
            for written in self.listed(table):
                for bucket in self.listed(f"{table}/{written}"):
                    if bucket.startswith("_bucket=") \
                            and f"{table}/{written}/{bucket}" not in folders.values():
                        self.delete(f"{table}/{written}/{bucket}")
        self.forget_older(now)
