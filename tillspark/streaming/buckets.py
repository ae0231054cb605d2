"""Tables in hashed buckets that a micro-batch reads and replaces in part.

A table lies in ``buckets`` folders by a hash of its key. A batch reads the newest folder of the
buckets that it touches, writes new ones beside them, and names all of them in a new manifest, for
all tables together. The manifest appears by a rename, so readers see a batch whole or not at
all; what a batch wrote that ended before that is written again. Each manifest keeps the last
batch of every stream, so a batch that runs once more after its manifest appeared does nothing.
What a batch reads depends on the rows of its buckets and not on the number of batches so far.
A bucket is dealt to as many tasks as its rows come from; it is not gathered in one. Folders that
neither the newest manifest nor the one before it names are deleted as batches go on.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillspark.sources.manifest import Manifests

BUCKETS = 16


class Store(Manifests):
    """``tables``: name to (schema, key column); without a key, rows lie in the bucket of the
    rows that they were made from, which their column ``bucket`` names."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, str | None]],
                 buckets: int = BUCKETS):
        super().__init__(spark, root)
        self.tables, self.buckets = tables, buckets

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: Iterable[DataFrame]) -> list[int]:
        """The buckets of single-column frames; at most ``buckets`` numbers come back."""
        found: set[int] = set()
        for frame in keys:
            rows = frame.select(self.bucket(frame.columns[0]).alias("b")).distinct().collect()
            found |= {r["b"] for r in rows}
        return sorted(found)

    def manifest(self) -> dict:
        """The newest manifest: version, last batch of each stream, folder of each bucket."""
        return self.newest() or {
            "version": 0, "streams": {}, "folders": {t: {} for t in self.tables}}

    def read(self, table: str, buckets: Iterable[int] | None = None,
             manifest: dict | None = None) -> DataFrame:
        folders = (manifest or self.manifest())["folders"][table]
        wanted = folders.values() if buckets is None else [
            folders[str(b)] for b in buckets if str(b) in folders]
        schema = self.tables[table][0]
        paths = [f"{self.root}/{p}" for p in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def forget(self, version: int, named: list[dict]) -> None:
        """Deletes what the manifest of a version names and none of ``named`` does, and itself."""
        old = self.numbered(version)
        used = {f for m in named for folders in m["folders"].values() for f in folders.values()}
        for folders in (old["folders"] if old else {}).values():
            for folder in folders.values():
                if folder not in used:
                    self.delete(folder)
        self.delete(f"manifests/{version}.json")

    def vacuum(self) -> None:
        """Deletes folders that the newest manifest does not name, and older manifests."""
        now = self.manifest()
        for table in self.tables:
            used = set(now["folders"][table].values())
            for batch in self.listed(table):
                for bucket in self.listed(f"{table}/{batch}"):
                    if bucket.startswith("bucket=") and f"{table}/{batch}/{bucket}" not in used:
                        self.delete(f"{table}/{batch}/{bucket}")
        self.forget_older(now)


class Batch:
    """One micro-batch of a stream on a store."""

    def __init__(self, store: Store, stream: str, number: int):
        self.store, self.stream, self.number = store, stream, number
        self.before = store.manifest()
        self.after = json.loads(json.dumps(self.before))

    @property
    def done(self) -> bool:
        return self.before["streams"].get(self.stream, -1) >= self.number

    def old(self, table: str, buckets: list[int]) -> DataFrame:
        return self.store.read(table, buckets, self.before)

    def put(self, table: str, rows: DataFrame, buckets: list[int]) -> DataFrame:
        """Replaces the rows of ``buckets`` by ``rows``; what was written is returned.
        Tasks write the rows where they are."""
        store, folder = self.store, f"{table}/{self.stream}-{self.number}"
        schema, key = store.tables[table]
        if key is not None:
            rows = rows.withColumn("bucket", store.bucket(key))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{store.root}/{folder}")
        there = set(store.listed(folder))
        for b in buckets:
            if f"bucket={b}" in there:
                self.after["folders"][table][str(b)] = f"{folder}/bucket={b}"
            else:
                self.after["folders"][table].pop(str(b), None)
        return store.read(table, buckets, self.after)

    def commit(self) -> None:
        self.after["version"] += 1
        self.after["streams"][self.stream] = self.number
        self.store.publish(self.after)
        self.store.forget(self.before["version"] - 1, [self.before, self.after])
