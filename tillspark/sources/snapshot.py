"""Export, verified snapshots and restore."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

APPLICATION = "tillspark"


def _measures(df: DataFrame) -> list[Column]:
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(row_hash), F.lit(0)).cast("string").alias("digest")]


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count and an order-insensitive sum of row hashes; combines map-side."""
    return df.agg(*_measures(df)).withColumn("table", F.lit(name))


def read_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table, then reads it back and compares it with what was written.

    The source is fingerprinted while it is written, so it is computed once. Returns table,
    rows and ``matches``; the manifest keeps one row for each table.
    """
    spark = next(iter(tables.values())).sparkSession
    kept = []
    for name, df in tables.items():
        seen = Observation(f"backup-{name}")
        df.observe(seen, *_measures(df)).write.parquet(f"{path}/{name}")
        kept.append((name, seen.get["rows"], seen.get["digest"]))
    spark.createDataFrame(kept, "table string, rows long, digest string").coalesce(1) \
        .write.parquet(f"{path}/_manifest")
    return verify(spark, path, list(tables))


def verify(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Reads a snapshot and compares it with its manifest."""
    prints = [fingerprint(df, name) for name, df in read_snapshot(spark, path, names).items()]
    found = reduce(DataFrame.unionByName, prints)
    kept = spark.read.parquet(f"{path}/_manifest").select(
        "table", F.col("rows").alias("kept_rows"), F.col("digest").alias("kept_digest"))
    same = (F.col("rows") == F.col("kept_rows")) & (F.col("digest") == F.col("kept_digest"))
    return found.join(kept, "table", "left").select(
        "table", "rows", F.coalesce(same, F.lit(False)).alias("matches"))


def restore(spark: SparkSession, path: str, destination: str, names: list[str]) -> None:
    """Verifies a snapshot, copies it beside the destination and swaps it in by rename."""
    if not verify(spark, path, names).where("NOT matches").isEmpty():
        raise ValueError(f"Snapshot {path} failed its integrity check")
    mark = uuid.uuid4().hex
    staging, replaced = f"{destination}.restore-{mark}", f"{destination}.replaced-{mark}"
    for name, df in read_snapshot(spark, path, names).items():
        df.write.parquet(f"{staging}/{name}")
    spark.read.parquet(f"{path}/_manifest").write.parquet(f"{staging}/_manifest")
    if not verify(spark, staging, names).where("NOT matches").isEmpty():
        raise ValueError(f"The copy {staging} failed its integrity check")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, old, new = (hadoop.Path(p) for p in (destination, replaced, staging))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{destination} could not be set aside")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{staging} could not be moved to {destination}")


def export(tables: dict[str, DataFrame], path: str, exported_at: str,
           include_images: bool = False) -> DataFrame:
    """JSON export: one folder for each of receipts, items and images, and a manifest.

    Images are listed only when asked; their bytes become a data URL on one line, row by row.
    Parts are compressed (``.json.gz``): JSON repeats its field names in every row.
    """
    parts = {"receipts": tables["receipts"], "items": tables["items"]}
    if include_images:
        images = tables["images"]
        for variant in ("full", "thumbnail"):
            if variant in images.columns:
                images = images.withColumn(variant, F.concat(
                    F.lit("data:"), F.col("mimeType"), F.lit(";base64,"),
                    F.translate(F.base64(F.col(variant)), "\r\n", "")))
        parts["images"] = images
    for name, df in parts.items():
        df.write.option("ignoreNullFields", "false").json(f"{path}/{name}", compression="gzip")
    spark = tables["receipts"].sparkSession
    manifest = spark.createDataFrame(
        [(APPLICATION, 1, exported_at, name) for name in ("receipts", "items", "images")],
        "application string, schemaVersion int, exportedAt string, part string")
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest
