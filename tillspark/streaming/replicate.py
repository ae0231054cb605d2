"""Live replication: the current state, change notifications and live aggregates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillspark.model import REPLICATED_COLLECTIONS
from tillspark.operators import insights, replication
from tillspark.operators.ordered import latest
from tillspark.streaming.sources import run_available


def _replicated(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("collection_name").isin(*REPLICATED_COLLECTIONS))


def follow_state(changes: DataFrame, output: str, checkpoint: str) -> None:
    """Keeps the newest version of each document under ``output``.

    A micro-batch is reduced to one row for each document and written to the folder of its
    batch id. A batch that runs again after a failure overwrites its own folder, so each
    change counts once. No stream state is kept: versions are ordered by sequence.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        replication.current_state(_replicated(batch)).write.mode("overwrite").parquet(
            f"{output}/batch={batch_id}")

    run_available(changes.writeStream.foreachBatch(write), checkpoint)


def followed_state(spark: SparkSession, output: str) -> DataFrame:
    """Current state from the folders of all batches.

    A batch's row has the first creation time in that batch, so the earliest batch's stays.
    """
    return replication.current_state(spark.read.parquet(output).drop("batch"))


def compact_state(spark: SparkSession, output: str, compacted: str) -> None:
    """One row for each document, clustered by key, to replace the folders of the batches."""
    (followed_state(spark, output)
     .repartitionByRange("collection_name", "document_id")
     .write.parquet(f"{compacted}/batch=-1"))


def notify(changes: DataFrame, output: str, checkpoint: str) -> None:
    """One resync row for each micro-batch and collection that had accepted changes.

    Any number of changes between two notifications becomes a single one, and an empty
    batch gives none.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        grouped = _replicated(batch).groupBy("collection_name").agg(
            F.max("server_sequence").alias("server_sequence"))
        grouped.select(
            F.lit("RESYNC").alias("event"), "collection_name", "server_sequence",
            (F.col("collection_name") == "receipts").alias("wakeExtraction"),
        ).coalesce(1).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    run_available(changes.writeStream.foreachBatch(write), checkpoint)


_STATE = ("id string, server_sequence long, key string, total long, count long, "
          "previousTotal long, rows long")
_ADDED = ("total", "count", "previousTotal", "rows")


def live_comparison(receipts: DataFrame, now: datetime, dimension: str, output: str,
                    checkpoint: str, label: str = "") -> None:
    """Category or merchant comparison kept up to date from a stream of receipt versions.

    A receipt's last contribution is kept; a newer version, or its deletion, takes that back
    and adds its own. Versions are ordered by ``server_sequence`` and may come late;
    ``_deleted`` marks tombstones (both optional). Each micro-batch writes its contributions
    and its deltas to folders of its own, which a repeated batch overwrites. ``label`` tells
    several streams into one ``output`` apart.
    """
    spark = receipts.sparkSession
    for name, value in (("server_sequence", F.lit(0).cast("long")), ("_deleted", F.lit(False))):
        if name not in receipts.columns:
            receipts = receipts.withColumn(name, value)
    empty = spark.createDataFrame([], _STATE)
    for part in ("state", "deltas"):
        empty.write.mode("ignore").parquet(f"{output}/{part}/part=start")

    def write(batch: DataFrame, batch_id: int) -> None:
        own = f"{label}-{batch_id}"
        seen = batch.sparkSession.read.schema(f"{_STATE}, part string").parquet(
            f"{output}/state").where(F.col("part") != own).drop("part")
        new = latest(insights.contributions(batch, now, dimension), ["id"], "server_sequence")
        old = latest(seen.join(new.select("id"), "id", "left_semi"), ["id"], "server_sequence")
        known = old.select("id", F.col("server_sequence").alias("known"))
        fresh = new.join(known, "id", "left").where(
            F.col("known").isNull() | (F.col("server_sequence") >= F.col("known")))
        fresh.drop("known").write.mode("overwrite").parquet(f"{output}/state/part={own}")
        fresh = batch.sparkSession.read.schema(_STATE).parquet(f"{output}/state/part={own}")
        gone = old.join(fresh.select("id"), "id", "left_semi").select(
            "id", "server_sequence", "key", *[(-F.col(c)).alias(c) for c in _ADDED])
        fresh.unionByName(gone).write.mode("overwrite").parquet(f"{output}/deltas/part={own}")

    run_available(receipts.writeStream.foreachBatch(write), checkpoint)


def latest_comparison(spark: SparkSession, output: str) -> DataFrame:
    """The comparison after all batches."""
    return insights.compared(spark.read.schema(f"{_STATE}, part string").parquet(
        f"{output}/deltas"))
