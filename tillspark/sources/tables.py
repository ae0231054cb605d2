"""Readers and writers of the receipt tables on Parquet.

``receipts`` is partitioned by month of the transaction date, ``changes`` by collection,
images by the first two characters of their hash, so that the usual filters prune folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tillspark import model
from tillspark.functions.dates import Period

SCHEMAS = {
    "receipts": model.RECEIPTS, "receipt_items": model.RECEIPT_ITEMS,
    "images": model.IMAGES, "jobs": model.CLIENT_JOBS, "settings": model.SETTINGS,
    "audit_events": model.AUDIT_EVENTS, "changes": model.CHANGES,
    "extraction_jobs": model.EXTRACTION_JOBS,
}


PARTITIONS = {"receipts": "tx_month"}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one table with its declared schema and the folder column it is split by."""
    schema = T.StructType([*SCHEMAS[name].fields])
    if name in PARTITIONS:
        schema = schema.add(PARTITIONS[name], T.StringType())
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def write_receipts(receipts: DataFrame, root: str) -> None:
    """Cluster by month before writing; a month of any size spreads over several files."""
    by_month = receipts.withColumn(
        "tx_month", F.coalesce(F.nullif(F.left("transactionDate", F.lit(7)), F.lit("")),
                               F.lit("none")))
    (by_month.repartitionByRange("tx_month", "id")
     .write.partitionBy("tx_month").parquet(f"{root}/receipts"))


def read_receipts_of(spark: SparkSession, root: str, period: Period) -> DataFrame:
    """Receipts that the comparison of a period can count: two month folders."""
    months = {d.strftime("%Y-%m") for d in (period.start, period.previous_start)}
    return read_table(spark, root, "receipts").where(F.col("tx_month").isin(*sorted(months)))


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Saves a catalogue table bucketed and sorted by its join key.

    Receipts by ``id`` and items by ``receiptId`` with the same number of buckets join
    without a shuffle of either side.
    """
    df.write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def append_changes(changes: DataFrame, root: str) -> None:
    """Append to the log; files carry the sequence range in their statistics."""
    (changes.sortWithinPartitions("server_sequence")
     .write.mode("append").partitionBy("collection_name").parquet(f"{root}/changes"))


def read_changes(spark: SparkSession, root: str, collection: str) -> DataFrame:
    """The log of one collection; other collections' folders are not listed."""
    return read_table(spark, root, "changes").where(F.col("collection_name") == collection)


def read_document(current: DataFrame, collection: str, document_id: str) -> DataFrame:
    """Point read on current state."""
    return current.where((F.col("collection_name") == collection)
                         & (F.col("document_id") == document_id))


def newest_first(receipts: DataFrame) -> DataFrame:
    """Presentation order of the archive."""
    return receipts.orderBy(F.desc("updatedAt"), "id")
