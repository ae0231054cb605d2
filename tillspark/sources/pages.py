"""Current state by (collection, sequence) for pulls: a page reads a few files and the log's end.

The state up to some sequence is stored in files of ``rows_each`` rows, sorted by collection and
sequence, with each file's range beside them. Versions after that sequence are the tail. A page
takes from the ranges the files that hold its rows, leaves out documents that the tail has newer,
and adds the tail's. Everything up to the stored sequence must be in the log when it is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillspark.model import PULL_BATCH_DEFAULT, PULL_BATCH_MAX
from tillspark.operators.replication import current_state

ROWS_EACH = 100_000


def store(changes: DataFrame, root: str, upto: int, rows_each: int = ROWS_EACH) -> None:
    """Writes the current state of all versions up to ``upto``, its ranges and ``upto``."""
    spark = changes.sparkSession
    rows = current_state(changes.where(F.col("server_sequence") <= upto).drop("created_at"))
    (rows.repartitionByRange("collection_name", "server_sequence")
     .sortWithinPartitions("collection_name", "server_sequence")
     .write.option("maxRecordsPerFile", rows_each).parquet(f"{root}/rows"))
    written = spark.read.schema(rows.schema).parquet(f"{root}/rows")
    ranges = written.groupBy("collection_name", F.input_file_name().alias("file")).agg(
        F.min("server_sequence").alias("first"), F.max("server_sequence").alias("last"),
        F.count("*").alias("rows"))
    (ranges.repartitionByRange("collection_name", "first")
     .sortWithinPartitions("collection_name", "first").write.parquet(f"{root}/ranges"))
    spark.range(1).select(F.lit(upto).cast("long").alias("upto")).coalesce(1) \
        .write.parquet(f"{root}/stored")


def stored_upto(spark: SparkSession, root: str) -> int:
    return spark.read.parquet(f"{root}/stored").head()["upto"]


def files_of_page(spark: SparkSession, root: str, collection: str, checkpoint: int,
                  rows: int) -> list[str]:
    """The files, in order, that surely hold the next ``rows`` rows, if there are that many.

    Every file listed has a row past the checkpoint, so at most ``rows`` ranges come back; of
    a file that begins before the checkpoint no more than one row is counted on.
    """
    ranges = (spark.read.parquet(f"{root}/ranges")
              .where((F.col("collection_name") == collection) & (F.col("last") > checkpoint))
              .orderBy("first").limit(rows).collect())
    files, held = [], 0
    for r in ranges:
        if held >= rows:
            break
        files.append(r["file"])
        held += r["rows"] if r["first"] > checkpoint else 1
    return files


def pull(changes: DataFrame, root: str, collection: str, checkpoint: int = 0,
         batch_size: int = PULL_BATCH_DEFAULT) -> DataFrame:
    """As ``replication.pull``, from the stored state and the log past it.

    A stored document that the tail has newer is left out; there are at most as many of them
    as the tail has documents, so that many rows more are taken from the files.
    """
    if not 1 <= batch_size <= PULL_BATCH_MAX:
        raise ValueError(f"batch_size must be in 1..{PULL_BATCH_MAX}")
    if checkpoint < 0:
        raise ValueError("checkpoint must not be negative")
    spark = changes.sparkSession
    upto = stored_upto(spark, root)
    tail = current_state(changes.drop("created_at").where(
        (F.col("collection_name") == collection)
        & (F.col("server_sequence") > max(upto, checkpoint))))
    if checkpoint < upto:
        newer = tail.select("document_id")
        files = files_of_page(spark, root, collection, checkpoint, batch_size + newer.count())
        if files:
            held = spark.read.schema(tail.schema).parquet(*files).where(
                (F.col("collection_name") == collection)
                & (F.col("server_sequence") > checkpoint))
            tail = held.join(newer, "document_id", "left_anti").unionByName(tail)
    return tail.orderBy("server_sequence").limit(batch_size)
