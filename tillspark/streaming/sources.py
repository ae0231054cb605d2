"""Streaming reads of the log and helpers to run a stream to its present end."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, types as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


def stream_parquet(spark: SparkSession, folder: str, schema: T.StructType, name: str = "*",
                   max_bytes: int = 512 * 1024 * 1024) -> DataFrame:
    """Tails the Parquet files of a folder.

    ``max_bytes`` bounds a micro-batch also when it catches up with a long log, and with it
    what a busy key can bring into one task; only a single larger file exceeds it.
    """
    return (spark.readStream.schema(schema).option("pathGlobFilter", name)
            .option("maxBytesPerTrigger", max_bytes).parquet(folder))


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State kept on disk with changelog checkpoints while a query is started."""
    before = spark.conf.get(PROVIDER_KEY)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER_KEY, before)


def run_available(writer, checkpoint: str) -> None:
    """Processes what is there now; a restart with the same checkpoint goes on from it."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
