"""Session builder and the shared working folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str, master: str = "local[*]", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own.

    Python workers of local executors find this package through PYTHONPATH.
    """
    package_root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if package_root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([package_root, *filter(None, paths)])
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach.

    Taken from ``spark.checkpoint.dir``. Where that is unset it is a folder of the warehouse,
    which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def run_root(spark: SparkSession) -> str:
    """The parent of all that this application writes there."""
    return f"{shared_root(spark).rstrip('/')}/tillspark-{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Deletes what this application wrote there; its intermediate tables are gone after that."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_root(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path):
        files.delete(path, True)


def work_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; nothing is created or deleted."""
    return f"{run_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that an executor
    lost later costs a re-read and not the whole history of the plan."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
