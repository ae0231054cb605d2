"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

GROUP_BYTES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions that hold ``rows_each`` rows at most on average, the session's at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def in_groups(batches: Iterable[pa.RecordBatch], column: str,
              size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about ``size`` bytes of text; no row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(column)
        sizes = pc.list_value_length(cells) if pa.types.is_list(cells.type) else \
            pc.binary_length(cells)
        sizes = pc.fill_null(sizes, 0).to_numpy(
            zero_copy_only=False).astype(np.int64) + 64
        group = (np.cumsum(sizes) - sizes) // size
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A column's texts; null is empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch from lists, numpy arrays or Arrow arrays in the order of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)],
        schema=schema)


def arrow_schema(text: str) -> pa.Schema:
    """An Arrow schema from a DDL text such as ``doc_id long, text string``."""
    return to_arrow_schema(StructType.fromDDL(text))


def annotate(docs: DataFrame, column: str, begin: Callable[[], Callable], added: str,
             size: int = GROUP_BYTES) -> DataFrame:
    """(row, *added): every row whole as a struct, and new columns computed beside it.

    ``begin`` runs once in each task and returns the function from a batch to the new columns.
    The rows travel as one struct, so that no name of theirs can clash with an added one.
    """
    kind = StructType([StructField("row", docs.schema, False), *StructType.fromDDL(added)])
    schema = to_arrow_schema(kind)

    def run(batches):
        work = begin()
        for whole in batches:
            flat = pa.RecordBatch.from_struct_array(whole.column(0))
            done = 0
            for part in in_groups([flat], column, size):
                rows = whole.column(0).slice(done, part.num_rows)
                done += part.num_rows
                yield record(schema, rows, *work(part))

    return docs.select(F.struct("*").alias("row")).mapInArrow(run, kind)


def mix64(values: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value for each 64-bit value (an invertible finaliser)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x
