"""Whole-number vectors: which rows take part, and how tasks hold them.

A vector that is null, or holds a null, NaN or infinite component, takes no part. Every other
component x becomes floor(scale * x), x as double. Vectors are as wide as the longest one of
the table; a shorter one counts as padded with zeros. Sums of squares must fit 62 bits: a table
beyond that is refused with an error instead of giving wrapped numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from tillspark.llm.common import record

SCALE = 256
BATCH_ROWS = 4_096


@dataclass(frozen=True)
class Shape:
    """What one pass over a table says about its vectors."""

    rows: int
    width: int
    peak: int  # largest magnitude of a component
    square: int  # largest sum of squares

    @property
    def kind(self) -> np.dtype:
        """The narrowest type that holds every component."""
        return np.dtype(next(t for t in ("<i2", "<i4", "<i8") if self.peak <= np.iinfo(t).max))


def whole_numbers(df: DataFrame, column: str, scale: int = SCALE) -> DataFrame:
    """The rows that take part, with ``ints array<long>`` in place of ``column``."""
    x = F.col(column)
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (
        F.abs(c.cast("double")) < F.lit(float("inf"))))
    others = [c for c in df.columns if c != column]
    return df.where(x.isNotNull() & usable).select(
        *others, F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("ints"))


def shape(rows: DataFrame) -> Shape:
    square = F.aggregate("ints", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    found = rows.agg(F.count("*"), F.max(F.size("ints")), F.max(F.array_max(
        F.transform("ints", lambda c: F.abs(c)))), F.max(square)).first()
    if (found[3] or 0) >= 2.0 ** 61:
        raise ValueError("vectors are too long for whole numbers of 64 bits")
    return Shape(found[0], found[1] or 0, found[2] or 0, int(found[3] or 0))


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers from a list column, shorter ones padded with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes),
        np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def packed(values: np.ndarray, kind: np.dtype) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(values.astype(kind))]


def unpacked(column: pa.Array | pa.ChunkedArray, kind: np.dtype, width: int) -> np.ndarray:
    """Rows from a binary column that :func:`packed` made."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(len(column), width)


def parts(batches, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, none empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def store(rows: DataFrame, of: Shape) -> DataFrame:
    """``rows`` with a binary column ``vector`` in place of ``ints``."""
    fields = [f for f in rows.schema.fields if f.name != "ints"]
    kind = StructType([*fields, StructField("vector", BinaryType())])
    schema, names = to_arrow_schema(kind), [f.name for f in fields]
    width, dtype = of.width, of.kind

    def run(batches):
        for batch in parts(batches):
            yield record(schema, *[batch.column(n) for n in names],
                         packed(dense(batch.column("ints"), width), dtype))

    return rows.mapInArrow(run, kind)
