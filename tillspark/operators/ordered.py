"""Order-dependent steps that do not need a whole group in one task.

Sequence numbers are unique, so all rows of one key whose number falls in the same range of
``width`` form a chunk of at most ``width`` rows. Work inside chunks is spread by
(key, chunk); only one row for each chunk crosses chunk borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_WIDTH = 1_000_000


def with_previous(df: DataFrame, keys: list[str], order: str, value: Column, alias: str,
                  width: int = CHUNK_WIDTH, following: bool = False) -> DataFrame:
    """Adds the value of the row before (or after) in ``order`` within ``keys``.

    A hot key is split over its chunks: the lag runs inside a chunk, and the first row of a
    chunk takes the last value of the nearest chunk before it. That second lag sees one row
    for each chunk.
    """
    chunk = F.floor(F.col(order) / F.lit(width)).cast("long")
    chunked = df.withColumns({"_chunk": chunk, "_value": value})
    by_chunk = [*keys, "_chunk"]
    inside = Window.partitionBy(*by_chunk).orderBy(F.asc(order))
    between = Window.partitionBy(*keys).orderBy("_chunk")
    step, edge = (F.lead, F.min_by) if following else (F.lag, F.max_by)

    local = chunked.withColumns({
        "_near": step(F.struct("_value"), 1).over(inside)})
    edges = chunked.groupBy(*by_chunk).agg(
        edge(F.struct("_value"), F.col(order)).alias("_edge"))
    edges = edges.withColumn("_far", step("_edge", 1).over(between)).drop("_edge")
    joined = local.join(edges, by_chunk, "left")
    return joined.withColumn(
        alias, F.coalesce("_near", "_far")["_value"]
    ).drop("_chunk", "_value", "_near", "_far")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*")


def with_last_marked(df: DataFrame, keys: list[str], order: str, mark: Column, alias: str,
                     width: int = CHUNK_WIDTH) -> DataFrame:
    """Adds the order number of the last marked row up to this one, in chunks as above."""
    chunk = F.floor(F.col(order) / F.lit(width)).cast("long")
    by_chunk = [*keys, "_chunk"]
    chunked = df.withColumns({"_chunk": chunk, "_mark": F.when(mark, F.col(order))})
    inside = Window.partitionBy(*by_chunk).orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    local = chunked.withColumn("_near", F.max("_mark").over(inside))
    edges = chunked.groupBy(*by_chunk).agg(F.max("_mark").alias("_edge"))
    edges = edges.withColumn("_far", F.max("_edge").over(before)).drop("_edge")
    return local.join(edges, by_chunk, "left").withColumn(
        alias, F.coalesce("_near", "_far")).drop("_chunk", "_mark", "_near", "_far")
