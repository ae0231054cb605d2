"""Connected components of an edge table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillspark.session import cut_lineage


def connected_components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """(node, label) of every node in ``edges`` (u, v): the smallest node it reaches.

    Alternates two steps until nothing changes: every neighbour of a node is tied to the
    smallest one around it, once for the larger and once for the smaller neighbours. A node's
    neighbours are never gathered: the smallest is an aggregate, the ties are a join. Each
    round is written to the shared folder. Self-loops and repeated edges change nothing.
    """
    pairs = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = cut_lineage(pairs, "components")
    for _ in range(limit):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct(), "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(),
                            "components")
        stable = pairs.exceptAll(after).isEmpty() and after.exceptAll(pairs).isEmpty()
        pairs = after
        if stable:
            break
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("label")))
