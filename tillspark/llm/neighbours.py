"""Exact top-k inner products of whole-number vectors by a Voronoi join.

The distance is an angle. A data vector gets one coordinate more, which lifts it to the length
``M`` of the longest; a query gets a zero there. The angle between the two then orders data as
the inner product does, and angles obey the triangle inequality.

1. *Pivots.* A bounded, hashed sample of the data gives ``PIVOTS`` pivots. Every row goes to the
   cell of its nearest pivot, with its angle to it.
2. *Summaries.* Of each cell: the number of rows, the least and the largest angle, and the
   ``k + 1`` rows nearest to the pivot. The latter give each query a first bound: its k-th best
   product with them, which its true k-th best cannot be below.
3. *Groups.* Cells of queries that lie together form groups of about ``GROUP_QUERIES`` queries; a
   cell with more is split by hash. For each data cell a group has an interval of angles to the
   cell's pivot: the union, over its queries, of the query's angle to the pivot plus and minus its
   bound. A row outside the interval cannot be among the best of any query of the group.
4. *Replication.* Every row is sent to the groups whose interval it lies in, and nowhere else;
   a group's rows are dealt by hash into slices of about ``SLICE_ROWS``, to which its queries go
   as well.
5. *Local search.* In a slice a query passes over the cells that its bound, which rises as better
   rows are found, excludes; the rest is multiplied in blocks. The best of the slices are merged.

Nothing but pivots and cell summaries, bounded by their parameters, and a row for each query
group reaches the driver. Where the data has no clusters, bounds exclude little and the join is
one of all data with the stated queries, in blocks.

Edge cases: see ``vectors`` for vectors that take no part or are of uneven length. Rows with a
null id take no part. Candidates of a query are the rows with another id; repeated rows are
candidates each, and one query. Equal scores go by id. Empty tables give an empty result. Only
the id and the vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tillspark.llm import vectors
from tillspark.llm.common import arrow_schema, record, table
from tillspark.session import cut_lineage

TOP = 5
EVERY = 50
PIVOTS = 64
GROUP_QUERIES = 256
SLICE_ROWS = 25_000
SMALL_ROUTES = 200_000
_BLOCK = 2_048
_SLACK = 1e-6
_EXACT = 2 ** 53
_CELLS = "vec_id long, cell int, angle double, vector binary"


def products(a: np.ndarray, b: np.ndarray, square: int) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices."""
    if square < _EXACT:  # by Cauchy's inequality no partial sum leaves the doubles' whole numbers
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Space:
    """Angles between pivots and rows, given the largest sum of squares."""

    def __init__(self, pivots: np.ndarray, square: int):
        self.pivots, self.square = pivots.astype(np.float64), float(square)
        self.lift = np.sqrt(np.maximum(self.square - (self.pivots ** 2).sum(1), 0))

    def of_data(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.float64)
        lift = np.sqrt(np.maximum(self.square - (rows ** 2).sum(1), 0))
        dot = rows @ self.pivots.T + lift[:, None] * self.lift
        return np.arccos(np.clip(dot / self.square, -1, 1)) if self.square else np.zeros(dot.shape)

    def of_queries(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.float64)
        return self.angle(rows @ self.pivots.T, rows)

    def angle(self, dot: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Angles from the products of queries; a zero query is at a right angle to all."""
        scale = np.sqrt((rows.astype(np.float64) ** 2).sum(1) * self.square)[:, None]
        return np.arccos(np.clip(np.divide(dot, scale, out=np.zeros(dot.shape),
                                           where=scale > 0), -1, 1))


def choose_pivots(rows: DataFrame, of: vectors.Shape, count: int) -> np.ndarray:
    """Distinct vectors from the rows with the least hashes; four rows are drawn for each."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "ints").limit(4 * count).collect()
    flat = np.zeros((len(drawn), of.width), np.int64)
    for i, r in enumerate(drawn):
        flat[i, :len(r["ints"])] = r["ints"]
    _, first = np.unique(flat, axis=0, return_index=True)
    return flat[np.sort(first)[:count]]


def into_cells(stored: DataFrame, space: Space, of: vectors.Shape) -> DataFrame:
    schema = arrow_schema(_CELLS)

    def run(batches):
        for batch in vectors.parts(batches):
            angle = space.of_data(vectors.unpacked(batch.column("vector"), of.kind, of.width))
            cell = angle.argmin(axis=1)
            yield record(schema, batch.column("vec_id"), cell.astype(np.int32),
                         angle[np.arange(len(cell)), cell], batch.column("vector"))

    return stored.mapInArrow(run, _CELLS)


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best, in the order of query, score from above, id."""
    order = np.lexsort((ids, -score, query))
    if not len(order):
        return order
    sorted_ = query[order]
    lead = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    rank = np.arange(len(order)) - np.repeat(lead, np.diff(np.r_[lead, len(order)]))
    return order[rank < k]


def bounded_queries(queries: DataFrame, space: Space, of: vectors.Shape, near: list, k: int,
                    first: np.ndarray, spread: np.ndarray) -> DataFrame:
    """(vec_id, vector, floor, group): queries with the product that their k-th best reaches.

    ``near`` are the summaries' rows (vec_id, vector); ``first`` and ``spread`` give the groups
    of a cell's queries.
    """
    output = "vec_id long, vector binary, floor long, group int"
    schema = arrow_schema(output)
    ids = np.array([r["vec_id"] for r in near], np.int64)
    rows = np.frombuffer(b"".join(bytes(r["vector"]) for r in near), of.kind).reshape(
        len(ids), of.width)
    lowest = np.iinfo(np.int64).min

    def run(batches):
        for batch in vectors.parts(batches):
            own = vectors.unpacked(batch.column("vector"), of.kind, of.width)
            score = products(own, rows, of.square)
            vec_id = batch.column("vec_id").to_numpy()
            score[vec_id[:, None] == ids[None, :]] = lowest
            floor = np.full(len(own), lowest)
            if len(ids) >= k:
                floor = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            cell = batch.column("cell").to_numpy()
            deal = batch.column("deal").to_numpy()
            yield record(schema, batch.column("vec_id"), batch.column("vector"), floor,
                         (first[cell] + deal % spread[cell]).astype(np.int32))

    dealt = queries.withColumn("deal", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)))
    return dealt.mapInArrow(run, output)


def _reach(space: Space, own: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The angle within which a query's best lie, given the product they reach."""
    angle = space.angle(np.maximum(floor, -2.0 ** 62).astype(float)[:, None], own)[:, 0]
    angle[(floor == np.iinfo(np.int64).min) | ~own.any(axis=1)] = np.pi
    return angle + _SLACK


def routes(queries: DataFrame, space: Space, of: vectors.Shape, low: np.ndarray,
           high: np.ndarray) -> DataFrame:
    """(group, cell, low, high): the angles to the cell's pivot that matter to the group."""
    output = "group int, cell int, low double, high double"
    schema = arrow_schema(output)
    cells = len(low)

    def run(batches):
        found: dict[int, list[np.ndarray]] = {}
        for batch in vectors.parts(batches):
            own = vectors.unpacked(batch.column("vector"), of.kind, of.width)
            angle = space.of_queries(own)
            reach = _reach(space, own, batch.column("floor").to_numpy())[:, None]
            group = batch.column("group").to_numpy()
            for g in np.unique(group).tolist():
                some = group == g
                now = (angle[some] - reach[some]).min(0), (angle[some] + reach[some]).max(0)
                old = found.setdefault(g, [*now])
                np.minimum(old[0], now[0], out=old[0])
                np.maximum(old[1], now[1], out=old[1])
        for g, (a, b) in found.items():
            yield record(schema, np.full(cells, g, np.int32), np.arange(cells, dtype=np.int32),
                         a, b)

    whole = queries.mapInArrow(run, output).groupBy("group", "cell").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    ends = queries.sparkSession.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(low, high))],
        "cell int, least double, most double")
    return whole.join(F.broadcast(ends), "cell").where("low <= most and high >= least").select(
        "group", "cell", "low", "high")


def local_best(own: np.ndarray, own_ids: np.ndarray, floor: np.ndarray, rows: np.ndarray,
               ids: np.ndarray, cell: np.ndarray, angle: np.ndarray, space: Space, square: int,
               k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query number, score, id, products computed) of the ``k`` best rows of each query."""
    order = np.lexsort((ids, cell))
    rows, ids, cell, angle = rows[order], ids[order], cell[order], angle[order]
    edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    ends = np.r_[edges[1:], len(cell)]
    to_pivot = space.of_queries(own)
    reach = _reach(space, own, floor)
    floor = floor.copy()
    kept = [np.zeros(0, np.int64)] * 3
    done = 0
    nearest = np.argsort(to_pivot[:, cell[edges]].min(axis=0), kind="stable")
    for c in nearest.tolist():
        a, b = edges[c], ends[c]
        pivot = to_pivot[:, cell[a]]
        active = np.flatnonzero((pivot - reach <= angle[a:b].max())
                                & (pivot + reach >= angle[a:b].min()))
        for at in range(a, b, _BLOCK):
            if not len(active):
                break
            to = min(at + _BLOCK, b)
            score = products(own[active], rows[at:to], square)
            done += score.size
            hit, row = np.nonzero((score >= floor[active, None])
                                  & (own_ids[active, None] != ids[None, at:to]))
            if not len(hit):
                continue
            new = active[hit], score[hit, row], ids[at + row]
            kept = [np.r_[x, y] for x, y in zip(kept, new)]
            place = best(*kept, k)
            kept = [x[place] for x in kept]
            last = np.flatnonzero(np.r_[kept[0][1:] != kept[0][:-1], True])
            full = np.bincount(kept[0], minlength=len(own))[kept[0][last]] >= k
            raised = kept[0][last[full]]
            floor[raised] = np.maximum(floor[raised], kept[1][last[full]])
        some = np.unique(kept[0])
        reach[some] = _reach(space, own[some], floor[some])
    return kept[0], kept[1], kept[2], done


def top_products(df: DataFrame, is_query: Column, k: int = TOP, vector: str = "embedding",
                 pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES,
                 slice_rows: int = SLICE_ROWS, scale: int = vectors.SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of each row that ``is_query`` takes.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = df.sparkSession
    output = "query_id long, rank int, vec_id long, score long"
    rows = vectors.whole_numbers(df.where("vec_id is not null").select(
        F.col("vec_id").cast("long"), vector), vector, scale)
    of = vectors.shape(rows)
    if not of.rows:
        return spark.createDataFrame([], output)
    of = vectors.Shape(of.rows, max(of.width, 1), of.peak, of.square)
    space = Space(choose_pivots(rows, of, pivots), of.square)
    data = cut_lineage(into_cells(vectors.store(rows, of), space, of), "neighbours-cells")

    cells = len(space.pivots)
    low, high = np.full(cells, np.inf), np.full(cells, -np.inf)
    for r in data.groupBy("cell").agg(F.min("angle").alias("a"), F.max("angle").alias("b")
                                      ).collect():
        low[r["cell"]], high[r["cell"]] = r["a"] - _SLACK, r["b"] + _SLACK
    own = Window.partitionBy("cell").orderBy("angle", "vec_id", "vector")
    near = data.withColumn("place", F.row_number().over(own)).where(
        F.col("place") <= k + 1).select("vec_id", "vector").collect()

    queries = data.where(is_query).select("vec_id", "cell", "vector").dropDuplicates(
        ["vec_id", "vector"])
    sizes = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}
    first, spread = np.zeros(cells, np.int64), np.ones(cells, np.int64)
    group, room = -1, 0
    for c in chain(space):
        n = sizes.get(c, 0)
        if n > room or group < 0:
            group, room = group + 1, group_queries
        first[c], spread[c] = group, max(1, -(-n // group_queries))
        if spread[c] > 1:
            group, room = group + int(spread[c]) - 1, 0
        else:
            room -= n
    queries = cut_lineage(bounded_queries(queries, space, of, near, k, first, spread),
                          "neighbours-queries")
    where = cut_lineage(routes(queries, space, of, low, high), "neighbours-routes")
    where = F.broadcast(where) if where.count() <= SMALL_ROUTES else where
    slices = -(-of.rows // slice_rows)
    sent = data.join(where, "cell").where("angle between low and high").select(
        "group", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(slices)).cast("int").alias("slice"),
        "vec_id", "cell", "angle", "vector")
    asked = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    found = "query_id long, query long, vec_id long, score long"
    schema = arrow_schema(found)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema)
        mine = vectors.unpacked(left["vector"], of.kind, of.width)
        ids = left["vec_id"].to_numpy()
        query, score, hit, _ = local_best(
            mine, ids, left["floor"].to_numpy(),
            vectors.unpacked(right["vector"], of.kind, of.width), right["vec_id"].to_numpy(),
            right["cell"].to_numpy(), right["angle"].to_numpy(), space, of.square, k)
        key = left["key"].to_numpy()
        return pa.Table.from_batches([record(schema, ids[query], key[query], hit, score)])

    asked = asked.withColumn("key", F.xxhash64("vector"))
    merged = asked.groupBy("group", "slice").cogroup(
        sent.groupBy("group", "slice")).applyInArrow(search, found)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def chain(space: Space) -> list[int]:
    """All pivots, each followed by the nearest one that is left."""
    apart = space.of_data(space.pivots)
    at, left, out = 0, np.ones(len(apart), bool), []
    while left.any():
        out.append(at)
        left[at] = False
        at = int(np.where(left, apart[at], np.inf).argmin())
    return out


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP13_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, d.vec_id,
             CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT)
             AS score
      FROM v q JOIN v d ON q.vec_id % {EVERY} = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)
                          AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}"""
