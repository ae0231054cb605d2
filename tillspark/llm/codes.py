"""Product codes of whole-number vectors, assigned with LAESA pivots.

Every vector is cut into ``PARTS`` consecutive parts of equal width. Each part position has a
codebook; a round gives each part its nearest entry and moves every entry to the mean of its
parts. The search for the nearest entry is LAESA's: a few fixed pivots stand beside each
codebook, the distances from every part to them are computed once and stored with the vector,
and each round adds only the distances from pivots to entries. The largest difference of the two
over the pivots is a lower bound of the distance from part to entry. Entries are tried in the
order of that bound, by exact whole-number distances, until the bound passes the best one found.

Rows are read in tasks and never gathered: a round moves counts and sums of each entry, and the
driver holds the codebooks, whose size does not depend on the number of rows. The pivots are
entries of the first codebook, chosen one after the other with the largest sum of distances to
those chosen before.

Edge cases: see ``vectors`` for vectors that take no part or are of uneven length; a width that
is no multiple of ``PARTS`` is padded with zeros to the next one. Fewer rows than entries make a
codebook of that many entries. First entries come by ascending ``vec_id``, nulls last, equal ids
by their components. Rows with a null ``vec_id`` and repeated rows are coded and counted each.
Null labels are one label. An empty table gives an empty result. Equal distances go to the lower
index. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillspark.llm import vectors
from tillspark.llm.common import arrow_schema, record, table
from tillspark.session import cut_lineage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4
SMALL_LABELS = 10_000
_SLACK = 1e-4  # pivot distances are stored in single precision


def choose_pivots(book: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """``count`` entries of each part position's codebook, far from one another."""
    out = np.empty((len(book), min(count, book.shape[1]), book.shape[2]), np.int64)
    for j, entries in enumerate(book):
        apart = np.zeros(len(entries))
        at, free = 0, np.ones(len(entries), bool)
        for k in range(out.shape[1]):
            out[j, k], free[at] = entries[at], False
            apart += np.sqrt(((entries - entries[at]) ** 2).sum(1))
            at = int(np.where(free, apart, -1).argmax())
    return out


def pivot_distances(cut: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, parts, pivots) distances, from (rows, parts, width) and (parts, pivots, width)."""
    out = np.empty((len(cut), cut.shape[1], pivots.shape[1]), np.float32)
    for k in range(pivots.shape[1]):
        out[:, :, k] = np.sqrt(((cut - pivots[None, :, k]) ** 2).sum(axis=2))
    return out


def assign(cut: np.ndarray, far: np.ndarray, book: np.ndarray, pivots: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, int]:
    """(index and squared distance of each part's nearest entry, exact distances computed)."""
    rows, places, _ = cut.shape
    index = np.empty((rows, places), np.int64)
    square = np.empty((rows, places), np.int64)
    tried = 0
    for j in range(places):
        part, entries = cut[:, j], book[j]
        ring = pivot_distances(entries[:, None], pivots[j][None])[:, 0]
        bound = np.zeros((rows, len(entries)), np.float32)
        for k in range(ring.shape[1]):
            np.maximum(bound, np.abs(far[:, j, k, None] - ring[None, :, k]), out=bound)
        order = np.argsort(bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        best_at = order[:, 0].copy()
        best = ((part - entries[best_at]) ** 2).sum(axis=1)
        tried += rows
        active = np.arange(rows)
        for step in range(1, len(entries)):
            reach = np.sqrt(best[active].astype(np.float64)) * (1 + _SLACK) + _SLACK
            low = bound[active, step]
            active = active[low * (1 - _SLACK) <= reach + _SLACK * far[active, j].max(
                axis=1, initial=0)]
            if not len(active):
                break
            at = order[active, step]
            found = ((part[active] - entries[at]) ** 2).sum(axis=1)
            tried += len(active)
            better = (found < best[active]) | ((found == best[active]) & (at < best_at[active]))
            best[active[better]], best_at[active[better]] = found[better], at[better]
        index[:, j], square[:, j] = best_at, best
    return index, square, tried


def moved(stored: DataFrame, work, book: np.ndarray) -> np.ndarray:
    """The codebooks after one round: means of the parts, rounded down; unused entries stay."""
    places, entries, width = book.shape
    output = "slot int, sum long, rows long"
    schema = arrow_schema(output)

    def run(batches):
        sums = np.zeros((places * entries, width), np.int64)
        rows = np.zeros(places * entries, np.int64)
        offset = np.arange(places) * entries
        for batch in vectors.parts(batches):
            cut, index, _ = work(batch, book)
            slot = (index + offset).ravel()
            np.add.at(sums, slot, cut.reshape(-1, width))
            rows += np.bincount(slot, minlength=len(rows))
        some = np.repeat(rows > 0, width)
        yield record(schema, np.flatnonzero(some).astype(np.int32), sums.ravel()[some],
                     np.repeat(rows, width)[some])

    totals = stored.mapInArrow(run, output).groupBy("slot").agg(
        F.sum("sum").alias("sum"), F.sum("rows").alias("rows")).collect()
    flat = book.reshape(-1).copy()  # a row for each component of the codebooks: bounded
    for r in totals:
        flat[r["slot"]] = r["sum"] // r["rows"]
    return flat.reshape(book.shape)


def books_text(book: np.ndarray) -> str:
    return ",".join(map(str, book.ravel().tolist()))


def train_and_code(df: DataFrame, vector: str = "embedding", parts: int = PARTS,
                   entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS,
                   scale: int = vectors.SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, codes binary, error), final codebooks).

    ``codes`` holds one byte for each part position.
    """
    spark = df.sparkSession
    output = "vec_id long, label string, codes binary, error long"
    rows = vectors.whole_numbers(df.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string"), vector), vector, scale)
    of = vectors.shape(rows)
    if not of.rows:
        return spark.createDataFrame([], output), np.zeros((parts, 0, 0), np.int64)
    width = -(-max(of.width, 1) // parts)
    of = vectors.Shape(of.rows, parts * width, of.peak, of.square)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).collect()
    book = np.zeros((len(first), of.width), np.int64)
    for i, r in enumerate(first):
        book[i, :len(r["ints"])] = r["ints"]
    book = np.ascontiguousarray(book.reshape(-1, parts, width).transpose(1, 0, 2))
    fixed = choose_pivots(book, pivots)
    schema = arrow_schema("vec_id long, label string, vector binary, far binary")

    def measure(batches):
        for batch in vectors.parts(batches):
            cut = vectors.dense(batch.column("ints"), of.width).reshape(-1, parts, width)
            yield record(schema, batch.column("vec_id"), batch.column("label"),
                         vectors.packed(cut.reshape(len(cut), -1), of.kind),
                         [x.tobytes() for x in pivot_distances(cut, fixed)])

    stored = cut_lineage(rows.mapInArrow(
        measure, "vec_id long, label string, vector binary, far binary"), "codes-vectors")

    def work(batch, now):
        cut = vectors.unpacked(batch.column("vector"), of.kind, of.width).astype(
            np.int64).reshape(-1, parts, width)
        far = vectors.unpacked(batch.column("far"), np.dtype("<f4"),
                               parts * fixed.shape[1]).reshape(len(cut), parts, -1)
        index, square, _ = assign(cut, far, now, fixed)
        return cut, index, square

    for _ in range(rounds):
        book = moved(stored, work, book)
    last, coded = book, arrow_schema(output)

    def code(batches):
        for batch in vectors.parts(batches):
            _, index, square = work(batch, last)
            yield record(coded, batch.column("vec_id"), batch.column("label"),
                         [x.tobytes() for x in index.astype(np.uint8)], square.sum(axis=1))

    return cut_lineage(stored.mapInArrow(code, output), "codes"), last


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over the rows of a label, nulls together.

    The sums are written and counted first: up to ``SMALL_LABELS`` of them are broadcast, more
    are joined by label, where a label's sum is one row and skewed labels can be split.
    """
    sums = cut_lineage(coded.groupBy(F.col("label").alias("_label")).agg(
        F.sum("error").alias("label_error")), "codes-labels")
    few = sums.count() <= SMALL_LABELS
    return coded.join(F.broadcast(sums) if few else sums,
                      F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = train_and_code(table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", "label"))
    digest = hashlib.sha256(books_text(book).encode()).hexdigest()
    return with_label_error(coded).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(digest).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Nearest entries by the codebook ``b{k}``."""
    return f"""
near{k} AS (
  SELECT r, j, min(struct_pack(d, e)) AS best FROM (
    SELECT p.r, p.j, b.e, CAST(sum((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS d
    FROM parts p JOIN b{k} b USING (j, i) GROUP BY p.r, p.j, b.e) GROUP BY r, j)"""


def _moved_sql(k: int) -> str:
    """The codebook after that; division rounds down for negative sums as well."""
    return f"""
mean{k} AS (
  SELECT p.j, n.best.e AS e, p.i, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS c
  FROM parts p JOIN near{k} n USING (r, j) GROUP BY p.j, n.best.e, p.i),
b{k + 1} AS (
  SELECT b.j, b.e, b.i, CASE WHEN m.c IS NULL THEN b.x
      WHEN m.s >= 0 THEN m.s // m.c ELSE -((m.c - 1 - m.s) // m.c) END AS x
  FROM b{k} b LEFT JOIN mean{k} m USING (j, e, i))"""


OP11_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS spot, len(v) // {PARTS} AS w
         FROM kept),
parts AS (SELECT r, spot // w AS j, spot % w AS i, x FROM flat),
b0 AS (SELECT j, CAST(r - 1 AS BIGINT) AS e, i, x FROM parts WHERE r <= {ENTRIES}),
{_round_sql(0)}, {_moved_sql(0)}, {_round_sql(1)}, {_moved_sql(1)}, {_round_sql(2)},
coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY j) AS code,
         CAST(sum(best.d) AS BIGINT) AS error FROM near2 GROUP BY r),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j, e, i)) AS h FROM b2)
SELECT k.vec_id, c.code, c.error,
       CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT h FROM digest) AS codebooks_sha256
FROM kept k JOIN coded c USING (r)"""
