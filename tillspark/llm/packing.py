"""Packing of documents into sequences by cutting-stock column generation.

A document's ids and an end mark are cut into whole sequences, half a one, a body whose length
is a multiple of ``GRAIN``, and a rest below it. Cuts depend on the document alone. Only the histogram of piece
lengths (at most capacity / grain + grain bins, whatever the input) reaches the driver. There a
linear program over patterns (how many pieces of each length make a sequence) is solved by column
generation: the dual prices of the lengths go into a knapsack, solved by dynamic programming over
the capacity, and its best pattern enters the basis until none pays. Patterns are used as often
as the solution rounded down says; what is left is filled sequence by sequence with the same
dynamic programme. Pieces are ranked within their length, and rank, pattern and copy give every
piece its sequence and offset by arithmetic.

Pieces of a length are ranked within ``BUCKETS`` hashed buckets, whatever their number, and a
bucket's ranks are shifted by the sizes of those before it: no length is ranked in one task.

Edge cases: null and empty texts hold the end mark alone. Repeated rows are packed each for
themselves; rows with a null ``doc_id`` as well. An empty table packs into nothing. Ties within
a length are broken by (doc_id, start, checksum); which of equal rows comes first has no effect
on the result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillspark.llm.bpe import GROUP_BYTES, Encoder
from tillspark.llm.common import arrow_schema, in_groups, record, table, texts_of
from tillspark.session import cut_lineage

CAPACITY = 4096
GRAIN = 64
END_ID = 2
BUCKETS = 1_024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_lengths(total: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    whole, tail = divmod(total, capacity)
    half = capacity // 2 if tail >= capacity // 2 else 0  # larger bodies find no partner
    body = (tail - half) // grain * grain
    return [capacity] * whole + [n for n in (half, body, tail - half - body) if n]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
           grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document."""
    schema, end = arrow_schema(PIECES), np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = Encoder(path)
        for batch in in_groups(batches, "text", GROUP_BYTES):
            out = [[] for _ in schema]
            encoded = encoder.encode_bytes(texts_of(batch, "text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded):
                ids += end
                total, start = len(ids) // 4, 0
                for length in cut_lengths(total, capacity, grain):
                    crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                    for column, value in zip(out, (doc_id, start, length, crc, total)):
                        column.append(value)
                    start += length
            yield record(schema, *out)

    return docs.select(F.col("doc_id").cast("long"),
                       F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_pattern(sizes: np.ndarray, prices: np.ndarray, limits: np.ndarray,
                 capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: copies of each size with the largest total price.

    Copies of a size come in bundles of 1, 2, 4, ..., so that each is one step over all
    capacities at once.
    """
    best = np.zeros(capacity + 1)
    taken = []
    for i in np.argsort(-sizes, kind="stable"):
        left = min(int(limits[i]), capacity // int(sizes[i]))
        bundle = 1
        while left > 0 and prices[i] > 0:
            n = min(bundle, left)
            weight = n * int(sizes[i])
            if weight > capacity:
                break
            offer = best[:-weight] + n * prices[i]
            better = offer > best[weight:] + 1e-12
            taken.append((i, n, weight, better))
            best[weight:] = np.where(better, offer, best[weight:])
            left -= n
            bundle *= 2
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for i, n, weight, better in reversed(taken):
        if room >= weight and better[room - weight]:
            counts[i] += n
            room -= weight
    return counts


def generate_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int
                     ) -> list[tuple[float, np.ndarray]]:
    """(times, counts of each size): the linear program's patterns, times not yet whole.

    Revised simplex over patterns. It starts with one pattern for each size and stops when no
    pattern has a reduced cost, or when the dual says that less than one sequence can be saved:
    prices divided by the best pattern's price are a feasible dual, so the optimum is no less
    than the present total divided by that price.
    """
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(columns)
    level = inverse @ demand
    free = np.full(m, capacity, np.int64)
    for step in itertools.count():
        prices = inverse.sum(axis=0)
        pattern = best_pattern(sizes, prices, free, capacity)
        price = prices @ pattern
        if price <= 1 + 1e-7 or level.sum() * (1 - 1 / price) < 1:
            break
        direction = inverse @ pattern
        rising = direction > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, np.maximum(level, 0) / np.where(rising, direction, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = pattern
        if step % 40 == 39:
            inverse = np.linalg.inv(columns)
        else:
            inverse[out] /= direction[out]
            rest = np.arange(m) != out
            inverse[rest] -= np.outer(direction[rest], inverse[out])
        level = inverse @ demand
    order = np.argsort(-level, kind="stable")
    return [(float(level[j]), columns[:, j].round().astype(np.int64)) for j in order]


def filled(sizes: np.ndarray, left: np.ndarray, room: int, times: int | None = None
           ) -> tuple[int, np.ndarray]:
    """The fullest pattern that the pieces left allow, and how often they allow it."""
    pattern = best_pattern(sizes, sizes.astype(float), left, room)
    some = pattern > 0
    often = int((left[some] // pattern[some]).min()) if some.any() else 0
    return often if times is None else min(often, times), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, grain: int
          ) -> list[tuple[int, np.ndarray]]:
    """(times, counts of each size): patterns that use up the demand exactly.

    The bodies, in units of the grain, are the cutting-stock problem. Its solution is rounded
    down, the bodies left fill further sequences, and the small rests fill what room remains in
    any sequence before they get sequences of their own.
    """
    body = sizes >= grain
    units, left = sizes[body] // grain, demand.astype(np.int64).copy()
    bodies, rests = np.flatnonzero(body), np.flatnonzero(~body)
    used: list[list] = []  # [times, counts of the bodies]
    open_left = left[bodies]
    if len(units):
        for times, pattern in generate_columns(units, open_left, capacity // grain):
            some = pattern > 0
            whole = min(int(times + 1e-6), int((open_left[some] // pattern[some]).min()))
            if whole > 0:
                used.append([whole, pattern])
                open_left = open_left - whole * pattern
        while open_left.any():
            times, pattern = filled(units, open_left, capacity // grain)
            used.append([times, pattern])
            open_left = open_left - times * pattern
    plan = []

    def add(times, of_bodies, of_rests):
        pattern = np.zeros(len(sizes), np.int64)
        pattern[bodies], pattern[rests] = of_bodies, of_rests
        plan.append((times, pattern))

    rest_sizes, rest_left = sizes[rests], left[rests]
    none = np.zeros(len(rests), np.int64)
    for times, pattern in used:
        room = capacity - int(units @ pattern) * grain
        while times and room and rest_left.any():
            often, small = filled(rest_sizes, rest_left, room, times)
            if not often:
                break
            add(often, pattern, small)
            rest_left = rest_left - often * small
            times -= often
        if times:
            add(times, pattern, none)
    while rest_left.any():
        times, small = filled(rest_sizes, rest_left, capacity)
        add(times, np.zeros(len(bodies), np.int64), small)
        rest_left = rest_left - times * small
    return plan


def places(sizes: np.ndarray, plan: list[tuple[int, np.ndarray]]) -> dict[int, tuple]:
    """For each size the ranks at which its patterns begin, and what a rank there needs:
    first sequence, copies in a sequence and offset of the first copy."""
    found = {int(s): ([], [], [], []) for s in sizes}
    rank, sequence = np.zeros(len(sizes), np.int64), 0
    for times, pattern in plan:
        offset = 0
        for i in np.flatnonzero(pattern):
            for column, value in zip(found[int(sizes[i])], (rank[i], sequence, pattern[i], offset)):
                column.append(int(value))
            rank[i] += times * pattern[i]
            offset += int(sizes[i] * pattern[i])
        sequence += times
    return {s: tuple(np.array(c, np.int64) for c in columns) for s, columns in found.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """The rows of ``cut`` (with ``length``) with ``sequence_id`` and ``offset``."""
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"),
                                             F.lit(BUCKETS)).cast("int"))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    shifts = cut_lineage(shifts, "packing-counts")
    histogram = shifts.groupBy("length").agg(F.sum("_rows").alias("n")).collect()
    histogram.sort(key=lambda r: -r["length"])  # a bin for each length: bounded by the cut
    lengths = np.array([r["length"] for r in histogram], np.int64)
    counts = np.array([r["n"] for r in histogram], np.int64)
    full = lengths == capacity
    plan = [(int(n), np.eye(len(lengths), dtype=np.int64)[i])
            for i, n in enumerate(counts) if full[i]]
    for times, pattern in solve(lengths[~full], counts[~full], capacity, grain):
        wide = np.zeros(len(lengths), np.int64)
        wide[~full] = pattern
        plan.append((times, wide))
    where = places(lengths, plan)
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("_row", F.row_number().over(own)).join(
        shifts.select("length", "_bucket", "_shift"), ["length", "_bucket"])
    ranked = ranked.select(*cut.columns, (F.col("_shift") + F.col("_row") - 1).alias("_rank"))
    output = ", ".join(f"`{n}` {k}" for n, k in cut.dtypes)
    output = f"{output}, sequence_id long, offset long"
    schema = arrow_schema(output)
    at = cut.columns.index("length")

    def assign(batches):
        for batch in batches:
            length = batch.column(at).to_numpy()
            rank = batch.column(len(schema) - 2).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                some = length == size
                begin, first, copies, place = where[int(size)]
                k = np.searchsorted(begin, rank[some], side="right") - 1
                within = rank[some] - begin[k]
                sequence[some] = first[k] + within // copies[k]
                offset[some] = place[k] + within % copies[k] * size
            yield record(schema, *batch.columns[:-1], sequence, offset)

    return ranked.mapInArrow(assign, output)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                   grain: int = GRAIN) -> DataFrame:
    return pack(cut_lineage(pieces(docs, path, capacity, grain), "packing-pieces"), capacity, grain)


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None,
              end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids array<int>): the packed sequences themselves, without padding.

    ``docs`` must hold every ``doc_id`` once.
    """
    def begin(batches):
        encoder = Encoder(path)
        for batch in in_groups(batches, "text", GROUP_BYTES):
            ids = [[*x.tolist(), end_id] for x in encoder.encode(texts_of(batch, "text"))]
            yield record(schema, batch.column("doc_id"), ids)

    output = "doc_id long, ids array<int>"
    schema = arrow_schema(output)
    tokens = docs.select("doc_id", "text").mapInArrow(begin, output)
    parts = packed.join(tokens, "doc_id").select(
        "sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1,
                                         F.col("length").cast("int")).alias("part"))
    return parts.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))),
                              lambda p: p["part"])).alias("ids"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
