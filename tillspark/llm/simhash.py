"""SimHash near-duplicates by a binary trie that is joined with itself.

The trie join walks pairs of trie nodes together, from the root pair down. A pair carries the
number of bits in which its two paths differ and is dropped as soon as that exceeds the budget.
Nodes are ranges of a sorted array, so that all pairs of one depth are a few numpy operations.

Distribution: two fingerprints at distance ``budget`` or less agree on at least one of
``budget + 1`` blocks of bits. For each block the bits are rotated so that this block comes
first, and a trie is joined in which the first block's budget is zero: its subtrees below the
block are independent and are dealt out by (block, value). A subtree with more than ``hot``
fingerprints (a large group of near copies) is split further: its node pairs are expanded by
``SPLIT_BITS`` levels in Spark, and each surviving pair of children is a task of its own, again
until no task is larger. Only distinct fingerprints enter; copies share one.

Each task reduces its links to a spanning forest, so that a group of near copies costs no more
than its size; components are then found over these edges by repeated joins.

Edge cases: null and empty texts have fingerprint zero and link like any other. Null ``doc_id``
rows get a component by their fingerprint, named by its smallest non-null id. Repeated rows give
repeated results. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillspark.llm.common import annotate, arrow_schema, record, table, tasks_for, texts_of, utf8
from tillspark.llm.components import connected_components
from tillspark.session import cut_lineage

BITS = 64
BUDGET = 2
SEED = 42
HOT = 50_000
SPLIT_BITS = 6
ROWS_EACH = 400_000
_FRONTIER = 200_000


def fingerprint(text: str, words: int = 3) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included."""
    parts = utf8(text).lower().split()  # bytes: only A-Z fold, only ASCII blanks separate
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist())]
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[i:i + (1 << 16)], np.uint64)
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(row, fp): every row and its fingerprint as a signed long."""
    def begin():
        def work(batch):
            found = [fingerprint(t, words) for t in texts_of(batch, "text")]
            return (np.array(found, np.uint64).view(np.int64),)
        return work

    return annotate(docs, "text", begin, "fp long")


def blocks(budget: int) -> list[tuple[int, int]]:
    """(rotation, bits) of the blocks of which links agree on one."""
    edges = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def rotated(fp: Column, by: int) -> Column:
    """Bits rotated left, so that bit ``by`` from the top comes first."""
    if not by:
        return fp
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_join(values: np.ndarray, roots: np.ndarray, depth: int, budget: int,
              side: np.ndarray | None = None, used: np.ndarray | None = None
              ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of all links inside each root, from one walk over pairs of nodes.

    ``values`` (uint64) are sorted within each run of equal ``roots``, distinct there, and agree
    on their first ``depth`` bits within a run (within a side of it, if ``side`` is given: then
    only links across the sides 0 and 1 are wanted, and ``used`` bits already differ).
    """
    n = len(values)
    if side is None:
        lo = np.flatnonzero(np.r_[True, roots[1:] != roots[:-1]]) if n else np.zeros(0, np.int64)
        hi = np.r_[lo[1:], n] if n else lo
        start = np.column_stack([lo, hi, lo, hi, np.zeros_like(lo)])[hi - lo > 1]
    else:
        edge = np.flatnonzero(np.r_[True, (roots[1:] != roots[:-1]) | (side[1:] != side[:-1])]) \
            if n else np.zeros(0, np.int64)
        end = np.r_[edge[1:], n] if n else edge
        pair = np.flatnonzero((roots[edge[:-1]] == roots[edge[1:]])) if n else edge
        start = np.column_stack([edge[pair], end[pair], edge[pair + 1], end[pair + 1],
                                 used[edge[pair]]])
    stack = [(depth, start[i:i + _FRONTIER]) for i in range(0, len(start), _FRONTIER)]
    while stack:
        level, pairs = stack.pop()
        a, b, c, d, differ = pairs.T
        single = (b - a == 1) & (d - c == 1)
        left, right = a[single], c[single]
        if len(left):
            some = left != right
            left, right = left[some], right[some]
            near = _popcount(values[left] ^ values[right]) <= budget
            if near.any():
                yield left[near], right[near]
        pairs = pairs[~single]
        if not len(pairs) or level == BITS:
            continue
        a, b, c, d, differ = pairs.T
        bit = np.uint64(1) << np.uint64(BITS - 1 - level)
        ones = np.r_[0, np.cumsum((values & bit) != 0)]
        m, k = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])  # zeros come first in a node
        same = a == c
        other, fits = ~same, differ + 1 <= budget
        children = np.concatenate([
            np.column_stack([a, m, c, k, differ]),
            np.column_stack([m, b, k, d, differ]),
            np.column_stack([a, m, k, d, differ + 1])[fits],
            np.column_stack([m, b, c, k, differ + 1])[fits & other]])
        filled = (children[:, 1] > children[:, 0]) & (children[:, 3] > children[:, 2])
        lone = (children[:, 0] == children[:, 2]) & (children[:, 1] - children[:, 0] == 1)
        children = children[filled & ~lone]
        stack += [(level + 1, children[i:i + _FRONTIER])
                  for i in range(0, len(children), _FRONTIER)]


def forest(values: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray]]
           ) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each linked place and its component's first place."""
    parent = np.arange(len(values))
    for left, right in links:
        while True:
            p, q = parent[left], parent[right]
            split = p != q
            if not split.any():
                break
            p, q, left, right = p[split], q[split], left[split], right[split]
            np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
            while True:
                above = parent[parent]
                if (above == parent).all():
                    break
                parent = above
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return linked, parent[linked]


def _tasks(distinct: DataFrame, budget: int, hot: int) -> list[tuple[DataFrame, bool]]:
    """Node pairs as rows (block, pa, pb, side, used, depth, value, fp), none with more than
    about ``hot`` rows, split by whether the pair is a node with itself."""
    parts = []
    for index, (rotation, width) in enumerate(blocks(budget)):
        value = rotated(F.col("fp"), rotation)
        prefix = F.shiftrightunsigned(value, BITS - width)
        parts.append(distinct.select(
            "fp", F.lit(index).alias("block"), prefix.alias("pa"), prefix.alias("pb"),
            F.lit(0).alias("side"), F.lit(0).alias("used"), F.lit(width).alias("depth"),
            value.alias("value")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = cut_lineage(rows, "simhash-nodes")
    done = []
    key = ["block", "depth", "pa", "pb"]
    while True:
        sizes = rows.groupBy(*key).agg(F.count("*").alias("size"))
        big = sizes.where((F.col("size") > hot) & (F.col("depth") < BITS))
        big = cut_lineage(big.drop("size"), "simhash-hot")
        if big.isEmpty():
            return [*done, rows]
        done.append(rows.join(big, key, "left_anti"))
        rows = cut_lineage(expanded(rows.join(big, key, "left_semi"), budget), "simhash-nodes")


def expanded(rows: DataFrame, budget: int, bits: int = SPLIT_BITS) -> DataFrame:
    """Every row in the pairs of child nodes, ``bits`` levels down, that stay in the budget."""
    masks = [m for m in range(1 << bits) if bin(m).count("1") <= budget]
    step = F.least(F.lit(bits), F.lit(BITS) - F.col("depth"))
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"),
                               F.lit(bin(m).count("1")).alias("cost")) for m in masks])
    fits = F.filter(masks, lambda m: (m["cost"] + F.col("used") <= budget)
                    & (m["mask"] < F.call_function("shiftleft", F.lit(1).cast("long"), step)))
    out = rows.withColumn("_m", F.explode(fits)).withColumn("_step", step)
    below = F.call_function("shiftrightunsigned", F.col("value"),
                            F.lit(BITS) - F.col("depth") - F.col("_step"))
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_step")) - 1
    low = below.bitwiseAND(ones)

    def child(prefix):
        return F.call_function("shiftleft", F.col(prefix), F.col("_step")).bitwiseOR(low)

    own, mirrored = low, low.bitwiseXOR(F.col("_m.mask"))

    def extend(prefix, tail):
        return F.call_function("shiftleft", F.col(prefix), F.col("_step")).bitwiseOR(tail)

    self_pair = F.col("pa") == F.col("pb")
    mine = F.when(F.col("side") == 0, extend("pa", own)).otherwise(extend("pb", own))
    theirs = F.when(F.col("side") == 0, extend("pb", mirrored)).otherwise(extend("pa", mirrored))
    first = F.when(self_pair, mine <= theirs).otherwise(F.col("side") == 0)
    return out.select(
        "fp", "block", F.when(first, mine).otherwise(theirs).alias("pa"),
        F.when(first, theirs).otherwise(mine).alias("pb"),
        F.when(first, 0).otherwise(1).alias("side"),
        (F.col("used") + F.col("_m.cost")).cast("int").alias("used"),
        (F.col("depth") + F.col("_step")).cast("int").alias("depth"), "value")


def _join_tasks(rows: DataFrame, output: str, emit, budget: int, rows_each: int) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.repartition(tasks_for(spark, rows.count(), rows_each), "block", "depth", "pa", "pb")
    schema = arrow_schema(output)

    def run(batches):
        columns = [[] for _ in range(8)]
        for batch in batches:
            for kept, column in zip(columns, batch.columns):
                kept.append(column.to_numpy(zero_copy_only=False))
        if not columns[0]:
            return
        fp, block, pa, pb, side, used, depth, value = map(np.concatenate, columns)
        value, unsigned = value.view(np.uint64), fp.view(np.uint64)
        order = np.lexsort((value, side, pb, pa, depth, block))
        fp, block, pa, pb, side, used, depth, value, unsigned = (
            x[order] for x in (fp, block, pa, pb, side, used, depth, value, unsigned))
        change = np.r_[True, (block[1:] != block[:-1]) | (depth[1:] != depth[:-1])
                       | (pa[1:] != pa[:-1]) | (pb[1:] != pb[:-1])]
        root = np.cumsum(change)
        for level in np.unique(depth):
            for twin in (True, False):
                some = np.flatnonzero((depth == level) & ((pa == pb) == twin))
                if not len(some):
                    continue
                links = trie_join(value[some], root[some], int(level), budget,
                                  None if twin else side[some], None if twin else used[some])
                for u, v in emit(value[some], links):
                    yield record(schema, fp[some][u], fp[some][v])

    columns = ["fp", "block", "pa", "pb", "side", "used", "depth", "value"]
    return rows.select(*columns).mapInArrow(run, output)


def links(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT,
          rows_each: int = ROWS_EACH) -> DataFrame:
    """(left, right): all pairs of different fingerprints within the budget, once each."""
    def every(values, found):
        return found

    pairs = [_join_tasks(r, "a long, b long", every, budget, rows_each)
             for r in _tasks(distinct, budget, hot)]
    whole = pairs[0]
    for part in pairs[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.least("a", "b").alias("left"),
                        F.greatest("a", "b").alias("right")).distinct()


def edges(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT,
          rows_each: int = ROWS_EACH) -> DataFrame:
    """(u, v): edges with the same components as ``links``, at most a row for each task's row."""
    def spanning(values, found):
        u, v = forest(values, found)
        if len(u):
            yield u, v

    parts = [_join_tasks(r, "u long, v long", spanning, budget, rows_each)
             for r in _tasks(distinct, budget, hot)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def labelled(classes: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints ``fp`` with ``label``, the smallest fingerprint that links reach."""
    labels = connected_components(edges(classes.select("fp"), budget, hot))
    named = classes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left")
    return named.withColumn("label", F.coalesce("label", "fp"))


def marks(docs: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(doc_id, hash, mark): documents, told apart by id and hash of the text, with equal marks
    where links connect their fingerprints."""
    prints = cut_lineage(fingerprints(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("hash"),
        "fp").distinct(), "simhash-prints")
    classes = cut_lineage(prints.select("fp").distinct(), "simhash-classes")
    return prints.join(labelled(classes, budget, hot), "fp").select(
        "doc_id", "hash", F.col("label").alias("mark"))


def components(prints: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) of (doc_id, fp) rows; the smallest id that links reach."""
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")),
                          "simhash-classes")
    named = cut_lineage(labelled(classes, budget, hot), "simhash-named")
    # An aggregate and a join, not a window: a component may hold a third of all fingerprints.
    first = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(first, "label")
    return prints.join(named.select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = cut_lineage(fingerprints(docs).select("row.doc_id", "fp"), "simhash-prints")
    found = components(prints)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")
