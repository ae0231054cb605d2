"""Near copies: five-word shingle sets with a Jaccard likeness of ``LIKENESS`` or more.

Candidates come from MinHash bands: a document has ``BANDS`` keys, each made of the least values
of ``ROWS`` permutations of its shingles. Two documents with a key in common are candidates; at a
likeness of 0.8 they have one with a probability of 0.9999, above it sooner. Only the exact
likeness of the shingle sets decides: every link is verified before groups are built, so that
nothing below ``LIKENESS`` is ever a link. A group is what its links connect.

Only equal shingle sets stand for each other (a class). Classes meet by band key over the whole
data set, so the result depends neither on the number of rows nor on their partitions.

Pairs are verified in rounds, and after each the components so far are contracted. In a round
every key that still holds classes of different components takes pivots, those classes that meet
most others: the text that copies were made from has the most common keys. Classes of other
components are compared with them. First each class meets the best pivot of all its keys only,
then the ``FIRST_PIVOTS`` best of each key, then ``FASTER`` times as many of those left, and so
on. A pair is left out only if it is in one component already, was compared, or its sizes rule it
out, so no link between components is lost; a group of copies costs a few pairs for each member,
and only texts that share keys without being near copies are compared with each other all round.
In these rounds a key's members are dealt into chunks, to which its pivots go as well, so that
a set is sent once for each key and not once for each pair.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tillspark.llm.common import annotate, arrow_schema, mix64, record, texts_of, utf8
from tillspark.llm.components import connected_components
from tillspark.llm.simhash import SEED
from tillspark.session import cut_lineage

LIKENESS = (4, 5)  # as a fraction, compared in whole numbers
BANDS, ROWS = 24, 5
FIRST_PIVOTS, FASTER, MOST_PIVOTS = 4, 8, 4_096
CHUNK = 1_000
_BASE = np.uint64(0x100000001B3)
_TIMES = (mix64(np.arange(1, BANDS * ROWS + 1)) | np.uint64(1))[:, None]
_PLUS = mix64(np.arange(1, BANDS * ROWS + 1) + (1 << 20))[:, None]


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Hashes of the set of word shingles, sorted; a text of fewer words is one shingle."""
    parts = utf8(text).lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    stops = ends[min(words, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """The band keys of a shingle set, as signed longs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for j in range(0, len(found), 1024):
        mixed = found[j:j + 1024] * _TIMES + _PLUS
        np.minimum(least, mixed.min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS).astype(np.uint64)
    for j in range(ROWS):
        key = mix64(key * _BASE + least[:, j])
    return key.view(np.int64)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the likeness that makes a link."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return LIKENESS[1] * common >= LIKENESS[0] * (len(both) - common)


def codes(docs: DataFrame, words: int = 5) -> DataFrame:
    """(row, code, size, bands): the shingle set's hash, its size and its band keys."""
    def begin():
        def work(batch):
            sets = [shingles(t, words) for t in texts_of(batch, "text")]
            return (np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets],
                             np.uint64).view(np.int64),
                    [len(s) for s in sets], [bands(s) for s in sets])
        return work

    return annotate(docs, "text", begin, "code long, size long, bands array<long>")


def _sizes_fit(a: str, b: str):
    return F.least(a, b) * LIKENESS[1] >= F.greatest(a, b) * LIKENESS[0]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) pairs of ``pairs`` that are near copies, given (node, set)."""
    output = "u long, v long"
    schema = arrow_schema(output)

    def check(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            fits = np.array([near(np.frombuffer(left[i].as_buffer(), np.uint64),
                                  np.frombuffer(right[i].as_buffer(), np.uint64))
                             for i in range(batch.num_rows)], bool)
            yield record(schema, batch.column(0).to_numpy()[fits],
                         batch.column(1).to_numpy()[fits])

    joined = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    return joined.select("u", "v", "a", "b").mapInArrow(check, output)


def _sets(known: DataFrame, first: DataFrame, words: int) -> DataFrame:
    """(node, set) of the classes in ``first`` (node, doc_id, hash), from their first texts."""
    output = "node long, set binary"
    schema = arrow_schema(output)

    def cut(batches):
        for batch in batches:
            yield record(schema, batch.column(0),
                         [shingles(t, words).tobytes() for t in texts_of(batch, "text")])

    texts = known.join(first, ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])
    return texts.select("node", "text").mapInArrow(cut, output)


def _merged(links: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, into): components of linked labels; and ``rest`` with its labels replaced."""
    moved = connected_components(links).where("node <> label").select(
        F.col("node").alias("label"), F.col("label").alias("into"))
    moved = cut_lineage(moved, "near-moved")
    after = rest.join(moved, "label", "left").withColumn(
        "label", F.coalesce("into", "label")).drop("into")
    return moved, after


def _still_apart(members: DataFrame) -> DataFrame:
    """The rows of the keys that hold more than one component, with the rows of each key."""
    open_ = members.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("a"),
                                        F.max("label").alias("b")).where("a <> b")
    return members.join(open_.select("band", "n"), "band")


class _Meeting:
    """The components of one chunk: its pivots, and members that come in parts."""

    def __init__(self):
        self.nodes, self.sets, self.labels = [], [], np.zeros(0, np.int64)

    def add(self, nodes: list[int], labels: np.ndarray, sets: list[np.ndarray]) -> None:
        self.nodes += nodes
        self.sets += sets
        self.labels = np.r_[self.labels, labels]

    def meet(self, nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray]
             ) -> list[tuple[int, int]]:
        """Pairs of labels that a link joins; what is joined already is not compared again."""
        found, labels = [], labels.copy()
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        for i, (node, own) in enumerate(zip(self.nodes, self.sets)):
            low, high = np.minimum(sizes, len(own)), np.maximum(sizes, len(own))
            todo = (labels != self.labels[i]) & (nodes != node) & (
                LIKENESS[1] * low >= LIKENESS[0] * high)
            if not todo.any():
                continue
            some = todo[owner]
            part, of = flat[some], owner[some]
            place = np.minimum(np.searchsorted(own, part), max(len(own) - 1, 0))
            common = np.bincount(of[own[place] == part], minlength=len(sets))
            linked = todo & (LIKENESS[1] * common >= LIKENESS[0] * (sizes + len(own) - common))
            for label in np.unique(labels[linked]).tolist():
                into = int(self.labels[i])
                found.append((label, into))
                labels[labels == label] = into
                self.labels[self.labels == label] = into
        return found


def linked_labels(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """(u, v): labels of members and pivots that are linked.

    Both have (band, chunk, node, label, set); a chunk's members meet its pivots.
    """
    output = "u long, v long"
    schema = arrow_schema(output)

    def compare(batches):
        key, meeting = None, None
        for batch in batches:
            band, chunk, kind, node, label = (batch.column(i).to_numpy() for i in range(5))
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(5).to_pylist()]
            new = (band[1:] != band[:-1]) | (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(band)]
            found = []
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if key != (band[a], chunk[a]):
                    key, meeting = (band[a], chunk[a]), _Meeting()
                if kind[a] == 0:
                    meeting.add(node[a:b].tolist(), label[a:b], sets[a:b])
                else:
                    found += meeting.meet(node[a:b], label[a:b], sets[a:b])
            yield record(schema, [u for u, _ in found], [v for _, v in found])

    def side(rows, kind):
        return rows.select("band", "chunk", F.lit(kind).alias("kind"), "node", "label", "set")

    both = side(pivots, 0).unionByName(side(members, 1))
    return both.repartition("band", "chunk").sortWithinPartitions(
        "band", "chunk", "kind", "node").mapInArrow(compare, output).distinct()


def _with_best(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) links of each class with the best pivot of all its keys."""
    best = rest.groupBy("band").agg(F.max(F.struct("weight", "node", "size")).alias("best"))
    met = rest.join(best, "band").where(F.col("node") != F.col("best.node")).where(
        _sizes_fit("size", "best.size"))
    return verified(met.groupBy(F.col("node").alias("u")).agg(
        F.max(F.struct("best.weight", "best.node"))["node"].alias("v")), sets)


def group_labels(known: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(node, label) of all linked classes, from (doc_id, hash, text) and
    (node, size, bands, first struct<doc_id, hash>)."""
    keyed = classes.select("node", "size", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(keyed.join(shared, "band"), "near-keys")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    rest = cut_lineage(members.drop("n").join(weight, "node").withColumn(
        "label", F.col("node")), "near-members")
    first = weight.select("node").join(classes.select("node", "first.doc_id", "first.hash"), "node")
    sets = cut_lineage(_sets(known, first, words), "near-sets")
    labels = rest.select("node", "label").distinct()

    links, pivots = cut_lineage(_with_best(rest, sets), "near-links"), FIRST_PIVOTS
    while True:
        if not links.isEmpty():
            moved, rest = _merged(links, rest)
            labels = cut_lineage(labels.join(moved, "label", "left").select(
                "node", F.coalesce("into", "label").alias("label")), "near-labels")
        rest = cut_lineage(_still_apart(cut_lineage(rest.drop("n"), "near-rest")), "near-rest")
        if rest.isEmpty():
            return labels
        order = Window.partitionBy("band").orderBy(F.desc("weight"), "node")
        chosen = cut_lineage(rest.withColumn("place", F.row_number().over(order)).where(
            F.col("place") <= pivots).select("band", "node", "label", "n"), "near-pivots")
        chunks = F.ceil(F.col("n") / CHUNK).cast("long")
        links = cut_lineage(linked_labels(
            rest.join(sets, "node").withColumn("chunk", F.pmod(F.xxhash64("node"), chunks)),
            chosen.join(sets, "node").withColumn("chunk", F.explode(F.sequence(
                F.lit(0).cast("long"), chunks - 1)))), "near-links")
        # The pivots have met every class of their keys.
        rest = rest.join(chosen.select("band", "node"), ["band", "node"], "left_anti")
        pivots = min(FASTER * pivots, MOST_PIVOTS)


def _tied(named: DataFrame, coded: DataFrame, marks: DataFrame) -> DataFrame:
    """(node, first, label) with one label for groups that hold documents of one mark.

    Only groups that differ from the smallest one of a mark are edges.
    """
    named = cut_lineage(named, "near-named")
    marked = coded.select("doc_id", "hash", F.col("code").alias("node")).join(
        marks, ["doc_id", "hash"]).join(named.select("node", "label"), "node")
    marked = cut_lineage(marked.select("label", "mark").distinct(), "near-marked")
    least = marked.groupBy("mark").agg(F.min("label").alias("v"))
    into = connected_components(marked.join(least, "mark").select(
        F.col("label").alias("u"), "v"))
    return named.join(into.select(F.col("node").alias("label"), F.col("label").alias("into")),
                      "label", "left").select(
        "node", "first", F.coalesce("into", "label").alias("label"))


def keep_first(docs: DataFrame, words: int = 5, marks: DataFrame | None = None) -> DataFrame:
    """One row of each group of near copies: the one with the smallest ``doc_id``.

    ``marks``: rows (doc_id, hash of the text, mark); documents of one mark are in one group too.

    Rows without a ``doc_id`` are kept and take no part. Empty texts are copies of each other.
    Rows with one ``doc_id`` and different texts are different documents; of such the smaller
    text hash comes first. A repeated row goes or stays with its like.
    """
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    coded = codes(known, words).select("row.doc_id", F.xxhash64("row.text").alias("hash"), "code",
                                       "size", "bands")
    coded = cut_lineage(coded, "near-codes")
    classes = coded.groupBy(F.col("code").alias("node")).agg(
        F.min(F.struct("doc_id", "hash")).alias("first"), F.first("size").alias("size"),
        F.first("bands").alias("bands"))
    classes = cut_lineage(classes, "near-classes")
    labels = group_labels(known.withColumn("hash", F.xxhash64("text")), classes, words)
    named = classes.select("node", "first").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    if marks is not None:
        named = _tied(named, coded, marks)
    stays = named.groupBy("label").agg(F.min("first").alias("stays"))
    named = named.join(stays, "label").select(F.col("node").alias("code"), "stays")
    gone = coded.select("doc_id", "hash", "code").join(named, "code").where(
        F.struct("doc_id", "hash") != F.col("stays")).select(
        F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"),
                       F.xxhash64("text").alias("_hash"))
    return rows.join(gone, ["_id", "_hash"], "left_anti").select(
        *[F.col(f"row.{c}") for c in docs.columns])
