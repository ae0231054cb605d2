"""Document fingerprints from closed syncmers.

A k-mer of a text's code points is an anchor if the smallest of its inner s-mers (by hash) is its
first or its last one. That depends on the k-mer alone, so equal passages have equal anchors
wherever they stand, at positions that differ by the passages' offset only: anchors serve for
positional matching (``matches``). A fingerprint keeps the smallest anchor hash in each of
``SLOTS`` slots, 16 bits each, as hexadecimal text. The likeness of two fingerprints is the share
of equal slots among those filled in either.

The query needs the next document's text for the edited text. Rows are range partitioned and
sorted by (doc_id, hash of the text), so that the next document is the next row of the task; only
each task's last row has to meet the first row of another task, in a small second step.

Edge cases: null and empty texts have no anchor and an empty fingerprint (all slots 0000); two
empty fingerprints are alike 1, an empty and a filled one 0. A text shorter than k is one anchor,
its whole. A short text none of whose k-mers is closed has its k-mer with the smallest hash as
its anchor. Rows with a null ``doc_id`` come first. The next document of a repeated row is the
repeat. A single row is its own next document. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillspark.llm.common import (arrow_schema, code_points, in_groups, mix64, record, table,
                                  tasks_for, texts_of, utf8)
from tillspark.session import cut_lineage

K, S = 20, 7
SLOTS = 64
DOCS_EACH = 20_000
_BASE = np.uint64(0x100000001B3)
_PIECE = 1 << 20


def _anchors(codes: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers of at least K code points; a whole text
    without any has its k-mer with the smallest hash instead."""
    x = codes.astype(np.uint64)
    n = len(x) - S + 1
    small = np.zeros(n, np.uint64)
    for j in range(S):
        small = small * _BASE + x[j:j + n]
    small = mix64(small)
    width = K - S + 1  # s-mers in a k-mer
    least, reach = small, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    count = n - width + 1
    if reach < width:
        least = np.minimum(least[:count], least[width - reach:width - reach + count])
    closed = np.flatnonzero((small[:count] == least) | (small[width - 1:] == least))
    every = whole and not len(closed)
    if every:  # only below 2 * K - S - 1 code points
        closed = np.arange(count)
    hashes = np.zeros(len(closed), np.uint64)
    for offset in [*range(0, K - S, S), K - S]:  # s-mers that cover the k-mer
        hashes = mix64(hashes * _BASE + small[closed + offset])
    if every:
        closed, hashes = closed[[np.argmin(hashes)]], hashes[[np.argmin(hashes)]]
    return closed, hashes


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a whole text; long texts go through in overlapping pieces."""
    codes = code_points(text)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(codes) < K:
        digest = hashlib.blake2b(utf8(text), digest_size=8).digest()
        return np.zeros(1, np.int64), np.frombuffer(digest, np.uint64)
    if len(codes) <= _PIECE:
        return _anchors(codes, True)
    found = []
    for a in range(0, len(codes) - K + 1, _PIECE):
        position, value = _anchors(codes[a:a + _PIECE + K - 1], False)
        found.append((position + a, value))
    return tuple(np.concatenate(c) for c in zip(*found))


def sketch(text: str) -> np.ndarray:
    """The slots (unsigned 16 bits, 0 is empty) of a text."""
    out = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    _, hashes = anchors(text)
    if len(hashes):
        np.minimum.at(out, (hashes % np.uint64(SLOTS)).astype(np.int64), hashes)
    filled = out != np.iinfo(np.uint64).max
    return np.where(filled, mix64(out) % np.uint64(65535) + np.uint64(1), 0).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = np.count_nonzero((a != 0) | (b != 0))
    return 1.0 if not either else float(np.count_nonzero((a == b) & (a != 0)) / either)


def text_form(slots: np.ndarray) -> str:
    return slots.astype(">u2").tobytes().hex()


def matches(left: str, right: str) -> list[tuple[int, int, int]]:
    """(offset of right against left, anchors, code points between the first and the last):
    passages that both texts share, by anchors that agree in hash and in offset."""
    at, own = anchors(left)
    there, other = anchors(right)
    order = np.argsort(own, kind="stable")
    lo = np.searchsorted(own[order], other, "left")
    hi = np.searchsorted(own[order], other, "right")
    shifts: dict[int, list[int]] = {}
    for place, a, b in zip(there.tolist(), lo.tolist(), hi.tolist()):
        for k in order[a:b].tolist():
            shifts.setdefault(place - int(at[k]), []).append(int(at[k]))
    return sorted((shift, len(p), max(p) - min(p) + K) for shift, p in shifts.items())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint)"""
    output = "doc_id long, n_chars long, fingerprint string"
    schema = arrow_schema(output)

    def work(batches):
        for batch in in_groups(batches, "text"):
            texts = texts_of(batch, "text")
            yield record(schema, batch.column("doc_id"), [len(t) for t in texts],
                         [text_form(sketch(t)) for t in texts])

    return docs.select(F.col("doc_id").cast("long"),
                       F.col("text").cast("string")).mapInArrow(work, output)


def edited(text: str, following: str) -> str:
    """The last quarter replaced by the beginning of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")


def _compared(text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    changed = edited(text, following)
    new = own if changed == text else sketch(changed)
    return (len(text), hashlib.sha256(utf8(changed)).hexdigest(), text_form(own), text_form(new),
            likeness(own, new), likeness(own, other))


def compare_with_next(docs: DataFrame, docs_each: int = DOCS_EACH) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    tasks = tasks_for(spark, rows.count(), docs_each)
    placed = rows.repartitionByRange(tasks, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    output = f"kind int, part int, {_RESULT}, text string"
    schema = arrow_schema(output)

    def walk(batches):
        part, held, first = TaskContext.get().partitionId(), None, None
        for batch in in_groups(batches, "text"):
            found = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                own = sketch(text)
                if held is not None:
                    before, old, slots = held
                    found.append((before, *_compared(old, slots, text, own)))
                else:
                    first = doc_id, text
                held = doc_id, text, own
            n = len(found)
            if n:
                yield record(schema, [0] * n, [part] * n, *map(list, zip(*found)), [None] * n)
        if held is not None:  # the ends of the task, for the second step
            ends = (first, held[:2])
            yield record(schema, [1, 2], [part] * 2, [e[0] for e in ends],
                         *[[None] * 2 for _ in range(6)], [e[1] for e in ends])

    walked = cut_lineage(placed.select("doc_id", "text").mapInArrow(walk, output), "syncmers")
    heads = walked.where("kind = 1").select("part", F.col("text").alias("following"))
    # One row for each task: the part that follows, and the first one after the last.
    order = Window.orderBy("part")
    after = heads.select("part", F.lead("part").over(order).alias("to"),
                         F.min("part").over(Window.partitionBy()).alias("least"))
    after = after.select("part", F.coalesce("to", "least").alias("to"))
    last = walked.where("kind = 2").select("part", "doc_id", "text").join(after, "part").join(
        heads.withColumnRenamed("part", "to"), "to")
    schema_out = arrow_schema(_RESULT)

    def finish(batches):
        for batch in batches:
            found = [(doc_id, *_compared(text, sketch(text), following, sketch(following)))
                     for doc_id, text, following in zip(
                         batch.column(0).to_pylist(), texts_of(batch, "text"),
                         texts_of(batch, "following"))]
            if found:
                yield record(schema_out, *map(list, zip(*found)))

    ends = last.select("doc_id", "text", "following").mapInArrow(finish, _RESULT)
    names = schema_out.names
    return walked.where("kind = 0").select(*names).unionByName(ends)


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
