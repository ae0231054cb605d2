"""Removal of repeated passages by hashing lines and stretches of lines.

A document is cut into units twice: into its lines, and into short stretches of words whose ends
depend on the words alone (a stretch ends where a hash of two neighbouring words is the least of
some ``WINDOW`` in a row), so that a passage inside other text, or over several lines, is cut the
same way wherever it stands, but for its first and last 2 * ``WINDOW`` words at most. Of a passage
of 50 words at least 20 in a row are cut alike, whatever the words are: every such repeat is found.
The words of a repeat before its first and after its last common cut stay.
Units are normalised (lower case, single blanks) and grouped by a 128-bit digest over all
documents. The occurrence that comes first, by doc_id and then by position in the text (for lines
and stretches alike, so that both rules keep the same copy), stays. The others go:

* a line of at least ``LINE_WORDS`` words, with its line break;
* consecutive repeated stretches of at least ``RUN_WORDS`` words together.

Shorter repeats are common speech and stay. The removed spans keep their offsets in the original
text, in code points.

A batch first ranks its own units; only the first occurrence of a unit in a batch is compared
with other batches. Units that repeat within a batch are remembered by the task (a bounded number
of them), and later batches send such a unit only if they hold an earlier occurrence. So a line
that a third of all documents share costs about one row for each task.

Edge cases: null texts stay null and empty ones empty, with no span. Rows with a null ``doc_id``
are returned unchanged and rank nowhere. Rows with the same ``doc_id`` and text are the same
document and are cut alike; rows with one ``doc_id`` and different texts are different documents,
ordered by a hash of the text and told apart by it. A document whose text is all repeated keeps its row with an empty
text. Other columns pass through.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tillspark.llm.common import arrow_schema, in_groups, mix64, record, table, utf8
from tillspark.session import cut_lineage

LINE_WORDS = 5
RUN_WORDS = 20
WINDOW = 8
_WORD = re.compile(r"\S+")
_BATCH_BYTES = 8_000_000


def cuts(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each line with one more at the end, and of each stretch, line sizes)"""
    words, sizes = [], []
    for line in text.lower().split("\n"):
        own = line.split()
        words += own
        sizes.append(len(own))
    lines = np.r_[0, np.cumsum(sizes)]
    if not words:
        return words, lines, np.zeros(1, np.int64), np.array(sizes)
    crc = zlib.crc32
    marks = np.fromiter((crc(utf8(w)) for w in words), np.uint64, len(words))
    pair = mix64(marks + (np.r_[np.uint64(0), marks[:-1]] << np.uint64(32)))
    if len(words) <= WINDOW:
        return words, lines, np.array([0, len(words)]), np.array(sizes)
    # The last of the least ones in each window: there is a cut in every WINDOW words.
    back = np.lib.stride_tricks.sliding_window_view(pair, WINDOW)[:, ::-1].argmin(axis=1)
    ends = np.arange(len(back)) + WINDOW - back
    stretches = np.unique(np.r_[0, ends, len(words)])
    return words, lines, stretches, np.array(sizes)


def units(text: str, line_words: int = LINE_WORDS) -> tuple[list[bytes], list[int]]:
    """Digests and places of all units; lines have the places -1, -2, ..., stretches 0, 1, ..."""
    words, lines, stretches, sizes = cuts(text)
    if not words:
        return [], []
    coded = [utf8(w) for w in words]
    whole = b" ".join(coded)
    at = np.r_[0, np.cumsum([len(w) + 1 for w in coded])]
    digest = xxhash.xxh3_128_digest
    long_lines = np.flatnonzero(sizes >= line_words)
    found = [digest(whole[a:b], 1) for a, b in zip(at[lines[long_lines]].tolist(),
                                                   (at[lines[long_lines + 1]] - 1).tolist())]
    edges = at[stretches].tolist()
    found += [digest(whole[a:b - 1], 2) for a, b in zip(edges, edges[1:])]
    return found, [*(-1 - long_lines).tolist(), *range(len(stretches) - 1)]


def spans(text: str, repeated: set[int], run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """(start, length) to remove, merged and in order, given the places of repeated units."""
    words, lines, stretches, _ = cuts(text)
    found = []
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    if any(p < 0 for p in repeated):
        at = 0
        for i, line in enumerate(text.split("\n")):
            end = min(at + len(line) + 1, len(text))
            if -1 - i in repeated:
                found.append((at, end))
            at = end
    run = None
    for p in [*sorted(p for p in repeated if p >= 0), None]:
        if run and p == run[1] + 1:
            run = (run[0], p)
            continue
        if run:
            a, b = stretches[run[0]], stretches[run[1] + 1]
            if b - a >= run_words:
                found.append((starts[a], starts[b]))
        run = None if p is None else (p, p)
    merged = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, b - a) for a, b in merged if b > a]


def without(text: str, gone: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, length in gone:
        kept.append(text[at:start])
        at = start + length
    return "".join([*kept, text[at:]])


_UNITS = "high long, low long, doc_id long, code long"
_REMEMBERED = 100_000
_SMALL = 100_000


def _along(place: np.ndarray) -> np.ndarray:
    """What places are ordered by: the line's or the stretch's number."""
    return np.where(place < 0, -1 - place, place)


def _with_hash(docs: DataFrame) -> DataFrame:
    """(row, _id, _text, _hash): ``_hash`` tells the texts of one ``doc_id`` apart.

    It is 0 where a ``doc_id`` has one text only, so that it costs nothing in the shuffle, else
    31 bits of the text's hash. Of each ``doc_id`` only the least and largest hash are compared;
    the ids with several texts are written and counted, few are broadcast, more are joined.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"),
                       F.col("text").cast("string").alias("_text"))
    whole = F.xxhash64("_text")
    several = rows.where("_id is not null").groupBy("_id").agg(
        F.min(whole).alias("a"), F.max(whole).alias("b")).where("a <> b").select(
        F.col("_id").alias("_several"))
    several = cut_lineage(several, "repeats-ids")
    count = several.count()
    if not count:
        return rows.withColumn("_hash", F.lit(0).cast("long"))
    several = F.broadcast(several) if count <= _SMALL else several
    return rows.join(several, F.col("_id") == F.col("_several"), "left").withColumn(
        "_hash", F.when(F.col("_several").isNull(), 0).otherwise(
            whole.bitwiseAND(F.lit((1 << 31) - 1)))).drop("_several")


class _Earliest:
    """First occurrences, so far in a task, of digests that repeat within a batch."""

    def __init__(self):
        self.of: dict[bytes, tuple] = {}
        self.high = np.zeros(0, np.int64)

    def later(self, digests: np.ndarray, at: tuple, first: np.ndarray, busy: np.ndarray
              ) -> np.ndarray:
        """Which of the batch's first occurrences come after one that was sent already.

        ``at`` are the doc_id, text hash and order of all rows, ``first`` the places of first
        occurrences and ``busy`` which of those repeat in the batch.
        """
        out = np.zeros(len(first), bool)
        look = np.flatnonzero(busy | np.isin(digests[first, 0], self.high))
        for i, row in zip(look.tolist(), first[look].tolist()):
            key, own = digests[row].tobytes(), tuple(int(x[row]) for x in at)
            if key not in self.of:
                if busy[i] and len(self.of) < _REMEMBERED:
                    self.of[key] = own
            elif own > self.of[key]:
                out[i] = True
            else:
                self.of[key] = own
        if len(self.of) > len(self.high):
            self.high = np.sort(np.frombuffer(b"".join(self.of), np.int64)[::2])
        return out


def repeated_units(docs: DataFrame, line_words: int = LINE_WORDS) -> DataFrame:
    return _repeated_units(_with_hash(docs), line_words)


def _repeated_units(rows: DataFrame, line_words: int) -> DataFrame:
    """(doc_id, hash, place) of every unit that is not its digest's first occurrence.

    ``code`` holds place (32 bits), text hash (31) and whether an earlier occurrence is known.
    """
    schema = arrow_schema(_UNITS)

    def cut(batches):
        earliest = _Earliest()
        for batch in in_groups(batches, "text", _BATCH_BYTES):
            digests, owners, texts, places = [], [], [], []
            for doc_id, text, own in zip(*(batch.column(c).to_pylist()
                                           for c in ("doc_id", "text", "hash"))):
                found, at = units(text, line_words)
                digests += found
                places += at
                owners.append(np.full(len(at), doc_id, np.int64))
                texts.append(np.full(len(at), own, np.int64))
            if not digests:
                continue
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            owner, text, place = np.concatenate(owners), np.concatenate(texts), np.array(
                places, np.int64)
            order = np.lexsort((_along(place), text, owner, pair[:, 1], pair[:, 0]))
            pair, owner, text, place = pair[order], owner[order], text[order], place[order]
            again = np.r_[False, (pair[1:] == pair[:-1]).all(axis=1)]
            # A repeated row is the same document, and no repeat.
            same = np.r_[False, (owner[1:] == owner[:-1]) & (text[1:] == text[:-1])
                         & (place[1:] == place[:-1])] & again
            lead = np.maximum.accumulate(np.where(~again, np.arange(len(again)), 0))
            again &= (owner != owner[lead]) | (text != text[lead]) | (place != place[lead])
            first = np.flatnonzero(lead == np.arange(len(lead)))
            busy = np.add.reduceat(again, first) > 0
            again[first] = earliest.later(pair, (owner, text, _along(place)), first, busy)
            pair = pair.copy()
            pair[again] = np.column_stack([mix64(owner[again]).view(np.int64), place[again]])
            keep = ~same
            code = (place << 32) | (text << 1) | again
            yield record(schema, pair[keep, 0], pair[keep, 1], owner[keep], code[keep])

    rows = rows.where(F.col("_id").isNotNull() & (F.length("_text") > 0)).select(
        F.col("_id").alias("doc_id"), F.col("_text").alias("text"),
        F.col("_hash").alias("hash")).mapInArrow(cut, _UNITS)
    place = F.shiftright("code", 32)
    rows = rows.select("high", "low", "doc_id", "code", F.expr("(code & 1) = 1").alias("again"))
    order = [F.col("doc_id"), F.expr("(code >> 1) & 2147483647"),
             F.when(place < 0, -1 - place).otherwise(place)]
    ranked = rows.withColumn("rank", F.dense_rank().over(
        Window.partitionBy("high", "low").orderBy(*order)))
    return ranked.where("again or rank > 1").select(
        "doc_id", F.expr("(code >> 1) & 2147483647").alias("hash"),
        F.expr("cast(code >> 32 as int)").alias("place"))


def remove_repeats(docs: DataFrame, line_words: int = LINE_WORDS,
                   run_words: int = RUN_WORDS) -> DataFrame:
    """(row, text, removed): rows whole, the text without repeats, and what went, by offset."""
    rows = _with_hash(docs)
    places = _repeated_units(rows, line_words).groupBy("doc_id", "hash").agg(
        F.collect_set("place").alias("places"))
    joined = rows.drop("_text").join(places.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"),
                                     "places"), ["_id", "_hash"], "left").select("row", "places")
    kind = StructType([StructField("row", docs.schema, False), *StructType.fromDDL(
        "text string, removed array<struct<start: int, length: int>>")])
    schema = to_arrow_schema(kind)

    def rewrite(batches):
        for batch in batches:
            texts = pc.struct_field(batch.column(0), "text").to_pylist()
            gone = [[] if not p or not t else spans(t, set(p), run_words)
                    for t, p in zip(texts, batch.column(1).to_pylist())]
            yield record(schema, batch.column(0),
                         [without(t, g) if g else t for t, g in zip(texts, gone)],
                         [[{"start": a, "length": n} for a, n in g] for g in gone])

    return joined.mapInArrow(rewrite, kind)


def keep_first_passages(docs: DataFrame) -> DataFrame:
    """The documents with their repeated passages removed; ``n_chars`` follows the text."""
    out = remove_repeats(docs)
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[F.coalesce(own[c], F.col(f"row.{c}")).alias(c)
                        if c in own else F.col(f"row.{c}").alias(c) for c in docs.columns])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("row.doc_id", "text", "removed",
                      F.expr("aggregate(removed, 0L, (n, s) -> n + s.length)").alias("n_removed"))
