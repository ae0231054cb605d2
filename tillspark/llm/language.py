"""Language identification with hyperdimensional profiles.

Every letter has a random ±1 vector. The vector of a letter trigram binds (multiplies) the
letters' vectors, each permuted by its place; a document bundles (adds) the vectors of all its
trigrams; a language bundles its documents, each scaled to length one. A document gets the
language whose prototype has the largest cosine with it.

Edge cases: a null text, an empty one and one without a letter get ``und`` with score 0; so does
everything when nothing can be learned. A null ``doc_id`` is never learned from and is not held
out. Equal cosines take the language first in binary order. Other columns pass through unused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillspark.llm.common import (annotate, arrow_schema, code_points, in_groups, mix64,
                                  record, table, texts_of)
from tillspark.session import cut_lineage

DIMENSIONS = 1024
DOCS_PER_LANGUAGE = 4_000
SMALL_LANGUAGES = 5_000
MIN_SCORE = 0.05
_SYMBOLS = 1 << 10
_CACHED_GRAMS = 16_384
_SLICE = 4_096
_HELD_SUMS = 2_000


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


class Profiles:
    """Document vectors.

    Holds the trigram vectors met so far in a table of whole numbers of one byte, which is
    allocated once (16 MiB at the defaults) and starts anew when full.
    """

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 11):
        self.dimensions = dimensions
        rng = np.random.default_rng(seed)
        letters = rng.integers(0, 2, (_SYMBOLS, dimensions), dtype=np.int8) * 2 - 1
        self.first, self.second, self.third = (np.roll(letters, k, axis=1) for k in (2, 1, 0))
        self.symbol = np.zeros(0x110000, np.uint16)
        chars = np.arange(0x110000)
        letter = np.fromiter((chr(c).isalpha() for c in chars), bool, len(chars))
        # Latin letters keep a symbol of their own, other scripts share hashed ones.
        spread = 640 + (mix64(chars) % np.uint64(_SYMBOLS - 640)).astype(np.int64)
        self.symbol[letter] = np.where(chars < 640, chars, spread)[letter]
        self.keys = np.zeros(0, np.int64)  # sorted, with each one's row of the table
        self.rows = np.zeros(0, np.int64)
        self.vectors = np.zeros((_CACHED_GRAMS, dimensions), np.int8)

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, trigram, count) over all texts; each run of other signs is one blank."""
        parts = [self.symbol[code_points(t.lower())] for t in texts]
        owner = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
        flat = np.concatenate([np.r_[p, np.uint16(0)] for p in parts]).astype(np.int64)
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0) | (owner[1:] != owner[:-1])
        flat, owner = flat[keep], owner[keep]
        lead = np.r_[True, owner[1:] != owner[:-1]]
        before = np.where(lead, 0, np.r_[0, flat[:-1]])
        second = np.r_[True, lead[:-1]]
        earlier = np.where(lead | second, 0, np.r_[0, 0, flat][:len(flat)])
        code = (earlier * _SYMBOLS + before) * _SYMBOLS + flat
        some = (flat != 0) | (before != 0)
        key, count = np.unique(owner[some] * (_SYMBOLS ** 3) + code[some], return_counts=True)
        return key // _SYMBOLS ** 3, key % _SYMBOLS ** 3, count

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Rows of ``vectors``, which get the trigrams that are new; at most ``_SLICE`` grams."""
        distinct, inverse = np.unique(grams, return_inverse=True)
        if len(self.keys) + len(distinct) > _CACHED_GRAMS:
            self.keys, self.rows = self.keys[:0], self.rows[:0]
        fresh = distinct[~np.isin(distinct, self.keys, assume_unique=True)]
        if len(fresh):
            used = len(self.keys)
            self.vectors[used:used + len(fresh)] = (
                self.first[fresh // _SYMBOLS ** 2] * self.second[fresh // _SYMBOLS % _SYMBOLS]
                * self.third[fresh % _SYMBOLS])
            keys = np.concatenate([self.keys, fresh])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.rows = np.concatenate([self.rows, np.arange(used, len(keys))])[order]
        return self.rows[np.searchsorted(self.keys, distinct)[inverse]]

    def documents(self, texts: list[str]) -> np.ndarray:
        """One unit vector for each text, zero where it has no letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        owner, gram, count = self.grams(texts)
        weight = count.astype(np.float32)
        for at in range(0, len(owner), _SLICE):
            own, place = owner[at:at + _SLICE], self.places(gram[at:at + _SLICE])
            edges = np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(own)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                out[own[a]] += weight[at + a:at + b] @ self.vectors[place[a:b]].astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


_VECTORS = "lang string, vector binary"


def _sum_vectors(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v, np.float64) for v in rows["vector"].to_pylist()], axis=0)
    return pa.table({"lang": [rows["lang"][0].as_py()], "vector": [total.tobytes()]})


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS,
               docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(lang, vector binary): each language's sum of document vectors.

    Learned from the rows that are not held out and have a language. Of a language with more
    than about ``docs_per_language`` rows a hashed share of that size is taken. Vectors are
    summed in each task, then over 64 slots, then for each language: a task never holds more
    than its share.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
                       & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", "lang", "text")
    sizes = cut_lineage(known.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    if sizes.count() <= SMALL_LANGUAGES:  # more of them are joined by language
        sizes = F.broadcast(sizes)
    rate = F.lit(docs_per_language) / F.col("rows")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = known.join(sizes, "lang").where(draw < rate)

    schema = arrow_schema(_VECTORS)

    def bundle(batches):
        profiles, sums = Profiles(dimensions), {}
        for batch in in_groups(batches, "text"):
            vectors = profiles.documents(texts_of(batch, "text"))
            names = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(names):
                sums[lang] = sums.get(lang, 0) + vectors[names == lang].sum(0, np.float64)
            if len(sums) > _HELD_SUMS:
                yield record(schema, list(sums), [v.tobytes() for v in sums.values()])
                sums = {}
        yield record(schema, list(sums), [v.tobytes() for v in sums.values()])

    partial = sample.select("lang", "text").mapInArrow(bundle, _VECTORS)
    partial = partial.withColumn("slot", F.pmod(F.xxhash64("vector"), F.lit(64)))
    partial = partial.groupBy("lang", "slot").applyInArrow(_sum_vectors, _VECTORS)
    return partial.groupBy("lang").applyInArrow(_sum_vectors, _VECTORS)


def _unit_rows(rows: list) -> tuple[list[str], np.ndarray]:
    """Languages in binary order and their unit vectors."""
    rows = sorted(rows, key=lambda r: r["lang"])
    matrix = np.array([np.frombuffer(r["vector"], np.float64) for r in rows])
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return [r["lang"] for r in rows], np.divide(
        matrix, norm, out=np.zeros_like(matrix), where=norm > 0).astype(np.float32)


def identify(docs: DataFrame, dimensions: int = DIMENSIONS,
             docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(row, lang_pred, score): every row whole, its language and the cosine, 0 to 1.

    Up to ``SMALL_LANGUAGES`` prototypes sit in every task; more of them pass over the documents
    in hashed blocks of about that size, and the best cosine of all blocks decides.
    """
    learned = cut_lineage(prototypes(docs, dimensions, docs_per_language), "prototypes")
    blocks = max(1, -(-learned.count() // SMALL_LANGUAGES))
    block = F.pmod(F.xxhash64("lang"), F.lit(blocks))
    found = docs.select(F.struct("*").alias("row"), F.lit(None).cast("string").alias("lang_pred"),
                        F.lit(None).cast("double").alias("score"))
    for b in range(blocks):
        names, matrix = _unit_rows(learned.where(block == b).collect() or
                                   [{"lang": "", "vector": bytes(8 * dimensions)}])
        found = _best_of(found if b == 0 else cut_lineage(found, "languages-found"), names,
                         matrix, dimensions)
    return found.select("row", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"),
                        F.when(F.col("lang_pred").isNull(), 0.0).otherwise(
                            F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).alias("score"))


def _best_of(found: DataFrame, names: list[str], matrix: np.ndarray, dimensions: int) -> DataFrame:
    """``found`` (row, lang_pred, score) with the best of ``names`` where it is better."""
    texts = found.withColumn("text", F.col("row.text").cast("string"))

    def begin():
        profiles = Profiles(dimensions)

        def work(batch):
            vectors = profiles.documents(texts_of(batch, "text"))
            cosine = vectors @ matrix.T
            best, some = cosine.argmax(axis=1), vectors.any(axis=1)
            lang, score = (batch.column(c).to_pylist() for c in ("lang_pred", "score"))
            for i in np.flatnonzero(some).tolist():
                new = float(cosine[i, best[i]]), names[best[i]]
                if new[1] and (lang[i] is None or new[0] > score[i]
                               or new[0] == score[i] and new[1] < lang[i]):
                    score[i], lang[i] = new
            return lang, score
        return work

    return annotate(texts, "text", begin, "best string, cosine double").select(
        "row.row", F.col("best").alias("lang_pred"), F.col("cosine").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that read as some language at all."""
    found = identify(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return found.select("row.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
