"""Ranked lexical search over bags of words, each distinct bag scored once.

A document matters to a set of items only through the counts of the items' terms in it and its
length class ``m``. So every document is cut down to that bag; documents with equal bags and
equal ``m`` form a class, found by hash and verified by comparing the bags themselves. Of a class
the first ``k`` documents by ``doc_id`` are kept, because of equally scored documents no item can
rank more. Classes are scored once, in blocks inside tasks, against all items through postings
(a term's items), and a class's members are put in place of it by ascending ``doc_id``.

Counts and statistics cover all documents. Items go in blocks of bounded text, so that a block's
vocabulary may sit in every task; each block sees all documents. A class that a third of all
documents belong to costs at most ``k`` rows for each task, before anything is shuffled.

Edge cases: null and empty texts, and texts without a term, count in no statistic and rank
nowhere. Items without a term, or whose terms stand in no document, have no rows. Every row of
the items is an item of its own and every row of the documents a document, repeated rows as well.
Documents with a null ``doc_id`` come last among equals. Empty tables give an empty result. Only
``item_id``, ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillspark.llm.common import arrow_schema, in_groups, record, table, texts_of, utf8
from tillspark.session import cut_lineage

TOP = 10
ITEM_BYTES = 8_000_000
BLOCK_CELLS = 1_000_000
_EXACT = 2 ** 53
# Signs that are no part of a term become blanks; A-Z are folded; bytes from 0x80 on stay.
_FOLD = bytes(32 if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b
              for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return utf8(text).translate(_FOLD).split()


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, bag) of every document with a term.

    ``n`` counts all of its terms; ``bag`` holds (number, count) pairs of the terms that are in
    ``vocabulary``, by number, as little-endian unsigned 32-bit integers.
    """
    output = "doc_id long, n long, bag binary"
    schema = arrow_schema(output)

    def cut(batches):
        number = {t: i for i, t in enumerate(vocabulary)}
        for batch in in_groups(batches, "text"):
            sizes, found = [], []
            for text in texts_of(batch, "text"):
                words = terms(text)
                counts = Counter(words)
                pairs = sorted((number[t], c) for t, c in counts.items() if t in number)
                sizes.append(len(words))
                found.append(np.array(pairs, "<u4").tobytes())
            yield record(schema, batch.column("doc_id"), sizes, found)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, output).where("n > 0")


def _pairs(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, count) of all bags of a column."""
    rows = column.to_pylist()
    flat = np.frombuffer(b"".join(rows), "<u4").reshape(-1, 2)
    owner = np.repeat(np.arange(len(rows)), np.fromiter(map(len, rows), np.int64, len(rows)) // 8)
    return owner, flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64)


def holders(stored: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""
    schema = arrow_schema("term int, df long")

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_pairs(batch.column("bag"))[1], minlength=size)
        some = np.flatnonzero(total)
        yield record(schema, some.astype(np.int32), total[some])

    found = stored.select("bag").mapInArrow(count, "term int, df long").groupBy("term").agg(
        F.sum("df").alias("df")).collect()  # a row for each term of the items at most
    out = np.zeros(size, np.int64)
    for r in found:
        out[r["term"]] = r["df"]
    return out


def classes(stored: DataFrame, k: int) -> DataFrame:
    """(bag, m, members array<struct<doc_id>>) of each class of equal bags and ``m``.

    Rows meet by hash and are told apart by the bag itself. Members ascend, nulls last; the
    ranking cuts a class to ``k`` rows in every task before the shuffle.
    """
    hashed = stored.select("doc_id", "m", "bag", F.xxhash64("bag").alias("hash"))
    own = Window.partitionBy("hash", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    first = hashed.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k)
    return first.groupBy("hash", "m", "bag").agg(F.array_sort(F.collect_list(
        F.struct("place", "doc_id"))).alias("members")).select(
        "bag", "m", F.transform("members", lambda x: F.struct(x["doc_id"])).alias("members"))


def best_classes(rows: DataFrame, weights: np.ndarray, postings: tuple[np.ndarray, np.ndarray],
                 items: int, k: int) -> DataFrame:
    """(item, score, members): each item's ``k`` best classes of each task, score above zero.

    Equal scores go by the first member; a class beyond the ``k`` best has no document among
    the item's ``k`` best, since each class before it has one that ranks higher. ``postings``
    are (first place of each term, items): a term's items stand together.
    """
    starts, holding = postings
    per_item = np.bincount(holding, weights=np.repeat(np.abs(weights), np.diff(starts)).astype(
        float), minlength=items)
    exact = not len(per_item) or per_item.max() * 1_000_000 < _EXACT  # a term gives w * 10^6
    output = "item int, score long, members array<struct<doc_id: long>>"
    schema = arrow_schema(output)
    block = max(1, BLOCK_CELLS // max(items, 1))

    def score(batches):
        kept: list = [np.zeros(0, np.int64)] * 4  # item, score, first, place in ``names``
        names: list = []
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                owner, term, count = _pairs(batch.column("bag"))
                m = batch.column("m").to_numpy().astype(np.int64)
                gain = weights[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[owner]))
                often = np.diff(starts)[term]
                place = np.arange(int(often.sum())) + np.repeat(
                    starts[:-1][term] - (np.cumsum(often) - often), often)
                cell = np.repeat(owner * items, often) + holding[place]
                size = batch.num_rows * items
                if exact:
                    total = np.bincount(cell, np.repeat(gain, often).astype(float), size).astype(
                        np.int64)
                else:
                    total = np.zeros(size, np.int64)
                    np.add.at(total, cell, np.repeat(gain, often))
                members = batch.column("members").to_pylist()
                first = np.array([x[0]["doc_id"] if x[0]["doc_id"] is not None
                                  else np.iinfo(np.int64).max for x in members], np.int64)
                hit = np.flatnonzero(total > 0)
                item, row = hit % items, hit // items
                if len(kept[0]):  # only what may enter an item's list
                    low = np.zeros(items, np.int64)
                    full = np.bincount(kept[0], minlength=items) >= k
                    worst = np.full(items, np.iinfo(np.int64).max)
                    np.minimum.at(worst, kept[0], kept[1])
                    low[full] = worst[full]
                    some = total[hit] >= low[item]
                    hit, item, row = hit[some], item[some], row[some]
                new = [item, total[hit], first[row], row + len(names)]
                kept = [np.r_[a, b] for a, b in zip(kept, new)]
                order = np.lexsort((kept[2], -kept[1], kept[0]))
                kept = [c[order] for c in kept]
                lead = np.r_[True, kept[0][1:] != kept[0][:-1]] if len(order) else order == 0
                rank = np.arange(len(order)) - np.maximum.accumulate(
                    np.where(lead, np.arange(len(order)), 0)) if len(order) else order
                kept = [c[rank < k] for c in kept]
                names += members
                used, place = np.unique(kept[3], return_inverse=True)
                names, kept[3] = [names[i] for i in used], place
        if len(kept[0]):
            yield record(schema, kept[0].astype(np.int32), kept[1], [names[i] for i in kept[3]])

    return rows.mapInArrow(score, output)


def _search(stored: DataFrame, totals: tuple[int, int], block: list, vocabulary: list[bytes],
            of_items: list[list[int]], k: int) -> DataFrame:
    documents, length = totals
    df = holders(stored, len(vocabulary))
    weights = np.array([weight(documents, int(n)) for n in df], np.int64)
    pairs = sorted((t, i) for i, own in enumerate(of_items) for t in own)
    of_terms = np.array([p[0] for p in pairs], np.int64)
    starts = np.searchsorted(of_terms, np.arange(len(vocabulary) + 1))
    holding = np.array([p[1] for p in pairs], np.int64)
    m = F.lit(10) + F.expr(f"(90L * n * {documents}L) div {length}L")
    usable = stored.where(F.length("bag") > 0).withColumn("m", m)
    found = best_classes(classes(usable, k), weights, (starts, holding), len(block), k)
    top = Window.partitionBy("item").orderBy(
        F.desc("score"), F.asc_nulls_last(F.col("members")[0]["doc_id"]))
    found = found.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k)
    members = found.select("item", "score", F.inline("members"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    spark = stored.sparkSession
    ids = F.broadcast(spark.createDataFrame(  # of one block of items, bounded by its text
        [(i, r["item_id"]) for i, r in enumerate(block)], "item int, item_id long"))
    return ranked.join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"),
                                           "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES
           ) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(
        "text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // item_bytes)
    dealt = cut_lineage(items.withColumn("block", F.pmod(
        F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))), "lexical-items")
    result, totals = None, None
    for b in range(blocks):
        block = sorted(dealt.where(F.col("block") == b).select("item_id", "text").collect(),
                       key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        own = [set(terms(r["text"])) for r in block]
        vocabulary = sorted(set().union(*own))
        number = {t: i for i, t in enumerate(vocabulary)}
        stored = cut_lineage(bags(docs, vocabulary), "lexical-bags")
        if totals is None:
            totals = tuple(stored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first())
        if not totals[0] or not vocabulary:
            continue
        part = _search(stored, totals, block, vocabulary,
                       [sorted(number[t] for t in x) for x in own], k)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return result


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              "'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS terms FROM documents),
long AS (SELECT r, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
stat AS (SELECT CAST(count(*) AS BIGINT) AS c, CAST(sum(n) AS BIGINT) AS l FROM long),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf
       FROM (SELECT r, unnest(terms) AS term FROM long) GROUP BY r, term),
i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS_SQL} AS terms FROM benchmark),
it AS (SELECT DISTINCT item, item_id, term
       FROM (SELECT item, item_id, unnest(terms) AS term FROM i)),
w AS (SELECT term, CAST(floor(1000 * ln((2 * c + 2) / CAST(2 * count(*) + 1 AS DOUBLE)))
                        AS BIGINT) AS w
      FROM tf, stat GROUP BY term, c),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * n * c) // l) AS m FROM long, stat),
s AS (SELECT it.item, it.item_id, m.doc_id, m.r,
             CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
      FROM it JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r)
      GROUP BY it.item, it.item_id, m.doc_id, m.r),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item
                     ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
           FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
