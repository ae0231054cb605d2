"""Ranked lexical search against a plain version, with its edge cases."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillspark.llm import lexical

DOC, ITEM = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    bags = [(i, plain_terms(t)) for i, t in docs]
    bags = [(i, Counter(t), len(t)) for i, t in bags if t]
    total = sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in bags:
            m = 100 - 90 + (90 * n * len(bags)) // total
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(plain_terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        found.sort()
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def a_corpus(seed, count):
    rng = random.Random(seed)
    words = ["Größe", "alpha", "BETA", "ça", "d4", "e-f", "ÄÖ", "日本", "x_y", "it's", "naïve"] + [
        "".join(rng.choice("abcd") for _ in range(3)) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "\n", "\x00", "\x7f"])
                              for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(count)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(count // 2)]  # large groups of copies
    docs += [(2000 + i, docs[5][1].upper() + " !") for i in range(20)]
    docs += [(-5, None), (-6, ""), (-7, " .,\n"), (None, docs[0][1]), docs[2], docs[2]]
    items = [(i, text(rng.randrange(1, 12))) for i in range(30)]
    items += [(77, None), (78, ""), (79, "zzzz not-there"), (None, "alpha beta"), items[0]]
    return docs, items


@pytest.mark.parametrize("seed, item_bytes", [(1, 8_000_000), (2, 700)])
def test_search_equals_the_plain_version(spark, seed, item_bytes):
    docs, items = a_corpus(seed, 120)
    got = lexical.search(spark.createDataFrame(docs, DOC).repartition(4),
                         spark.createDataFrame(items, ITEM), item_bytes=item_bytes)
    assert ordered(got.collect()) == ordered(plain_search(docs, items))


def test_small_blocks_and_whole_numbers(spark, monkeypatch):
    docs, items = a_corpus(4, 80)
    frames = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 1)
    assert ordered(lexical.search(*frames, k=3).collect()) == ordered(
        plain_search(docs, items, 3))
    monkeypatch.setattr(lexical, "_EXACT", 0)
    assert ordered(lexical.search(*frames, k=3).collect()) == ordered(
        plain_search(docs, items, 3))


def test_a_very_long_text_and_a_bag_of_most_documents(spark):
    docs = [(i, "same words in all of them") for i in range(400)]
    docs += [(500, "word " * 300_000 + "once"), (501, "x" * 400_000), (502, "once again")]
    items = [(1, "words once"), (2, "same again"), (3, "x")]
    got = lexical.search(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    assert ordered(got.collect()) == ordered(plain_search(docs, items))


def test_no_rows_and_other_columns(spark):
    docs, items = a_corpus(5, 30)
    frame, asked = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    assert lexical.search(frame.limit(0), asked).count() == 0
    assert lexical.search(frame, asked.limit(0)).count() == 0
    for name in ("n", "bag", "m", "hash", "place", "members", "item", "score", "rank", "block"):
        frame, asked = (x.withColumn(name, F.lit("x")) for x in (frame, asked))
    got = lexical.search(frame.withColumn("item_id", F.lit(1)), asked.withColumn(
        "doc_id", F.lit(2)))
    assert ordered(got.collect()) == ordered(plain_search(docs, items))


def test_equal_bags_of_one_hash_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 7, b"ab"), (2, 7, b"cd"), (3, 8, b"ab"), (4, 7, b"ab")],
                                 "doc_id long, m long, bag binary")
    found = {(bytes(r.bag), r.m, tuple(x.doc_id for x in r.members))
             for r in lexical.classes(rows, 10).collect()}
    assert found == {(b"ab", 7, (1, 4)), (b"cd", 7, (2,)), (b"ab", 8, (3,))}


def test_classes_are_cut_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, 7, b"ab")], "doc_id long, m long, bag binary")
    plan = lexical.classes(rows, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
