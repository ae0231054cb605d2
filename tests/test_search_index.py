import random
from datetime import datetime

import pytest

from tillspark.operators import archive
from tillspark.session import work_dir
from tillspark.sources import search_index

NOW = datetime(2026, 7, 14, 12)
RECEIPT = ("id string, merchantNormalized string, merchantRaw string, categoryId string, "
           "transactionDate string")
ITEM = "receiptId string, normalizedName string, rawName string"


def shop(spark, seed):
    rnd = random.Random(seed)

    def word():
        return "".join(rnd.choice("abcÀé ") for _ in range(rnd.randrange(0, 9)))

    receipts = [(f"r{n}", rnd.choice([None, "", word()]), word(), "other", None)
                for n in range(60)]
    items = [(f"r{rnd.randrange(70)}", word(), word()) for _ in range(150)]
    items += [("r1", None, "abc"), (None, "abc", "abc"), ("r2", "cab" * 5000, "")]
    return spark.createDataFrame(receipts, RECEIPT), spark.createDataFrame(items, ITEM)


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_index_equals_the_scan(spark, share):
    receipts, items = shop(spark, 7)
    root = work_dir(spark, "index")
    search_index.build(receipts, items, root, share)
    for query in ("", "a", "ab", "abc", " ABC ", "cabcab", "À", "àé", "bca b", "zzz", "ab%c"):
        want = archive.search(receipts, items, NOW, query)
        got = search_index.search(receipts, items, root, NOW, query)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()), query


def test_candidates_are_few_and_hot_grams_are_not_posted(spark):
    receipts = spark.createDataFrame(
        [(f"r{n}", "common", f"only{n:04d}", "other", None) for n in range(500)], RECEIPT)
    items = spark.createDataFrame([], ITEM)
    root = work_dir(spark, "index")
    search_index.build(receipts, items, root, 0.5)
    assert search_index.candidates(spark, root, "common") is None
    assert search_index.candidates(spark, root, "ab") is None
    found = search_index.candidates(spark, root, "common only0123")
    assert 1 <= found.count() <= 20
    posted = spark.read.parquet(f"{root}/postings")
    assert posted.where("gram = 'com'").isEmpty()
    assert search_index.candidates(spark, root, "nowhere").count() == 0


def test_empty_tables(spark):
    receipts, items = spark.createDataFrame([], RECEIPT), spark.createDataFrame([], ITEM)
    root = work_dir(spark, "index")
    search_index.build(receipts, items, root)
    assert search_index.search(receipts, items, root, NOW, "abc").count() == 0


def test_a_text_of_many_receipts_is_cut_into_grams_once(spark):
    """Postings grow with the distinct texts; a query's grams must lie in one text."""
    receipts = spark.createDataFrame(
        [(f"r{n}", None, "shop", "other", None) for n in range(300)], RECEIPT)
    items = spark.createDataFrame(
        [(f"r{n}", f"thing{n % 3}", "abc" if n % 2 else "xyz") for n in range(300)], ITEM)
    root = work_dir(spark, "index")
    search_index.build(receipts, items, root, 1.0)
    postings = spark.read.parquet(f"{root}/postings")
    assert postings.where("gram = 'ng1'").count() == 2
    assert postings.count() < 100
    found = search_index.candidates(spark, root, "thing1 abc")
    assert {r.id for r in found.collect()} == {f"r{n}" for n in range(1, 300, 6)}
    assert search_index.candidates(spark, root, "shop thing1").count() == 0
