"""Vector codes and neighbour search against plain versions, with their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillspark.llm import codes, neighbours, vectors

ROW = "vec_id long, embedding array<float>, label int"


def whole(vector, width=None):
    """Whole numbers of a vector that takes part, else None."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    found = [math.floor(256 * float(np.float32(x))) for x in vector]
    return found + [0] * ((width or len(found)) - len(found))


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """[(vec_id, code, error, label_error)] and the codebooks, entry by entry."""
    kept = [(r[0], r[2], whole(r[1])) for r in rows if whole(r[1]) is not None]
    width = max(1, -(-max(len(v) for _, _, v in kept) // parts))
    kept = [(i, label, v + [0] * (parts * width - len(v))) for i, label, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    cut = lambda v, j: v[j * width:(j + 1) * width]
    book = [[cut(v, j) for _, _, v in first] for j in range(parts)]

    def nearest(part, j):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book[j]))

    for _ in range(rounds):
        for j in range(parts):
            own = [[] for _ in book[j]]
            for _, _, v in kept:
                own[nearest(cut(v, j), j)[1]].append(cut(v, j))
            book[j] = [[sum(c) // len(x) for c in zip(*x)] if x else e
                       for x, e in zip(own, book[j])]
    out, by_label = [], {}
    for i, label, v in kept:
        found = [nearest(cut(v, j), j) for j in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append([i, "".join(f"{k:02x}" for _, k in found), error, label])
    return [(i, c, e, by_label[label]) for i, c, e, label in out], book


def plain_search(rows, every, k):
    kept = [(r[0], tuple(whole(r[1]))) for r in rows
            if r[0] is not None and whole(r[1]) is not None]
    out = []
    for query, v in sorted({(i, v) for i, v in kept if i % every == 0}):
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in kept if j != query)
        out += [(query, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def some_rows(seed, count, width, groups=None):
    """Random rows with nulls, bad components, ties and repeated rows among them."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.2, (groups or 1, width))
    rows = []
    for i in range(count):
        v = (centre[i % len(centre)] + rng.normal(0, 0.02 if groups else 0.2, width)).round(2)
        rows.append([i, [float(np.float32(x)) for x in v], [None, 1, 2, 3][i % 4]])
    for i in range(0, count // 4):
        rows[count - 1 - i][1] = rows[0][1]  # one vector of a quarter of all rows
    rows[3][1], rows[4][1] = None, [*rows[4][1][:-1], None]
    rows[6][1] = [float("nan"), *rows[6][1][1:]]
    rows[7][1] = [float("-inf"), *rows[7][1][1:]]
    rows[8][1] = [0.0] * width
    rows.append([*rows[10]])
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed, width", [(1, 16), (3, 50)])
def test_codes_equal_the_plain_version(spark, seed, width):
    rows = some_rows(seed, 220, width)
    rows += [(None, rows[1][1], 2), (500, rows[2][1][:5], None), (501, [], 9)]
    df = spark.createDataFrame(rows, ROW).repartition(3)
    coded, book = codes.train_and_code(df)
    got = codes.with_label_error(coded).select(
        "vec_id", F.lower(F.hex("codes")), "error", "label_error").collect()
    want, plain = plain_codes(rows)
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert codes.books_text(book) == ",".join(str(x) for j in plain for e in j for x in e)


def test_pivots_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    for scale in (3, 100, 1_000_000):  # many equal distances, then large ones
        cut = rng.integers(-scale, scale + 1, (3_000, 2, 4))
        book = rng.integers(-scale, scale + 1, (2, 64, 4))
        pivots = codes.choose_pivots(book)
        index, square, tried = codes.assign(cut, codes.pivot_distances(cut, pivots), book, pivots)
        all_of_them = ((cut[:, :, None] - book[None]) ** 2).sum(-1)
        assert (index == all_of_them.argmin(-1)).all()
        assert (square == all_of_them.min(-1)).all()
        assert tried < 0.4 * all_of_them.size


def test_more_labels_than_are_broadcast(spark, monkeypatch):
    rows = some_rows(4, 100, 16)
    coded, _ = codes.train_and_code(spark.createDataFrame(rows, ROW))
    few = sorted(map(tuple, codes.with_label_error(coded).drop("codes").collect()))
    monkeypatch.setattr(codes, "SMALL_LABELS", 0)
    assert sorted(map(tuple, codes.with_label_error(coded).drop("codes").collect())) == few


def test_codes_of_no_rows_and_of_other_columns(spark):
    none = spark.createDataFrame([(1, None, 2)], ROW)
    assert codes.train_and_code(none)[0].count() == 0
    rows = [(i, [i / 8] * 16, i) for i in range(5)]
    plain = codes.train_and_code(spark.createDataFrame(rows, ROW))[0]
    more = spark.createDataFrame(rows, ROW)
    for name in ("ints", "vector", "far", "codes", "error", "_label", "slot"):
        more = more.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, codes.train_and_code(more)[0].collect())) == sorted(
        map(tuple, plain.collect()))


@pytest.mark.parametrize("seed, groups, k", [(1, None, 5), (4, 12, 400)])
def test_neighbours_equal_all_pairs(spark, seed, groups, k):
    rows = some_rows(seed, 240, 8, groups) + [(None, [0.5] * 8, 1)]
    df = spark.createDataFrame(rows, ROW).repartition(3)
    for extra in ({}, {"pivots": 5, "group_queries": 7, "slice_rows": 50}):
        got = neighbours.top_products(df, F.col("vec_id") % 5 == 0, k, **extra)
        assert sorted(map(tuple, got.collect())) == plain_search(rows, 5, k)


def test_neighbours_of_uneven_vectors(spark):
    rows = [(i, [0.1 * (i % 7)] * (i % 5), 0) for i in range(60)]
    df = spark.createDataFrame(rows, ROW)
    got = neighbours.top_products(df, F.col("vec_id") % 5 == 1)
    kept = [(i, whole(v, 4)) for i, v, _ in rows]
    want = []
    for i, v in kept:
        if i % 5 == 1:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in kept if j != i)
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:5])]
    assert sorted(map(tuple, got.collect())) == want


def test_a_vector_of_most_rows_and_all_zeros(spark):
    same = [(i, [0.25, -0.5], 0) for i in range(300)]
    zeros = [(i, [0.0, 0.0], 0) for i in range(300)]
    for rows in (same, zeros):
        got = neighbours.top_products(spark.createDataFrame(rows, ROW), F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, got.collect())) == plain_search(rows, 50, 5)


def test_neighbours_of_no_rows_and_of_other_columns(spark):
    assert neighbours.top_products(spark.createDataFrame([], ROW), F.lit(True)).count() == 0
    one = spark.createDataFrame([(50, [1.0], 1)], ROW)
    assert neighbours.top_products(one, F.col("vec_id") % 50 == 0).count() == 0
    rows = some_rows(6, 100, 4)
    more = spark.createDataFrame(rows, ROW)
    for name in ("ints", "vector", "cell", "angle", "floor", "group", "slice", "key", "deal"):
        more = more.withColumn(name, F.lit("x"))
    got = neighbours.top_products(more, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == plain_search(rows, 50, 5)


def test_bounds_leave_rows_out_of_groups_and_products():
    rng = np.random.default_rng(7)
    centre = rng.normal(0, 200, (20, 16))
    rows = np.rint(np.repeat(centre, 100, axis=0) + rng.normal(0, 5, (2_000, 16))).astype(np.int64)
    ids = rng.permutation(2_000)
    square = int((rows ** 2).sum(1).max())
    space = neighbours.Space(rows[::100], square)
    angle = space.of_data(rows)
    cell = angle.argmin(1)
    own, own_ids = rows[:40], ids[:40]
    lowest = np.full(40, np.iinfo(np.int64).min)
    query, score, hit, done = neighbours.local_best(
        own, own_ids, lowest, rows, ids, cell, angle.min(1), space, square, 5)
    assert done < 0.3 * 40 * 2_000
    exact = own @ rows.T
    for q in range(40):
        order = [i for i in np.lexsort((ids, -exact[q])) if ids[i] != own_ids[q]][:5]
        assert hit[query == q].tolist() == ids[order].tolist()
        assert score[query == q].tolist() == exact[q][order].tolist()


def test_vectors_too_long_are_refused(spark):
    rows = spark.createDataFrame([(1, [3e38] * 4, 1)], ROW)
    with pytest.raises(Exception):
        vectors.shape(vectors.whole_numbers(rows, "embedding"))
