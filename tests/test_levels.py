import random

import pytest

from tillspark.operators import replication
from tillspark.session import work_dir
from tillspark.sources import pages
from tillspark.streaming import levels
from tillspark.streaming.levels import Levels

VERSION = ("collection_name string, document_id string, server_sequence long, value string, "
           "created_at string")


def random_log(seed, count=300, documents=60):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["receipts", "receipt_items"]), f"d{rnd.randrange(documents)}", n,
             f"v{n}", f"c{n:05d}") for n in range(1, count + 1)]
    return rows


def newest(rows):
    last, first = {}, {}
    for c, d, n, v, at in sorted(rows, key=lambda r: r[2]):
        last[c, d] = (n, v)
        first.setdefault((c, d), at)
    return {k: (*last[k], first[k]) for k in last}


def collected(df):
    return {(r.collection_name, r.document_id): (r.server_sequence, r.value, r.created_at)
            for r in df.collect()}


def levels_of(spark, **options):
    return Levels(spark, f"{work_dir(spark, 'test')}/levels", VERSION, **options)


def test_batches_in_any_order_keep_newest_and_first(spark):
    rows = random_log(1)
    late = rows[:]
    random.Random(2).shuffle(late)
    kept = levels_of(spark, buckets=3, fanout=2)
    for number in range(9):
        kept.append(spark.createDataFrame(late[number::9], VERSION), number)
        runs = [len(level) for level in kept.manifest()["levels"]]
        assert max(runs) < 2 and len(runs) <= 5
    assert collected(kept.state()) == newest(rows)
    kept.append(spark.createDataFrame(late[:50], VERSION), 8)  # a batch that runs again
    kept.vacuum()
    assert collected(kept.state()) == newest(rows)
    assert sorted(kept.listed("runs")) == sorted(kept.manifest()["bits"])


@pytest.mark.parametrize("step", ["batch", "merge"])
def test_an_end_between_write_and_switch_loses_nothing(spark, monkeypatch, step):
    rows = random_log(3, 120)
    kept = levels_of(spark, buckets=2, fanout=2)
    kept.append(spark.createDataFrame(rows[:60], VERSION), 0)
    publish, calls = Levels.publish, []

    def ends(self, manifest):
        calls.append(manifest["version"])
        if len(calls) == (1 if step == "batch" else 2):
            raise OSError("lost")
        publish(self, manifest)

    monkeypatch.setattr(Levels, "publish", ends)
    with pytest.raises(OSError):
        kept.append(spark.createDataFrame(rows[60:], VERSION), 1)
    assert collected(kept.state()) == newest(rows[:60] if step == "batch" else rows)
    monkeypatch.setattr(Levels, "publish", publish)
    kept.append(spark.createDataFrame(rows[60:], VERSION), 1)
    assert collected(kept.state()) == newest(rows)
    assert sum(map(len, kept.manifest()["levels"])) == 1


def test_point_reads_scan_only_folders_that_may_hold_them(spark):
    rows = random_log(4, 900, 400)
    kept = levels_of(spark, buckets=8, fanout=4)
    for number in range(3):
        kept.append(spark.createDataFrame(rows[number::3], VERSION), number)
    expected = newest(rows)
    wanted = [*list(expected)[:2], ("receipts", "absent"), list(expected)[0], (None, "d1"),
              ("receipts", None)]
    keys = spark.createDataFrame(wanted, "collection_name string, document_id string")
    assert collected(kept.documents(keys)) == {k: expected[k] for k in list(expected)[:2]}
    scanned = kept.documents(keys).inputFiles()
    assert 0 < len(scanned) <= 9 < len(kept.state().inputFiles())
    nobody = spark.createDataFrame([("receipts", f"no{n}") for n in range(20)],
                                   "collection_name string, document_id string")
    assert kept.documents(nobody).count() == 0
    assert len(kept.candidates(nobody)) <= 8


def test_empty_levels(spark):
    kept = levels_of(spark)
    keys = spark.createDataFrame([("receipts", "a")], "collection_name string, document_id string")
    assert kept.state().count() == kept.documents(keys).count() == 0
    kept.append(spark.createDataFrame([], VERSION), 0)
    assert kept.state().count() == kept.documents(keys).count() == 0


@pytest.mark.parametrize("upto", [0, 150, 290, 300])
def test_clustered_pages_equal_the_log(spark, upto):
    rows = random_log(5)
    log = spark.createDataFrame(rows, VERSION)
    root = work_dir(spark, "pages")
    pages.store(log, root, upto, 4)
    for checkpoint, size in ((0, 10), (0, 500), (120, 7), (250, 40), (299, 3), (400, 3)):
        for collection in ("receipts", "settings"):
            got = pages.pull(log, root, collection, checkpoint, size)
            want = replication.pull(log, collection, checkpoint, size)
            assert list(map(tuple, got.select(*sorted(got.columns)).collect())) == list(
                map(tuple, want.select(*sorted(want.columns)).collect()))


def test_a_page_reads_few_files(spark):
    log = spark.createDataFrame(
        [("receipts", f"d{n}", n, "v", "c") for n in range(1, 2001)], VERSION)
    root = work_dir(spark, "pages")
    pages.store(log, root, 2000, 20)
    assert len(spark.read.parquet(f"{root}/rows").inputFiles()) >= 100
    for checkpoint in (0, 777, 1500):
        assert len(pages.files_of_page(spark, root, "receipts", checkpoint, 50)) <= 6


def test_many_documents_are_not_asked_for_where_some_were_found(spark, monkeypatch):
    rows = random_log(6, 900, 400)
    kept = levels_of(spark, buckets=4, fanout=4)
    for number in range(3):
        kept.append(spark.createDataFrame(rows[number::3], VERSION), number)
    keys = spark.createDataFrame(list(newest(rows)), "collection_name string, document_id string")
    whole, asked, hit = kept.candidates(keys), [], Levels._hit

    def seen(self, bits, documents, known):
        asked.append((documents.count(), {r: set(b) for r, b in known.items()}))
        return hit(self, bits, documents, known)

    monkeypatch.setattr(levels, "ASKED_FIRST", 40)
    monkeypatch.setattr(Levels, "_hit", seen)
    assert kept.candidates(keys) == whole and len(whole) == 12
    assert [n for n, _ in asked] == [40, len(newest(rows))]
    assert sum(map(len, asked[1][1].values())) >= 9
    assert collected(kept.documents(keys)) == newest(rows)
