from datetime import datetime

import pytest

from tillspark.operators import insights, limiter, replication
from tillspark.session import work_dir
from tillspark.streaming import live, replicate, stateful
from tillspark.streaming.sources import stream_parquet

VERSIONS = "collection_name string, document_id string, server_sequence long, status string"


def versions(spark, rows):
    return spark.createDataFrame(rows, VERSIONS)


def test_state_and_notifications_over_restarts(spark):
    base = work_dir(spark, "test")
    log = f"{base}/log"

    def follow():
        stream = stream_parquet(spark, log, versions(spark, []).schema)
        replicate.follow_state(stream, f"{base}/state", f"{base}/cp1")
        replicate.notify(stream, f"{base}/notes", f"{base}/cp2")

    versions(spark, [("receipts", "a", 1, "x"), ("receipts", "a", 3, "y"),
                     ("settings", "s", 2, "z")]).write.mode("append").parquet(log)
    follow()
    follow()
    versions(spark, [("receipts", "b", 4, "x"), ("receipt_items", "i", 5, "x"),
                     ("receipts", "a", 6, "w")]).write.mode("append").parquet(log)
    follow()
    state = {(r.collection_name, r.document_id): r.status
             for r in replicate.followed_state(spark, f"{base}/state").collect()}
    assert state == {("receipts", "a"): "w", ("receipts", "b"): "x", ("receipt_items", "i"): "x"}
    notes = spark.read.parquet(f"{base}/notes").orderBy("batch", "collection_name").collect()
    assert [(n.batch, n.collection_name, n.server_sequence, n.wakeExtraction) for n in notes] == [
        (0, "receipts", 3, True), (1, "receipt_items", 5, False), (1, "receipts", 6, True)]
    replicate.compact_state(spark, f"{base}/state", f"{base}/compacted")
    assert replicate.followed_state(spark, f"{base}/compacted").count() == 3


def test_transitions_across_batches(spark):
    base = work_dir(spark, "test")
    log = f"{base}/log"
    batches = [
        [("receipts", "a", 2, "queued"), ("receipts", "a", 1, "captured")],
        [("receipts", "a", 4, "confirmed"), ("receipts", "a", 3, "needs_review"),
         ("receipts", "b", 5, "needs_review")],
        [("receipts", "b", 6, "processing"), ("receipts", "b", 7, "needs_review")],
    ]
    for rows in batches:
        versions(spark, rows).coalesce(1).write.mode("append").parquet(log)
        stateful.follow_transitions(
            stream_parquet(spark, log, versions(spark, []).schema), f"{base}/out", f"{base}/cp")
    live = spark.read.parquet(f"{base}/out").select("document_id", "server_sequence")
    batch = replication.status_transitions(spark.read.parquet(log)).select(
        "document_id", "server_sequence")
    assert sorted(map(tuple, live.collect())) == [("a", 3), ("b", 7)]
    assert sorted(map(tuple, batch.collect())) == [("a", 3), ("b", 7)]


def test_limiter_across_batches(spark):
    base = work_dir(spark, "test")
    rows = [("k", n, n * 1_000_000, True) for n in range(15)]
    schema = "key string, ord long, at_micros long, failed boolean"
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/log")
        stream = stream_parquet(spark, f"{base}/log", spark.createDataFrame([], schema).schema)
        stateful.follow_failures(stream, f"{base}/out", f"{base}/cp", 10, 300)
    live = spark.read.parquet(f"{base}/out").orderBy("ord").collect()
    whole = limiter.limit_failures(spark.createDataFrame(rows, schema)).orderBy("ord").collect()
    assert live == whole


def test_live_comparison_over_batches(spark):
    base = work_dir(spark, "test")
    schema = ("id string, transactionDate string, totalMinor long, categoryId string, "
              "merchantNormalized string, merchantRaw string")
    for n, day in enumerate(("2026-07-01", "2026-06-02", "2026-07-03")):
        spark.createDataFrame([(str(n), day, 100, "home", "M", None)], schema).write.mode(
            "append").parquet(f"{base}/log")
        replicate.live_comparison(
            stream_parquet(spark, f"{base}/log", spark.createDataFrame([], schema).schema),
            datetime(2026, 7, 14, 12), "category", f"{base}/out", f"{base}/cp")
    row = replicate.latest_comparison(spark, f"{base}/out").first()
    assert (row.total, row.previousTotal, row["count"]) == (200, 100, 2)


def test_live_comparison_takes_edits_and_deletions_back(spark):
    base = work_dir(spark, "test")
    schema = ("id string, transactionDate string, totalMinor long, categoryId string, "
              "merchantNormalized string, merchantRaw string, server_sequence long, "
              "_deleted boolean")
    versions = [("a", "2026-07-01", 100, "home", 1, False), ("b", "2026-07-02", 50, "home", 2, False),
                ("a", "2026-07-01", 30, "food", 3, False), ("b", "2026-07-02", 50, "home", 4, True),
                ("a", "2026-07-01", 999, "home", 2, False)]  # the last one comes late
    for v in versions:
        row = (v[0], v[1], v[2], v[3], "M", None, v[4], v[5])
        spark.createDataFrame([row], schema).write.mode("append").parquet(f"{base}/log")
        replicate.live_comparison(
            stream_parquet(spark, f"{base}/log", spark.createDataFrame([], schema).schema),
            datetime(2026, 7, 14, 12), "category", f"{base}/out", f"{base}/cp")
    rows = replicate.latest_comparison(spark, f"{base}/out").collect()
    assert [(r.id, r.total, r["count"]) for r in rows] == [("food", 30, 1)]


RECEIPT = ("id string, transactionDate string, totalMinor long, categoryId string, "
           "merchantNormalized string, merchantRaw string, server_sequence long, "
           "_deleted boolean")
ITEM = ("id string, receiptId string, rawName string, normalizedName string, "
        "unitPriceMinor long, totalPriceMinor long, quantity double, server_sequence long, "
        "_deleted boolean")
NOW = datetime(2026, 7, 14, 12)


def as_batch(receipts, items):
    """Products, price changes and findings of the newest versions, without streams."""
    def alive(rows):
        newest = replication.latest(rows, ["id"], "server_sequence")
        return newest.where("not _deleted")
    r, i = alive(receipts), alive(items)
    return [sorted(map(str, f.collect())) for f in (
        insights.product_totals(r, i, NOW), insights.price_changes(r, i),
        insights.findings(r, i, NOW, 1, 1.0))]


def as_live(store):
    return [sorted(map(str, f.collect())) for f in (
        live.product_totals(store), live.price_changes(store),
        live.findings(store, minimum_minor=1, minimum_percent=1.0))]


def test_live_insights_equal_the_batch(spark, monkeypatch):
    """Edits, late versions, a latest price taken back, a batch cut off and one run twice."""
    receipts = [("a", "2026-07-01", 900, "home", "M", None, 1, False),
                ("b", "2026-07-05", 500, "food", "N", None, 2, False),
                ("c", "2026-06-05", 300, "food", "N", None, 3, False),
                ("b", "2026-06-20", 450, "home", "N", None, 8, False),
                ("c", "2026-06-05", 300, "food", "N", None, 9, True),
                ("a", "2026-07-03", 9999, "home", "M", None, 0, False)]  # late
    items = [("i1", "a", "MILK", "milk", 100, 100, 1.0, 4, False),
             ("i2", "b", "MILK", "milk", 150, 300, 2.0, 5, False),
             ("i3", "c", "BREAD", "bread", 70, 70, None, 6, False),
             ("i4", "a", "BREAD", None, 90, 90, 1.0, 7, False),
             ("i5", "lost", "MILK", "milk", 80, 80, 1.0, 7, False),
             ("i2", "b", "MILK", "milk", 150, 300, 2.0, 10, True),
             ("i4", "a", "BREAD", "rye", 95, 95, 1.0, 11, False),
             ("i1", "a", "MILK", "milk", 1, 1, 1.0, 2, False)]  # late
    store = live.open_store(spark, work_dir(spark, "test"), buckets=3)
    r = lambda rows: spark.createDataFrame(rows, RECEIPT)
    i = lambda rows: spark.createDataFrame(rows, ITEM)
    live.apply(store, NOW, r(receipts[:3]), i(items[:5]), "s", 0)
    assert as_live(store) == as_batch(r(receipts[:3]), i(items[:5]))

    def cut_off(manifest):
        raise RuntimeError("cut off")

    before = as_live(store)
    with monkeypatch.context() as m:
        m.setattr(store, "publish", cut_off)
        with pytest.raises(RuntimeError, match="cut off"):
            live.apply(store, NOW, r(receipts[3:]), i(items[5:]), "s", 1)
    assert as_live(store) == before, "readers see a batch whole or not at all"
    live.apply(store, NOW, r(receipts[3:]), i(items[5:]), "s", 1)
    after = as_live(store)
    assert after == as_batch(r(receipts), i(items))
    live.apply(store, NOW, r(receipts[3:]), i(items[5:]), "s", 1)
    assert store.manifest()["version"] == 2, "a batch that was applied does nothing"

    folders = {t: sorted(f.values()) for t, f in store.manifest()["folders"].items()}
    assert all(len(f) <= 3 for f in folders.values()), "a bucket has one folder"
    store.vacuum()
    assert as_live(store) == after
    assert len(store.listed("manifests")) == 1


def test_a_batch_reads_its_buckets_only(spark):
    store = live.open_store(spark, work_dir(spark, "test"), buckets=4)
    rows = [(str(n), "2026-07-01", n, "home", "M", None, 1, False) for n in range(40)]
    live.apply(store, NOW, spark.createDataFrame(rows, RECEIPT), None, "s", 0)
    one = store.buckets_of([spark.createDataFrame([("7",)], "id string")])
    before = store.manifest()["folders"]["receipts"]
    live.apply(store, NOW, spark.createDataFrame([("7", "2026-07-01", 5, "food", "M", None, 2,
                                                   False)], RECEIPT), None, "s", 1)
    after = store.manifest()["folders"]["receipts"]
    assert {b for b in after if after[b] != before[b]} == set(map(str, one))
    read = store.read("receipts", one).inputFiles()
    assert read and all(after[str(one[0])] in f for f in read)


def test_a_product_is_not_gathered_and_old_folders_go(spark):
    """A product of many receipts stays dealt by receipt; only two versions' folders are kept."""
    store = live.open_store(spark, work_dir(spark, "test"), buckets=2)
    rows = [(f"i{n}", str(n), "MILK", "milk", 100 + n, 100, 1.0, 1, False) for n in range(40)]
    live.apply(store, NOW, None, spark.createDataFrame(rows, ITEM), "s", 0)
    assert store.read("summary").count() == 2, "one part of the product for each bucket"
    for number in (1, 2):
        late = [(f"i{n}", str(n), "MILK", "milk", 500 + n, 100, 1.0, 1 + number, n == 39)
                for n in range(20)] + [("i39", "39", "MILK", "milk", 9, 9, 1.0, 5, True)]
        live.apply(store, NOW, None, spark.createDataFrame(late, ITEM), "s", number)
        rows += late
    assert as_live(store) == as_batch(spark.createDataFrame([], RECEIPT),
                                      spark.createDataFrame(rows, ITEM))
    assert not [f for f in store.listed("items/s-0") if f.startswith("bucket=")]
    assert sorted(store.listed("manifests")) == ["2.json", "3.json"]
