"""The item index: postings by receipt, updates past the last sequence, bounded reads."""

import json

from pyspark.sql import functions as F

from tillspark.operators import step
from tillspark.session import work_dir
from tillspark.sources.item_index import ItemIndex
from tillspark.streaming.levels import Levels

LOG = ("collection_name string, document_id string, document_json string, "
       "server_sequence long, is_deleted boolean")


def _log(spark, *rows):
    """rows: (collection, id, receipt of an item or None, sequence)"""
    return spark.createDataFrame([
        (c, i, json.dumps({"id": i, "receiptId": r, "_deleted": False} if r else
                          {"id": i, "status": f"v{n}"}), n, False)
        for c, i, r, n in rows], LOG)


def _ask(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "receipt_id string")


ROWS = [("receipts", "r1", None, 1), ("receipts", "r2", None, 2),
        ("receipt_items", "a", "r1", 3), ("receipt_items", "b", "r1", 4),
        ("receipt_items", "c", "r2", 5), ("receipt_items", "b", "r2", 6),  # b moves to r2
        ("receipts", "r1", None, 7), ("receipt_items", "d", "r3", 8)]


def test_both_ways_give_the_claimed_documents(spark):
    log = _log(spark, *ROWS)
    levels, index = Levels(spark, work_dir(spark, "l"), LOG), ItemIndex(spark, work_dir(spark, "i"))
    for batch, (low, high) in enumerate(((0, 4), (4, 6), (6, 9))):
        part = log.where((F.col("server_sequence") > low) & (F.col("server_sequence") <= high))
        levels.append(part, batch)
        index.update(log.where(F.col("server_sequence") <= high))
    for ids, heads, lines in ((("r1",), {("r1", "v7")}, {("a", "r1")}),
                              (("r2", "r2", None), {("r2", "v2")}, {("b", "r2"), ("c", "r2")}),
                              (("r3", "none"), set(), {("d", "r3")}), ((), set(), set())):
        asked = _ask(spark, *ids)
        for found in (step.claimed_documents(log, asked),
                      step.indexed_documents(levels, index, asked)):
            assert {(r.id, r.status) for r in found[0].collect()} == heads
            assert sorted((r.id, r.receiptId) for r in found[1].collect()) == sorted(lines)


def test_runs_merge_and_reads_are_bounded(spark):
    index = ItemIndex(spark, work_dir(spark, "i"), buckets=8, fanout=3)
    rows = []
    for n in range(1, 10):
        rows += [("receipt_items", f"i{n}-{k}", f"r{k}", 10 * n + k) for k in range(6)]
        index.update(_log(spark, *rows))
        index.update(_log(spark, *rows))  # nothing new
    levels = index.manifest()["levels"]
    assert [len(runs) for runs in levels] == [0, 0, 1]
    asked = _ask(spark, "r2")
    assert {r.document_id for r in index.items_of(asked).collect()} \
        == {f"i{n}-2" for n in range(1, 10)}
    assert len(index.folders_of(asked)) == 1


def test_an_empty_log_has_no_postings(spark):
    index = ItemIndex(spark, work_dir(spark, "i"))
    index.update(spark.createDataFrame([], LOG))
    assert index.items_of(_ask(spark, "r1")).count() == 0


def test_postings_are_shuffled_once(spark):
    index = ItemIndex(spark, work_dir(spark, "i"))
    rows = [("r1", "a"), ("r1", "b"), ("r2", "b"), ("r1", "b")]
    dealt = index._dealt(spark.createDataFrame(rows, "receipt_id string, document_id string"))
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.receipt_id, r.document_id) for r in dealt.collect()) == sorted(set(rows))
