import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillspark.operators import push, replication
from tillspark.operators.ordered import with_last_marked, with_previous

PUSHED = "ord long, document_id string, assumed_json string, new_json string"
MASTER = "document_id string, document_json string"
LOG = ("collection_name string, document_id string, document_json string, "
       "server_sequence long, is_deleted boolean")
STAMP = "2026-07-14T10:00:00Z"


def doc(name, value, deleted=False):
    flag = str(deleted).lower()
    return f'{{"_deleted":{flag},"id":"{name}","value":{value}}}'


def run(spark, rows, masters=(), *sizes):
    pushed = spark.createDataFrame(rows, PUSHED)
    stored = spark.createDataFrame(list(masters), MASTER)
    decided = push.push(pushed, stored, *sizes)
    changes = push.accepted_changes(decided, "receipts", 0, STAMP)
    conflicts = push.conflicts(decided, pushed, stored)
    return changes.orderBy("server_sequence").collect(), conflicts.orderBy("ord").collect()


def brute_force(rows, masters):
    state, accepted, conflicts = dict(masters), [], []
    for order, name, assumed, new in rows:
        now = state.get(name)
        free = now is None and assumed in (None, "{}")
        if free or (now is not None and assumed == now):
            state[name] = new
            accepted.append((order + 1, new))
        elif now is not None:
            conflicts.append((order, now))
    return accepted, conflicts


def test_create_and_pull_in_pages(spark):
    changes, conflicts = run(spark, [(0, "r1", None, doc("r1", 1)), (1, "r2", None, doc("r2", 1))])
    assert not conflicts
    log = spark.createDataFrame([
        ("receipts", c.document_id, c.document_json, c.server_sequence, c.is_deleted)
        for c in changes], LOG)
    first = replication.pull(log, "receipts", 0, 1)
    assert [(r.document_id, r.server_sequence) for r in first.collect()] == [("r1", 1)]
    assert replication.next_checkpoint(first, 0).first()[0] == 1
    rest = replication.pull(log, "receipts", 1)
    assert [r.document_id for r in rest.collect()] == ["r2"]
    assert replication.next_checkpoint(replication.pull(log, "receipts", 2), 2).first()[0] == 2


def test_stale_push_returns_master(spark):
    changes, conflicts = run(spark, [(0, "r1", doc("r1", 9), doc("r1", 2))],
                             [("r1", doc("r1", 1))])
    assert not changes and conflicts[0].master_json == doc("r1", 1)


def test_key_order_and_blanks_do_not_matter(spark):
    assumed = '{ "value": 1, "id": "r1", "_deleted": false }'
    changes, _ = run(spark, [(0, "r1", assumed, doc("r1", 2))], [("r1", doc("r1", 1))])
    assert len(changes) == 1


def test_tombstone(spark):
    changes, _ = run(spark, [(0, "r1", None, doc("r1", 1)),
                             (1, "r1", doc("r1", 1), doc("r1", 1, True))])
    assert [c.is_deleted for c in changes] == [False, True]


def test_mismatch_without_master_is_dropped(spark):
    changes, conflicts = run(spark, [(0, "r1", doc("r1", 5), doc("r1", 6))])
    assert not changes and not conflicts


def test_replay_conflicts(spark):
    rows = [(0, "r1", None, doc("r1", 1)), (1, "r1", doc("r1", 1), doc("r1", 2))]
    changes, _ = run(spark, rows)
    again, conflicts = run(spark, rows, [("r1", changes[-1].document_json)])
    assert not again and len(conflicts) == 2


def test_unknown_collection_and_blank_id(spark):
    writes = spark.createDataFrame([("settings", "x"), ("receipts", ""), ("receipts", "a")],
                                   "collection_name string, document_id string")
    reasons = sorted(r.reason for r in replication.rejected_writes(writes).collect())
    assert reasons == ["blank_id", "unknown_collection"]
    with pytest.raises(ValueError):
        replication.require_valid(writes)


def test_pull_bounds(spark):
    log = spark.createDataFrame([], LOG)
    for size in (0, 501):
        with pytest.raises(ValueError):
            replication.pull(log, "receipts", 0, size)


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_document_equals_sequential(spark, seed):
    """One document has most rows and is cut in many chunks; states repeat often."""
    rng = random.Random(seed)
    rows, last = [], {}
    for order in range(900):
        name = "hot" if rng.random() < 0.6 else f"d{rng.randrange(40)}"
        new = doc(name, rng.randrange(5))
        choice = rng.random()
        assumed = last.get(name) if choice < 0.6 else (
            doc(name, rng.randrange(5)) if choice < 0.9 else rng.choice([None, "{}"]))
        rows.append((order, name, assumed, new))
        last[name] = new
    masters = [("hot", doc("hot", 3)), ("d1", doc("d1", 0))]
    accepted, conflicts = brute_force(rows, masters)
    for sizes in ((), (64,) if seed == 1 else (100_000,)):
        changes, found = run(spark, rows, masters, *sizes)
        assert [(c.server_sequence, c.document_json) for c in changes] == accepted
        assert [(c.ord, c.master_json) for c in found] == conflicts


def test_pages_concatenate_to_current_state(spark):
    rng = random.Random(5)
    log = spark.createDataFrame([
        ("receipts", f"d{rng.randrange(60)}", "{}", n, False) for n in range(1, 300)], LOG)
    seen, checkpoint = [], 0
    while True:
        page = replication.pull(log, "receipts", checkpoint, 25)
        rows = page.collect()
        if not rows:
            break
        seen += [(r.document_id, r.server_sequence) for r in rows]
        checkpoint = replication.next_checkpoint(page, checkpoint).first()[0]
    current = replication.current_state(log).collect()
    assert sorted(seen) == sorted((r.document_id, r.server_sequence) for r in current)


def test_lww_order_and_audit(spark):
    version = "struct<updatedAt:string,updatedByDevice:string>"
    pairs = spark.createDataFrame([
        ("r1", ("2026-07-14T10:00:00Z", "a"), ("2026-07-14T09:00:00Z", "z")),
        ("r2", ("2026-07-14T10:00:00Z", "a"), ("2026-07-14T10:00:00Z", "b")),
        ("r3", ("2026-07-14T10:00:00Z", "b"), ("2026-07-14T10:00:00Z", "b"))],
        f"id string, local {version}, remote {version}")
    won = replication.lww_pairs(pairs)
    assert [r.winner for r in won.orderBy("id").collect()] == ["local", "remote", "local"]
    audit = replication.conflict_audit(won, F.lit("receipts"), F.col("id"), STAMP)
    row = audit.where("documentId = 'r2'").first()
    assert (row.type, row.collection, row.winnerDevice) == ("sync-conflict", "receipts", "b")


def test_chunked_lag_equals_plain(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aaab"), n, rng.choice([None, "x", "y"]))
            for n in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, n long, v string")
    for following in (False, True):
        got = {r.n: r.p for r in with_previous(
            df, ["k"], "n", F.col("v"), "p", 40, following).collect()}
        for k in "ab":
            own = sorted((n, v) for kk, n, v in rows if kk == k)
            values = [v for _, v in own]
            shifted = [*values[1:], None] if following else [None, *values[:-1]]
            assert [got[n] for n, _ in own] == shifted


def test_chunked_last_mark(spark):
    df = spark.createDataFrame([("a", n) for n in range(0, 200, 3)], "k string, n long")
    got = with_last_marked(df, ["k"], "n", F.col("n") % 7 == 0, "m", 10).orderBy("n").collect()
    last = None
    for row in got:
        last = row.n if row.n % 7 == 0 else last
        assert row.m == last


def test_first_creation_time_stays(spark):
    log = spark.createDataFrame(
        [("receipts", "r", "{}", n, n == 3, f"T{n}") for n in (1, 2, 3)],
        LOG + ", created_at string")
    row = replication.current_state(log).first()
    assert (row.server_sequence, row.created_at) == (3, "T1")
    assert "created_at" not in replication.pull(log, "receipts", 1).columns


@pytest.mark.parametrize("collection,name", [("receipts", ""), ("receipts", None), ("odd", "r")])
def test_a_batch_with_an_invalid_row_is_refused_whole(spark, collection, name):
    rows = spark.createDataFrame([(0, "ok", None, doc("ok", 1)), (1, name, None, "{}")], PUSHED)
    with pytest.raises(ValueError):
        push.push(rows, spark.createDataFrame([], MASTER), collection=collection)
    assert push.batch_faults(rows, collection).count() == (1 if collection == "receipts" else 2)


def test_an_empty_batch(spark):
    assert run(spark, []) == ([], [])


def test_tables_of_small_chunks_share_frames():
    rows = pd.DataFrame({"document_id": [str(i) for i in range(30_000)], "chunk": 0,
                         "ord": range(30_000), "assumed": "none", "new": "a"})
    frames = list(push._chunk_tables(iter([rows[:17], rows[17:]])))
    whole = pd.concat(frames)
    assert len(frames) <= 4
    assert whole["document_id"].tolist() == rows["document_id"].tolist()
    assert whole["exit_writer"].tolist() == list(range(30_000))
    assert list(push._chunk_tables(iter([]))) == []


def test_a_document_takes_part_in_the_levels_of_its_own_chunks(spark, monkeypatch):
    """Chunks without rows of a document are no nodes of its tree."""
    rows = [(order, name, None, doc(name, order)) for name, orders in (
        ("far", (0, 9_990)), ("one", (5_000, 5_001)),
        ("many", range(20, 900, 10)), ("next", (639, 640, 641))) for order in orders]
    made, write = [], push.cut_lineage

    def seen(df, label):
        kept = write(df, label)
        if label == "push-level":
            made.append({r.document_id for r in kept.collect()})
        return kept

    monkeypatch.setattr(push, "cut_lineage", seen)
    rows.sort()
    accepted, conflicts = brute_force(rows, [])
    changes, found = run(spark, rows, [], 10)
    assert [(c.server_sequence, c.document_json) for c in changes] == accepted
    assert [(c.ord, c.master_json) for c in found] == conflicts
    assert made == [{"far", "many", "next"}] + [{"many"}] * 6
