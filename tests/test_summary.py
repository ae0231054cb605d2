"""The summary step: snapshots by owner, hash, failures and the bound on a prompt."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_insights import ITEM, RECEIPT
from tillspark.operators import insights, summary
from tillspark.operators.extraction import ModelUnavailable

NOW = datetime(2026, 7, 14, 12)
SETTINGS = "id string, locale string, aiSummary string"


@pytest.fixture
def tables(spark):
    heads = spark.createDataFrame(
        [("1", "2026-07-10", 4000, "a", "Shop", "", "o1"),
         ("2", "2026-06-10", 2000, "a", "Shop", "", "o1"),
         ("3", "2026-07-11", 500, "b", "Kiosk", "", "o1"), ("4", "", None, "b", "", "", "o2"),
         ("5", "2026-07-11", 7, "b", "", "", None)], RECEIPT + ", owner string")
    items = spark.createDataFrame(
        [("i1", "2", "Latte", "", 2000, 200, 1.0), ("i2", "1", "Latte", "", 4000, 300, 2.0),
         ("i3", "3", "Pane", "", 500, 500, None), ("i4", "4", "Latte", "", 1, 1, 1.0),
         ("i5", "5", "Nobody", "", 1, 1, 1.0), ("i6", "none", "Lost", "", 1, 1, 1.0)], ITEM)
    return heads, items


def _settings(spark, *rows):
    return spark.createDataFrame(list(rows), SETTINGS)


def _run(spark, tables, call, settings, **options):
    after, outcomes = summary.insight_step(settings, *tables, call, NOW, **options)
    return ({r.id: r.aiSummary for r in after.collect()},
            {r.id: (r.status, r.failure, r.violations) for r in outcomes.collect()})


def test_a_snapshot_holds_what_its_owner_bought(spark, tables):
    settings = _settings(spark, ("o1", "it-IT", None), ("o2", "en-GB", None), ("o3", None, None))
    figures = summary.owner_figures(*tables, NOW)
    found = {r.owner: json.loads(r.snapshot)
             for r in summary.snapshots(settings, figures, NOW).collect()}
    one = found["o1"]
    assert (one["locale"], one["total"], one["previousTotal"]) == ("it-IT", 4500, 2000)
    assert one["period"] == {"start": "2026-07-01", "end": "2026-07-14",
                             "previousStart": "2026-06-01", "previousEnd": "2026-06-14"}
    assert one["categories"] == [
        {"id": "a", "total": 4000, "count": 1, "previousTotal": 2000, "difference": 2000,
         "changePercent": 100.0},
        {"id": "b", "total": 500, "count": 1, "previousTotal": 0, "difference": 500,
         "changePercent": None}]
    assert [m["id"] for m in one["merchants"]] == ["Shop", "Kiosk"]
    assert one["items"] == [{"id": "Latte", "total": 4000, "quantity": 2.0, "frequency": 1},
                            {"id": "Pane", "total": 500, "quantity": 1.0, "frequency": 1}]
    assert one["priceChanges"] == [{"id": "Latte", "latest": 300, "previousAverage": 200,
                                    "difference": 100, "changePercent": 50.0}]
    for owner in ("o2", "o3"):
        assert found[owner]["total"] == 0 and found[owner]["items"] == []


def test_replies_and_failures(spark, tables):
    def call(content, mime_type, prompt):
        snapshot = json.loads(prompt.split("Dati aggregati:\n", 1)[1])
        if snapshot["locale"] == "de-DE":
            raise ModelUnavailable("busy")
        if snapshot["locale"] == "fr-FR":
            return json.dumps({"observations": ["1", "2", "3", "4"], "suggestion": None})
        return json.dumps({"observations": [str(snapshot["total"])], "suggestion": None})

    kept, outcomes = _run(spark, tables, call, _settings(
        spark, ("o1", "it-IT", "old"), ("o2", "de-DE", "old"), ("o3", "fr-FR", "old"),
        ("o4", "xx", "old"), ("o5", None, None)))
    stored = json.loads(kept.pop("o1"))
    assert stored["observations"] == ["4500"] and stored["suggestion"] is None
    assert stored["generatedAt"] == "2026-07-14T12:00:00.000Z" and len(stored["datasetHash"]) == 64
    assert kept == {"o2": "old", "o3": "old", "o4": "old", "o5": None}
    assert outcomes == {
        "o1": ("saved", None, []), "o2": ("unavailable", "http", []),
        "o3": ("unavailable", "invalid", ["observations"]),
        "o4": ("unavailable", "invalid_request", ["locale"]),
        "o5": ("unavailable", "invalid_request", ["locale"])}


def test_an_owner_beyond_the_bound_is_not_gathered(spark, tables):
    def call(content, mime_type, prompt):
        return json.dumps({"observations": [], "suggestion": "less"})

    # o1 has two categories, two merchants, the total, two products and a price change
    rows = (("o1", "it-IT", "old"), ("o2", "it-IT", None))
    kept, outcomes = _run(spark, tables, call, _settings(spark, *rows), max_entries=7)
    assert kept["o1"] == "old" and outcomes["o1"] == ("unavailable", summary.TOO_LARGE, [])
    assert outcomes["o2"] == ("saved", None, [])
    assert _run(spark, tables, call, _settings(spark, *rows), max_entries=8)[1]["o1"][0] == "saved"


def test_the_hash_of_one_owner_is_that_of_their_tables(spark, tables):
    heads, items = tables
    mine = heads.where(F.col("owner") == "o1")
    bought = items.join(mine.select(F.col("id").alias("receiptId")), "receiptId", "left_semi")
    rows = insights.snapshot_measures(mine, bought, NOW, "it-IT")
    alone = insights.dataset_hash(
        rows, ["section", "id", *insights.SNAPSHOT_FIGURES], "it").first().datasetHash
    settings = _settings(spark, ("o1", "it-IT", None), ("o2", "it-IT", None))
    found = {r.owner: r.datasetHash for r in summary.owner_hashes(
        settings, summary.owner_figures(heads, items, NOW), NOW).collect()}
    assert found["o1"] == alone and found["o2"] != alone


def test_empty_tables(spark, tables):
    heads, items = (t.limit(0) for t in tables)
    kept, outcomes = _run(spark, (heads, items), lambda *a: '{"observations":[],"suggestion":null}',
                          _settings(spark, ("o1", "it-IT", None)))
    assert json.loads(kept["o1"])["observations"] == [] and outcomes["o1"][0] == "saved"
    assert _run(spark, (heads, items), None, _settings(spark)) == ({}, {})
