from datetime import datetime

from pyspark.sql import functions as F

from tillspark import model
from tillspark.functions import dates, money
from tillspark.operators import archive, insights

NOON = datetime(2026, 7, 14, 12)
RECEIPT = ("id string, transactionDate string, totalMinor long, categoryId string, "
           "merchantNormalized string, merchantRaw string")
ITEM = ("id string, receiptId string, normalizedName string, rawName string, "
        "totalPriceMinor long, unitPriceMinor long, quantity double")


def receipts(spark, *rows):
    return spark.createDataFrame(
        [(i, d, t, "food_grocery", "Market", "Market") for i, d, t in rows], RECEIPT)


def sample(spark):
    return receipts(spark, ("current", "2026-07-10", 4000), ("previous", "2026-06-10", 2000),
                    ("future-previous", "2026-06-20", 9000)), spark.createDataFrame([
                        ("i1", "previous", "Latte", "", 2000, 200, 1.0),
                        ("i2", "current", "Latte", "", 4000, 300, 2.0)], ITEM)


def test_equivalent_periods(spark):
    heads, items = sample(spark)
    totals = insights.period_totals(heads, NOON).first()
    assert (totals.total, totals.previousTotal, totals.changePercent) == (4000, 2000, 100.0)
    assert insights.comparison(heads, NOON, insights.CATEGORY).first().difference == 2000
    assert insights.product_totals(heads, items, NOON).first().frequency == 1
    price = insights.price_changes(heads, items).first()
    assert (price.latest, price.previousAverage, price.changePercent) == (300, 200, 50.0)
    kinds = [r.type for r in insights.findings(heads, items, NOON).collect()]
    assert "category" in kinds and "price" not in kinds


def test_findings_below_thresholds(spark):
    heads = receipts(spark, ("a", "2026-07-10", 1100), ("b", "2026-06-10", 1000))
    items = spark.createDataFrame([], ITEM)
    assert insights.findings(heads, items, NOON).count() == 0


def test_no_receipts_give_zero_totals(spark):
    totals = insights.period_totals(receipts(spark, ("a", "2020-01-01", 5)), NOON).first()
    assert (totals.total, totals.previousTotal, totals.changePercent) == (0, 0, 0.0)


def test_noon_rule_and_clamped_day():
    morning = dates.comparable_period(datetime(2026, 7, 14, 11, 59, 59, 999999))
    assert morning.last_counted.isoformat() == "2026-07-13"
    assert dates.comparable_period(NOON).last_counted.isoformat() == "2026-07-14"
    march = dates.comparable_period(datetime(2026, 3, 31, 12))
    assert march.previous_end.isoformat() == "2026-02-28"
    assert dates.comparable_period(datetime(2026, 1, 1, 8)).previous_start.isoformat() \
        == "2025-12-01"


def test_odd_dates_are_no_dates(spark):
    heads = receipts(spark, ("a", "2026-07-1x", 5), ("b", "2026-07-5", 7), ("c", "", 9),
                     ("d", "2026-07-02", 11), ("e", "2026-06-31", 13))
    totals = insights.period_totals(heads, NOON).first()
    assert (totals.total, totals.previousTotal) == (11, 0)


def test_prices_of_items_without_receipt_sort_first(spark):
    heads = receipts(spark, ("r", "2026-01-01", 5))
    items = spark.createDataFrame([
        ("z", "missing", " Pane\t", "", 1, 900, 1.0), ("a", "r", "Pane", "", 1, 0, None),
        ("b", "r", "", "  ", 1, 5, 1.0)], ITEM)
    found = insights.price_changes(heads, items).collect()
    assert [(r.id, r.latest, r.previousAverage, r.changePercent) for r in found] == [
        ("Pane", 0, 900, -100.0)]


def test_undefined_percent_from_zero(spark):
    heads = receipts(spark, ("a", "2026-07-10", 100))
    row = insights.comparison(heads, NOON, insights.MERCHANT).first()
    assert row.changePercent is None and row["count"] == 1


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("12.345",), ("-0.5",), ("",), ("  ",), ("1d",), (None,), (".5",)], "t string")
    minors = [r[0] for r in df.select(money.to_minor(F.col("t"))).collect()]
    assert minors == [1235, -50, None, 0, None, None, 50]
    shown = spark.createDataFrame([(12.0,), (-3.25,), (0.04,), (None,)], "p double").select(
        money.signed_percent(F.col("p"))).collect()
    assert [r[0] for r in shown] == ["+12%", "-3.3%", "+0%", "—"]


def test_archive_filters(spark):
    heads = spark.createDataFrame([
        ("a", None, 1, "home", "Bar", "ROMA"), ("b", "2026-06-30", 1, "home", None, "Other"),
        ("c", "2026-07-31", 1, "food", "x", None), ("d", "2025-07-01", 1, "home", "", "")],
        RECEIPT)
    items = spark.createDataFrame([("i", "d", "Latte", "MILK", 1, 1, 1.0)], ITEM)

    def ids(**filters):
        return sorted(r.id for r in archive.search(heads, items, NOON, **filters).collect())

    assert ids() == ["a", "b", "c", "d"]
    assert ids(period="month") == ["a", "c"]
    assert ids(period="previous") == ["a", "b"]
    assert ids(period="year") == ["a", "b", "c"]
    assert ids(query=" bar roma ") == ["a"]
    assert ids(query="latte milk") == ["d"]
    assert ids(query="e m", category="home") == ["d"]


def test_archive_search_plans_no_nested_loop(spark):
    heads, items = sample(spark)
    found = archive.search(heads, items, NOON, query="lat")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ExistenceJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_labels_and_unknown_status(spark):
    df = spark.createDataFrame([("needs_review",), ("odd",)], "status string")
    labels = {r.status: r.statusLabel for r in archive.status_labels(df, "de").collect()}
    assert labels == {"needs_review": "Zu prüfen", "odd": "odd"}


def test_declared_schema_field_counts():
    sizes = {n: len(s) for n, s in (
        ("receipts", model.RECEIPTS), ("items", model.RECEIPT_ITEMS), ("images", model.IMAGES),
        ("jobs", model.CLIENT_JOBS), ("settings", model.SETTINGS),
        ("audit", model.AUDIT_EVENTS), ("extraction_jobs", model.EXTRACTION_JOBS))}
    assert sizes == {"receipts": 19, "items": 13, "images": 9, "jobs": 10, "settings": 9,
                     "audit": 6, "extraction_jobs": 13}


def test_the_snapshot_hash_sees_every_figure(spark):
    heads, items = sample(spark)

    def digest(heads, items, now=NOON, locale="en-GB"):
        rows = insights.snapshot_measures(heads, items, now, locale)
        return insights.dataset_hash(rows, ["section", "id", *insights.SNAPSHOT_FIGURES],
                                     "en").first().datasetHash

    whole = digest(heads, items)
    assert whole == digest(heads.repartition(3), items.repartition(2))
    dearer = items.withColumn("unitPriceMinor", F.col("unitPriceMinor") + 1)
    more = items.withColumn("quantity", F.col("quantity") + 0.5)
    others = [digest(heads, dearer), digest(heads, more), digest(heads, items, locale="fr-FR"),
              digest(heads, items, NOON.replace(day=13))]
    assert len({whole, *others}) == 5
