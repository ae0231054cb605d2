"""The day rollup against the comparison of the receipts, over random edits."""

import random
from datetime import datetime, timedelta

import pytest

from tests.test_insights import RECEIPT
from tillspark.operators import insights, rollup
from tillspark.plans import registry
from tillspark.session import work_dir
from tillspark.sources.rollups import Rollups

NOW = datetime(2026, 7, 14, 12)


def _row(dice, number):
    day = (datetime(2026, 5, 25) + timedelta(days=dice.randrange(60))).strftime("%Y-%m-%d")
    return (str(number), dice.choice([day, day, day, None, "", "2026-06-31", "no day"]),
            dice.choice([None, -5, 0, 100, 2500]), dice.choice(["a", "b", "", None]),
            dice.choice(["Shop", "", None]), dice.choice(["Raw", None]))


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_rollup_equals_the_receipts_after_edits(spark, seed):
    dice = random.Random(seed)
    state = {n: _row(dice, n) for n in range(60)}
    store = Rollups(spark, work_dir(spark, "rollup-test"))
    store.apply(rollup.daily(spark.createDataFrame(list(state.values()), RECEIPT)), 0)
    for batch in (1, 2):
        hit = dice.sample(sorted(state), 15)
        before = [state.pop(n) for n in hit]
        new = {n: _row(dice, n) for n in (*hit[:9], 100 * batch, 100 * batch + 1)}
        state |= new
        change = rollup.differences(spark.createDataFrame(before, RECEIPT),
                                    spark.createDataFrame(list(new.values()), RECEIPT))
        store.apply(change, batch)
        store.apply(change, batch)  # a repeated batch changes nothing
    heads = spark.createDataFrame(list(state.values()), RECEIPT)
    for dimension in (insights.CATEGORY, insights.MERCHANT):
        assert _rows(rollup.comparison(store.of_period(NOW), NOW, dimension)) \
            == _rows(insights.comparison(heads, NOW, dimension))
    assert _rows(rollup.period_totals(store.of_period(NOW), NOW)) \
        == _rows(insights.period_totals(heads, NOW))
    assert _rows(store.read()) == _rows(rollup.daily(heads).select(*store.read().columns))


def test_a_batch_rewrites_its_months_only_and_vacuum_keeps_the_table(spark):
    def receipts(*rows):
        return spark.createDataFrame([(i, d, t, "a", "S", "S") for i, d, t in rows], RECEIPT)

    store = Rollups(spark, work_dir(spark, "rollup-test"))
    store.apply(rollup.daily(receipts(("1", "2026-05-02", 5), ("2", "2026-06-02", 7),
                                      ("3", "2026-07-02", 9))), 0)
    old = store.manifest()["months"]
    store.apply(rollup.differences(receipts(("2", "2026-06-02", 7)), receipts()), 1)
    now = store.manifest()["months"]
    assert now == {m: old[m] for m in ("2026-05", "2026-07")}  # June is empty and gone
    files = store.of_period(NOW).inputFiles()
    assert files and all("month=2026-07" in f for f in files)
    whole = _rows(store.read())
    store.vacuum()
    assert _rows(store.read()) == whole and "month=2026-06" not in store.listed("run-1")


def test_an_empty_table_has_a_rollup(spark):
    store = Rollups(spark, work_dir(spark, "rollup-test"))
    store.apply(rollup.daily(spark.createDataFrame([], RECEIPT)), 0)
    assert store.read().count() == 0
    assert rollup.period_totals(store.of_period(NOW), NOW).first().total == 0


@pytest.mark.parametrize("name", ["period_totals", "category_comparison", "merchant_comparison",
                                  "comparison_grouping_sets", "product_totals"])
def test_comparisons_push_their_days_to_the_scan(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.split("\n")
              if "PushedFilters" in line and "o_orderdate" in line]
    assert pushed and "GreaterThanOrEqual(o_orderdate" in pushed[0] \
        and "LessThan(o_orderdate" in pushed[0]
