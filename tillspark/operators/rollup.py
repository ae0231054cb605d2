"""Spending by day, category and merchant, kept up to date by differences.

The comparisons of any period follow from the rows of its days, and an edit changes at most two
rows: the one it leaves and the one it enters. Totals and counts are whole numbers, so sums of
differences are exact in any order.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tillspark.functions import dates
from tillspark.operators.insights import CATEGORY, MERCHANT, spending_keys, usable, with_change

KEYS = ["day", CATEGORY, MERCHANT]
SCHEMA = "day string, category string, merchant string, total long, receipts long"


def daily(receipts: DataFrame) -> DataFrame:
    """Total and number of the usable receipts of each real day, category and merchant."""
    day = F.col("transactionDate")
    kept = usable(receipts).where(dates.is_real_date(day))
    keyed = kept.withColumns({"day": day, **spending_keys()})
    return keyed.groupBy(*KEYS).agg(
        F.sum("totalMinor").alias("total"), F.count(F.lit(1)).alias("receipts"))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """What replacing the versions ``before`` by ``after`` changes; deleted ones have no after."""
    taken = daily(before).withColumns({"total": -F.col("total"), "receipts": -F.col("receipts")})
    return merged(taken, daily(after), keep_all=True).where("total <> 0 OR receipts <> 0")


def merged(left: DataFrame, right: DataFrame, keep_all: bool = False) -> DataFrame:
    """Sums of two rollups; a key without receipts disappears unless ``keep_all``."""
    both = left.select(*KEYS, "total", "receipts").unionByName(
        right.select(*KEYS, "total", "receipts"))
    sums = both.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("total", "receipts")])
    return sums if keep_all else sums.where("receipts <> 0")


def _periods(rollup: DataFrame, now: datetime) -> DataFrame:
    period, day = dates.comparable_period(now), F.col("day")
    current = dates.text_between(day, period.start, period.last_counted)
    previous = dates.text_between(day, period.previous_start, period.previous_end)
    return rollup.where(current | previous).withColumn("in_current", current)


def _measures() -> list[Column]:
    def total(name: str, current: Column) -> Column:
        return F.coalesce(F.sum(F.when(current, F.col(name))), F.lit(0))

    now = F.col("in_current")
    return [total("total", now).alias("total"), total("receipts", now).alias("count"),
            total("total", ~now).alias("previousTotal")]


def comparison(rollup: DataFrame, now: datetime, dimension: str) -> DataFrame:
    """The same rows as the comparison of the receipts themselves."""
    return with_change(_periods(rollup, now).groupBy(F.col(dimension).alias("id"))
                       .agg(*_measures()))


def period_totals(rollup: DataFrame, now: datetime) -> DataFrame:
    """The same row as the totals of the receipts themselves."""
    period = dates.comparable_period(now)
    bounds = {"start": period.start, "end": period.end,
              "previousStart": period.previous_start, "previousEnd": period.previous_end}
    totals = with_change(_periods(rollup, now).agg(*_measures()).drop("count"))
    return totals.withColumns({k: F.lit(v.isoformat()) for k, v in bounds.items()})
