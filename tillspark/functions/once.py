"""Columns that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once.

    A plain projection would be copied into each filter and column that uses it; the
    generator of a one-element array is a border that Catalyst does not move them across.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, within one expression: no row holds the value."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
