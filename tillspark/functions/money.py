"""Amounts are integers in minor units; these are the few places they leave that form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def half_up(value: Column) -> Column:
    """Round half towards plus infinity, as a long."""
    return F.floor(value + F.lit(0.5)).cast("long")


def percent_change(current: Column, previous: Column) -> Column:
    """0 when both are 0, unknown when only the previous is 0."""
    return (
        F.when(previous == 0, F.when(current == 0, F.lit(0.0)))
        .otherwise((current - previous).cast("double") / previous.cast("double") * F.lit(100.0))
    )


def to_minor(text: Column) -> Column:
    """Form text to minor units: empty, null and non-numbers give null, blanks only give 0."""
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    number = F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))
    number = F.when((text != "") & (trimmed == ""), F.lit(0.0)).otherwise(number)
    return F.when(F.abs(number) < F.lit(float("inf")), half_up(number * 100))


def to_euro(minor: Column) -> Column:
    """Two decimals; null gives the empty text."""
    sign = F.when(minor < 0, F.lit("-")).otherwise(F.lit(""))
    magnitude = F.abs(minor)
    cents = F.lpad((magnitude % 100).cast("string"), 2, "0")
    units = ((magnitude - magnitude % 100) / 100).cast("long").cast("string")
    return F.coalesce(F.concat(sign, units, F.lit("."), cents), F.lit(""))


def one_decimal(value: Column) -> Column:
    """Magnitude with at most one decimal, e.g. ``12`` or ``12.5``."""
    tenths = half_up(F.abs(value) * 10)
    fraction = (tenths % 10).cast("string")
    units = F.floor(tenths / 10).cast("long").cast("string")
    return F.when(tenths % 10 == 0, units).otherwise(F.concat(units, F.lit("."), fraction))


def signed_percent(value: Column) -> Column:
    """``+12.5%``, ``-3%``; an unknown change gives a dash."""
    sign = F.when(value > 0, F.lit("+")).when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.coalesce(F.concat(sign, one_decimal(value), F.lit("%")), F.lit("—"))


def signed_money(minor: Column, currency: str = "EUR") -> Column:
    """An unknown amount shows as zero."""
    minor = F.coalesce(minor, F.lit(0))
    sign = F.when(minor > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, to_euro(minor), F.lit(f" {currency}"))
