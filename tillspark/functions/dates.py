"""Comparable periods and the date texts they apply to.

A transaction date is text. Only ``YYYY-MM-DD`` naming a real day counts as a date. Range
tests are written on the text as well, so that they reach the Parquet statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Period:
    """Month to date and the same days of the month before."""

    start: date
    end: date
    last_counted: date
    previous_start: date
    previous_end: date


def comparable_period(now: datetime) -> Period:
    """Dates stand for noon, so the day of ``now`` counts only from 12:00 on."""
    today = now.date()
    start = today.replace(day=1)
    previous_last = start - timedelta(days=1)
    previous_start = previous_last.replace(day=1)
    previous_end = previous_start.replace(day=min(today.day, previous_last.day))
    counted = today if now.time() >= time(12) else today - timedelta(days=1)
    return Period(start, today, counted, previous_start, previous_end)


def real_date(text: Column) -> Column:
    """The day a text names, or null."""
    day = text.try_cast("date")
    return F.when(day.cast("string") == text, day)


def is_real_date(text: Column) -> Column:
    return F.coalesce(text.try_cast("date").cast("string") == text, F.lit(False))


def text_between(text: Column, first: date, last: date) -> Column:
    """Range test of a text that is known to be a date."""
    return (text >= F.lit(first.isoformat())) & (text <= F.lit(last.isoformat()))


def between(text: Column, first: date, last: date) -> Column:
    return text_between(text, first, last) & is_real_date(text)


def in_current(text: Column, period: Period) -> Column:
    return between(text, period.start, period.last_counted)


def display_date(text: Column, unknown: Column) -> Column:
    """Day, short month and year; an empty value gives the given label."""
    day = F.coalesce(real_date(text), F.try_to_timestamp(text).cast("date"))
    return F.when(F.coalesce(text, F.lit("")) == "", unknown).otherwise(
        F.date_format(day, "dd MMM yyyy"))


def iso_millis(moment: datetime) -> str:
    """Client time stamps carry milliseconds."""
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


def iso_micros(moment: datetime) -> str:
    """Server time stamps carry microseconds, or none when they are zero."""
    return moment.isoformat() + "Z"
