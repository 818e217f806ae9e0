"""Elapsed time and period buckets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(as_of: str | dt.datetime) -> Column:
    """A literal point in time (UTC)."""
    text = as_of if isinstance(as_of, str) else as_of.strftime("%Y-%m-%d %H:%M:%S")
    return F.to_timestamp(F.lit(text))


def seconds_between(end: Column, start: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def whole_days(end: Column, start: Column) -> Column:
    """Elapsed days, floored, so half a day back is -1."""
    return F.floor(seconds_between(end, start) / 86400).cast("long")


def fractional_days(end: Column, start: Column) -> Column:
    return seconds_between(end, start) / 86400


def period(ts: Column, freq: str) -> Column:
    """Start of the day, Monday week or month holding `ts`."""
    unit = {"D": "day", "W": "week", "M": "month"}[freq]
    return F.date_trunc(unit, ts).cast("date")
