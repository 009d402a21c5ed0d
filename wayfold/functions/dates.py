"""Dates: labels, ages, month buckets. ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy, hh:mm a")


def zoned_date(ts: Column, zone: str = "America/New_York") -> Column:
    """Date and time of day in a zone; ``ts`` is in UTC."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "MMMM d, yyyy 'at' hh:mm a")


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def age(ts: Column, now: Column) -> Column:
    """``just now``, then minutes, hours and days, and the day itself after a week."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "m")).when(hours < 24, said(hours, "h")).when(days < 7, said(days, "d")).otherwise(iso_day(ts))


def is_stale(refreshed: Column, now: Column, minutes: int = 5) -> Column:
    """Refreshed longer ago than that, or never."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(refreshed) > minutes * 60, F.lit(True))


def end_of_day(day: str) -> Column:
    """The last millisecond of a day."""
    return F.to_timestamp(F.lit(f"{day} 23:59:59.999"))
