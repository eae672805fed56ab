"""Dates: formats, clamping to a pinned now, differences in whole days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats in the order they are tried, as (pattern of the whole text, format).
FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "M-d-yy"),
]


def parse_date(text: Column, formats: list[tuple[str, str]] | None = None) -> Column:
    """The date in the first format that fits, else null; impossible dates are null."""
    t = F.trim(text)
    tries = [F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f))) for p, f in formats or FORMATS]
    return F.coalesce(*tries).cast("date")


def iso_date(text: Column) -> Column:
    """The date in the first ten characters of an ISO text."""
    return F.substring(F.trim(text), 1, 10).try_cast("date")


def not_after(day: Column, now: Column) -> Column:
    """A day after ``now`` becomes ``now``; null stays."""
    return F.when(day.isNotNull(), F.least(day, now))


def transaction_day(traded: Column, notified: Column, filed: Column, now: Column) -> Column:
    """The trade's date, else the notification's, else the filing's: the first that is not in the future."""
    return F.coalesce(*[F.when(d <= now, d) for d in (traded, notified, filed)])


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def ordinal_day(day: Column) -> Column:
    """Days counted from 0001-01-01 as day 1."""
    return F.datediff(day, F.lit("0001-01-01").cast("date")) + 1
