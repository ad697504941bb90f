"""Calendar columns: ISO week labels, build days, run ids."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def iso_week(c: Column) -> Column:
    """`2026-W37`, by the ISO year; null for null."""
    d = c.cast("date")
    return F.when(d.isNotNull(), F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d)))


def build_day(c: Column) -> Column:
    """The Monday after the date's ISO week."""
    return F.date_add(F.date_trunc("week", c).cast("date"), 7)


def run_id(day: Column, hour: int) -> Column:
    """`2026-09-14T07:00Z`."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f"T{hour:02d}:00Z"))


def age_days(as_of: Column, newest: Column) -> Column:
    """Whole days since `newest`, never below 0."""
    return F.greatest(F.lit(0), F.datediff(as_of.cast("date"), newest.cast("date")))


def full_time(run: str) -> str:
    """A run id, which has no seconds, as a whole time: `2026-09-14T07:00Z` to `2026-09-14T07:00:00.000Z`."""
    return run.removesuffix("Z") + ":00.000Z"


def day_bounds(day: Column) -> tuple[Column, Column]:
    """The half-open span of a date or a text that begins with one."""
    d = F.to_date(F.substring(day.cast("string"), 1, 10))
    return d.cast("timestamp_ntz"), F.date_add(d, 1).cast("timestamp_ntz")
