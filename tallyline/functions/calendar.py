"""Calendar parts, season flags and range predicates that reach the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Months counted as holiday season and as summer, and the day names 1 = Monday.
HOLIDAY_MONTHS = (11, 12)
SUMMER_MONTHS = (6, 7, 8)
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def instant(at: dt.datetime) -> Column:
    """A timestamp literal read in the session time zone, not in that of the Python process."""
    return F.expr(f"TIMESTAMP '{at:%Y-%m-%d %H:%M:%S}'")


def day(at: dt.datetime) -> Column:
    return F.expr(f"DATE '{at:%Y-%m-%d}'")


def midnight(at: dt.datetime) -> dt.datetime:
    return dt.datetime(at.year, at.month, at.day)


def hour_bucket(time: Column) -> Column:
    return F.date_trunc("hour", time)


def iso_weekday(time: Column) -> Column:
    """1 = Monday … 7 = Sunday."""
    return F.weekday(time) + 1


def is_weekend(time: Column) -> Column:
    return F.coalesce(F.weekday(time) >= 5, F.lit(False))


def day_name(iso_day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in DAY_NAMES]), iso_day)


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def holiday_season(month: Column) -> Column:
    return flag(month.isin(*HOLIDAY_MONTHS))


def summer(month: Column) -> Column:
    return flag(month.isin(*SUMMER_MONTHS))


def month_number(time: Column) -> Column:
    """2024-01-31 → 202401."""
    return F.year(time) * 100 + F.month(time)


def version_stamp(at: dt.datetime) -> str:
    return at.strftime("%Y%m%d_%H%M%S")


def since(events: DataFrame, start: dt.datetime) -> DataFrame:
    """Events from ``start`` on.

    The predicate is a plain comparison with the stored column, so Parquet row groups are skipped.
    Where the relation carries its date partition, the same bound is put on that, so whole
    directories are skipped: ``event_time >= x`` alone prunes none.
    """
    kept = events.where(F.col("event_time") >= instant(start))
    if "event_date" in events.columns:
        kept = kept.where(F.col("event_date") >= day(start))
    return kept


def before(events: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Events earlier than ``as_of``, which stands for now: later ones are not known yet."""
    kept = events.where(F.col("event_time") < instant(as_of))
    if "event_date" in events.columns:
        kept = kept.where(F.col("event_date") <= day(as_of))
    return kept


def last_hours(events: DataFrame, as_of: dt.datetime, hours: int) -> DataFrame:
    """Events of the ``hours`` before ``as_of``."""
    return before(since(events, as_of - dt.timedelta(hours=hours)), as_of)


def last_days(events: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Events before ``as_of`` whose date is at most ``days`` before its date."""
    return before(since(events, midnight(as_of) - dt.timedelta(days=days)), as_of)


def forecast_window(predictions: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Forecasts for the date of ``as_of`` and the ``days`` dates after it."""
    first = midnight(as_of)
    return predictions.where(
        F.col("forecast_date").between(day(first), day(first + dt.timedelta(days=days)))
    )
