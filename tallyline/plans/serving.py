"""The unified relation over both layers and the standing reports on it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import calendar, money
from tallyline.functions.ratios import is_type, percent
from tallyline.schemas import EVENT_COLUMNS, RETURN, SALE

REPORT_DAYS = 30

PRICE, QUANTITY = "unit_price", "quantity"


def sales(events: DataFrame) -> DataFrame:
    return events.where(is_type(SALE))


def _only(kind: str | None) -> str | None:
    return None if kind is None else f"transaction_type = '{kind}'"


def revenue(kind: str | None = None) -> Column:
    """Revenue of all rows, or of those of one type with the others counted as 0."""
    return money.money_sum(PRICE, QUANTITY, _only(kind))


def basket_value(kind: str | None = None) -> Column:
    """Average value of all rows; rows of another type than ``kind`` count as 0."""
    return money.money_avg(PRICE, QUANTITY, _only(kind))


def units() -> Column:
    return F.sum(QUANTITY)


def average_price() -> Column:
    return money.money_avg(PRICE)


def _not_after(bound: Column, column: str) -> Column:
    # An event whose time could not be read is only in the archive, so the archive answers for it.
    return bound | F.col(column).isNull()


def combine_layers(
    recent: DataFrame, archived: DataFrame, cutover: dt.datetime | None = None
) -> DataFrame:
    """Recent and archived events with their ``source``.

    Both layers are fed by the same topic.  With ``cutover`` the archive answers for the time
    before it and the recent table from then on, so an event held by both counts once; without it
    the two are simply put together.  ``event_date`` is kept when both layers have it, so that
    partition pruning works through the union.
    """
    columns = list(EVENT_COLUMNS)
    if "event_date" in recent.columns and "event_date" in archived.columns:
        columns.append("event_date")
    if cutover is not None:
        recent = calendar.since(recent, cutover)
        before = F.col("event_time") < calendar.instant(cutover)
        archived = archived.where(_not_after(before, "event_time"))
        if "event_date" in columns:
            archived = archived.where(
                _not_after(F.col("event_date") <= calendar.day(cutover), "event_date")
            )
    return (
        recent.select(*columns)
        .withColumn("source", F.lit("realtime"))
        .unionByName(archived.select(*columns).withColumn("source", F.lit("historical")))
    )


def combine_by_completeness(
    recent: DataFrame, archived: DataFrame, complete: Sequence[tuple[dt.date, dt.date]]
) -> DataFrame:
    """Recent and archived events with their ``source``, each date from one layer.

    The archive answers for the dates it holds in full (``complete``, ranges with both ends), the
    recent table for all others, so a date that is being loaded counts once, and the border moves
    with the loads.  Both layers carry ``event_date``, on which the ranges prune directories.
    """
    columns = [*EVENT_COLUMNS, "event_date"]
    held = F.lit(False)
    for first, last in complete:
        held = held | F.col("event_date").between(F.lit(first), F.lit(last))
    archived = archived.where(_not_after(held, "event_date"))
    return (
        recent.where(~held)
        .select(*columns)
        .withColumn("source", F.lit("realtime"))
        .unionByName(archived.select(*columns).withColumn("source", F.lit("historical")))
    )


def unified_events(unified: DataFrame) -> DataFrame:
    return unified.select(*EVENT_COLUMNS, "source")


def sales_by_category(unified: DataFrame) -> DataFrame:
    return (
        sales(unified)
        .groupBy("category", "transaction_type")
        .agg(
            F.count("*").alias("transaction_count"),
            units().alias("total_quantity"),
            revenue().alias("total_revenue"),
            average_price().alias("avg_unit_price"),
        )
    )


def sales_by_store(unified: DataFrame) -> DataFrame:
    return (
        sales(unified)
        .groupBy("store_id")
        .agg(
            F.count("*").alias("transaction_count"),
            units().alias("total_quantity"),
            revenue().alias("total_revenue"),
        )
    )


def hourly_sales_trend(unified: DataFrame) -> DataFrame:
    return (
        sales(unified)
        .groupBy(calendar.hour_bucket(F.col("event_time")).alias("hour"))
        .agg(
            F.count("*").alias("transaction_count"),
            units().alias("total_quantity"),
            revenue().alias("total_revenue"),
        )
        .orderBy(F.desc("hour"))
    )


def product_figures(unified: DataFrame) -> DataFrame:
    """Figures per product in no order, for other reports to build on."""
    return (
        sales(unified)
        .groupBy("product_id", "category")
        .agg(
            F.count("*").alias("transaction_count"),
            units().alias("total_quantity"),
            revenue().alias("total_revenue"),
            average_price().alias("avg_unit_price"),
        )
    )


def product_performance(unified: DataFrame) -> DataFrame:
    return product_figures(unified).orderBy(F.desc("total_revenue"), "product_id", "category")


def return_counts(events: DataFrame, *keys: str) -> DataFrame:
    """Per key the sale and return counts, the return rate and both values."""
    return (
        events.groupBy(*keys)
        .agg(
            F.count_if(is_type(SALE)).alias("sales_count"),
            F.count_if(is_type(RETURN)).alias("return_count"),
            revenue(SALE).alias("total_sales_revenue"),
            revenue(RETURN).alias("total_return_value"),
        )
        .withColumn("return_rate_pct", percent(F.col("return_count"), F.col("sales_count")))
    )


def return_rate(unified: DataFrame) -> DataFrame:
    return (
        return_counts(unified, "category", "product_id")
        .where(F.col("sales_count") > 0)
        .orderBy(F.desc("return_rate_pct"), "category", "product_id")
    )


def store_daily_performance(
    unified: DataFrame, as_of: dt.datetime, days: int = REPORT_DAYS
) -> DataFrame:
    """Per store and date; the average value divides by all movements, not by the sales."""
    return (
        calendar.last_days(unified, as_of, days)
        .groupBy("store_id", F.to_date("event_time").alias("date"))
        .agg(
            F.count_if(is_type(SALE)).alias("sales_transactions"),
            F.count_if(is_type(RETURN)).alias("return_transactions"),
            revenue(SALE).alias("daily_revenue"),
            basket_value(SALE).alias("avg_transaction_value"),
            units().alias("total_items_moved"),
        )
        .orderBy(F.desc("date"), F.desc("daily_revenue"), "store_id")
    )


def peak_hours(unified: DataFrame, as_of: dt.datetime, days: int = REPORT_DAYS) -> DataFrame:
    time = F.col("event_time")
    return (
        sales(calendar.last_days(unified, as_of, days))
        .groupBy(calendar.iso_weekday(time).alias("day_of_week"), F.hour(time).alias("hour"))
        .agg(
            F.count("*").alias("transaction_count"),
            revenue().alias("revenue"),
            basket_value().alias("avg_basket_value"),
        )
        .orderBy(F.desc("transaction_count"), "day_of_week", "hour")
    )
