"""Live reports on the realtime table and the overview figures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import calendar, money, text
from tallyline.plans.serving import basket_value, revenue, sales, units
from tallyline.schemas import EVENT_COLUMNS


def home_kpis(unified: DataFrame) -> DataFrame:
    """Transactions, revenue, distinct products and distinct stores of all sales.

    Two distinct counts over raw rows would multiply every row by two.  One row per product and
    store answers both, and map-side aggregation builds those rows before the shuffle.
    """
    per_pair = (
        sales(unified)
        .groupBy("product_id", "store_id")
        .agg(
            F.count("*").alias("n"),
            *money.partial_sums("revenue", "unit_price", "quantity"),
        )
    )
    return per_pair.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_transactions"),
        money.amount("revenue", summed=True).alias("total_revenue"),
        F.countDistinct("product_id").alias("unique_products"),
        F.countDistinct("store_id").alias("unique_stores"),
    )


def data_freshness(realtime: DataFrame) -> DataFrame:
    return realtime.agg(
        F.max("event_time").alias("latest_event"),
        F.count("*").alias("total_records"),
        F.max("inserted_at").alias("latest_insert"),
    )


def latest_events(realtime: DataFrame, rows: int = 5) -> DataFrame:
    """The rows stored last; ties at the same second are broken by the rest of the row."""
    ties = [F.desc("event_time"), *EVENT_COLUMNS[1:]]
    newest = realtime.orderBy(F.desc("inserted_at"), *ties).limit(rows)
    return newest.select(
        *EVENT_COLUMNS,
        (F.col("quantity") * F.col("unit_price")).alias("total_value"),
        "inserted_at",
        text.type_label(F.col("transaction_type")).alias("type_label"),
    )


def realtime_kpis(realtime: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    return sales(calendar.last_hours(realtime, as_of, hours)).agg(
        F.count("*").alias("total_transactions"),
        revenue().alias("total_revenue"),
        basket_value().alias("avg_basket_value"),
        units().alias("total_quantity"),
    )


def realtime_hourly(realtime: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    return (
        sales(calendar.last_hours(realtime, as_of, hours))
        .groupBy(calendar.hour_bucket(F.col("event_time")).alias("hour"))
        .agg(revenue().alias("revenue"), F.count("*").alias("transactions"))
        .orderBy("hour")
    )


def realtime_by_category(realtime: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    return (
        sales(calendar.last_hours(realtime, as_of, hours))
        .groupBy("category")
        .agg(revenue().alias("revenue"), F.count("*").alias("transactions"))
        .orderBy(F.desc("revenue"), "category")
    )


def realtime_by_store(
    realtime: DataFrame, as_of: dt.datetime, hours: int = 24, top: int = 10
) -> DataFrame:
    return (
        sales(calendar.last_hours(realtime, as_of, hours))
        .groupBy("store_id")
        .agg(revenue().alias("revenue"), F.count("*").alias("transactions"))
        .orderBy(F.desc("revenue"), "store_id")
        .limit(top)
    )


def top_products(
    realtime: DataFrame, as_of: dt.datetime, hours: int = 24, top: int = 15
) -> DataFrame:
    return (
        sales(calendar.last_hours(realtime, as_of, hours))
        .groupBy("product_id", "category")
        .agg(
            revenue().alias("revenue"),
            units().alias("quantity_sold"),
            F.count("*").alias("transactions"),
        )
        .orderBy(F.desc("revenue"), "product_id", "category")
        .limit(top)
    )


def monthly_distribution(realtime: DataFrame) -> DataFrame:
    return (
        realtime.groupBy(calendar.month_number(F.col("event_time")).alias("month"))
        .agg(F.count("*").alias("events"))
        .orderBy("month")
    )


def event_span(realtime: DataFrame) -> DataFrame:
    return realtime.agg(
        F.count("*").alias("events"),
        F.min("event_time").alias("first_event"),
        F.max("event_time").alias("last_event"),
    )
