"""Stock movement, demand and restock priority."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import calendar
from tallyline.functions.ratios import is_type, ratio
from tallyline.operators.newest import coming_forecasts
from tallyline.plans.serving import revenue, sales, units
from tallyline.schemas import RESTOCK, RETURN, SALE

# Report labels and the factors on a week of average sales that separate them.
HIGH_PRIORITY, NORMAL_PRIORITY, LOW_PRIORITY = "High Priority", "Normal", "Low Priority"
HIGH_FACTOR, NORMAL_FACTOR = 1.2, 0.8


def stock_movement(unified: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    return (
        calendar.last_days(unified, as_of, days)
        .groupBy("transaction_type")
        .agg(
            F.count("*").alias("transaction_count"),
            units().alias("total_quantity"),
            revenue().alias("total_value"),
        )
        .orderBy(F.desc("total_quantity"), "transaction_type")
    )


def _units_of(kind: str) -> Column:
    return F.sum(F.when(is_type(kind), F.col("quantity")).otherwise(0))


def net_stock_movement(unified: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Restocked less sold plus returned units, with the direction."""
    moved = calendar.last_days(unified, as_of, days).agg(
        F.coalesce(_units_of(SALE), F.lit(0)).alias("sales_qty"),
        F.coalesce(_units_of(RETURN), F.lit(0)).alias("return_qty"),
        F.coalesce(_units_of(RESTOCK), F.lit(0)).alias("restock_qty"),
    )
    net = F.col("restock_qty") - F.col("sales_qty") + F.col("return_qty")
    direction = F.when(F.col("net_movement") > 0, "Increase").otherwise("Decrease")
    return moved.withColumn("net_movement", net).withColumn("direction", direction)


def predicted_by_product(
    predictions: DataFrame, as_of: dt.datetime, all_versions: bool = False
) -> DataFrame:
    return (
        coming_forecasts(predictions, as_of, all_versions)
        .groupBy("product_id")
        .agg(F.sum("predicted_demand").alias("predicted_7d"))
    )


def high_demand_products(
    unified: DataFrame,
    predictions: DataFrame,
    as_of: dt.datetime,
    top: int = 20,
    all_versions: bool = False,
) -> DataFrame:
    """Most sold products with their forecast.

    The top products are chosen before the join: the forecast side has one row per product and
    cannot change the order.
    """
    sold = (
        sales(calendar.last_days(unified, as_of, 30))
        .groupBy("product_id", "category")
        .agg(units().alias("total_sold_30d"), F.count("*").alias("transaction_count"))
    )
    order = [F.desc("total_sold_30d"), F.col("product_id"), F.col("category")]
    best = sold.orderBy(*order).limit(top)
    return (
        best.join(predicted_by_product(predictions, as_of, all_versions), "product_id", "left")
        .select(
            "product_id",
            "category",
            "total_sold_30d",
            F.coalesce("predicted_7d", F.lit(0.0)).alias("predicted_7d"),
            "transaction_count",
            (F.col("total_sold_30d") / 30.0).alias("avg_daily_sales"),
        )
        .orderBy(*order)
    )


def slow_moving_products(unified: DataFrame, as_of: dt.datetime, top: int = 20) -> DataFrame:
    """Lowest daily sales; active days are the date span from first to last sale."""
    span = F.datediff(F.to_date(F.max("event_time")), F.to_date(F.min("event_time")))
    return (
        sales(calendar.last_days(unified, as_of, 30))
        .groupBy("product_id", "category")
        .agg(
            units().alias("total_sold_30d"),
            F.count("*").alias("transaction_count"),
            span.alias("days_active"),
        )
        .where((F.col("total_sold_30d") > 0) & (F.col("days_active") > 5))
        .withColumn("avg_daily_sales", ratio(F.col("total_sold_30d"), F.col("days_active")))
        .orderBy("avg_daily_sales", "product_id", "category")
        .limit(top)
    )


def restock_priority(
    unified: DataFrame,
    predictions: DataFrame,
    as_of: dt.datetime,
    top: int | None = 50,
    all_versions: bool = False,
) -> DataFrame:
    """Forecast against a week of average sales; without a forecast the priority is low."""
    sold = (
        sales(calendar.last_days(unified, as_of, 30))
        .groupBy("product_id")
        .agg(units().alias("total_sold_30d"))
        .where(F.col("total_sold_30d") > 0)
    )
    week = F.col("total_sold_30d") / 30 * 7
    predicted = F.col("predicted_7d")
    label = (
        F.when(predicted > week * HIGH_FACTOR, HIGH_PRIORITY)
        .when(predicted > week * NORMAL_FACTOR, NORMAL_PRIORITY)
        .otherwise(LOW_PRIORITY)
    )
    rows = (
        sold.join(predicted_by_product(predictions, as_of, all_versions), "product_id", "left")
        .withColumn("priority", label)
        .select(
            "product_id",
            "total_sold_30d",
            F.coalesce("predicted_7d", F.lit(0.0)).alias("predicted_7d"),
            "priority",
        )
        .orderBy(F.desc("predicted_7d"), "product_id")
    )
    return rows if top is None else rows.limit(top)


def restock_priority_counts(
    unified: DataFrame,
    predictions: DataFrame,
    as_of: dt.datetime,
    top: int | None = 50,
    all_versions: bool = False,
) -> DataFrame:
    rows = restock_priority(unified, predictions, as_of, top, all_versions)
    return rows.agg(
        F.count_if(F.col("priority") == HIGH_PRIORITY).alias("high_priority"),
        F.count_if(F.col("priority") == NORMAL_PRIORITY).alias("normal_priority"),
        F.count_if(F.col("priority") == LOW_PRIORITY).alias("low_priority"),
    )


def category_stock_status(unified: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    net = F.col("total_restocked") - F.col("total_sold") + F.col("total_returned")
    return (
        calendar.last_days(unified, as_of, days)
        .groupBy("category")
        .agg(
            F.count_if(is_type(SALE)).alias("sales_count"),
            F.count_if(is_type(RETURN)).alias("return_count"),
            F.count_if(is_type(RESTOCK)).alias("restock_count"),
            _units_of(SALE).alias("total_sold"),
            _units_of(RETURN).alias("total_returned"),
            _units_of(RESTOCK).alias("total_restocked"),
        )
        .withColumn("net_stock_change", net)
        .orderBy(F.desc("total_sold"), "category")
    )
