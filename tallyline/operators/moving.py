"""Moving statistics over hourly revenue.

The window never sees raw events: they are first aggregated to one row per category and hour, so a
window partition holds at most 24 rows per day of history however many events a category has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import calendar, money
from tallyline.functions.ratios import is_type
from tallyline.schemas import SALE

PRECEDING_ROWS = 24


def hourly_revenue(events: DataFrame) -> DataFrame:
    return (
        events.where(is_type(SALE))
        .groupBy("category", calendar.hour_bucket(F.col("event_time")).alias("hour"))
        .agg(money.money_sum("unit_price", "quantity").alias("hourly_revenue"))
    )


def fill_missing_hours(hourly: DataFrame) -> DataFrame:
    """Hours without sales between the first and last hour of a category, with revenue 0."""
    spans = hourly.groupBy("category").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    spine = spans.select(
        "category",
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"),
    )
    return spine.join(hourly, ["category", "hour"], "left").select(
        "category", "hour", F.coalesce("hourly_revenue", F.lit(0.0)).alias("hourly_revenue")
    )


def moving_stats(hourly: DataFrame, fill_gaps: bool = False) -> DataFrame:
    """Mean and population deviation of this row and the 24 rows before it, per category.

    The frame counts rows, so an hour without sales is not there unless ``fill_gaps`` is set.
    """
    if fill_gaps:
        hourly = fill_missing_hours(hourly)
    frame = Window.partitionBy("category").orderBy("hour").rowsBetween(-PRECEDING_ROWS, 0)
    return hourly.select(
        "category",
        "hour",
        "hourly_revenue",
        F.avg("hourly_revenue").over(frame).alias("moving_avg_24h"),
        F.stddev_pop("hourly_revenue").over(frame).alias("std_dev_24h"),
    )
