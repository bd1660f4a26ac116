"""Registers every relation and report as a view, so they can be queried by name in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.rollup import DAILY, HOURLY, PRODUCT, summarise
from tallyline.plans import anomaly, forecast, serving
from tallyline.schemas import EVENT_COLUMNS


def register_views(
    spark: SparkSession,
    realtime: DataFrame,
    archived: DataFrame,
    as_of: dt.datetime,
    cutover: dt.datetime | None = None,
    predictions: DataFrame | None = None,
    metrics: DataFrame | None = None,
    rollups: dict[str, DataFrame] | None = None,
) -> list[str]:
    """Create the views and return their names.

    ``rollups`` may give stored rollups by name; the others are computed from the realtime table.
    """
    unified = serving.combine_layers(realtime, archived, cutover)
    stored = rollups or {}
    views = {
        "retail_events_realtime": realtime,
        "retail_events_historical": archived,
        "retail_events_unified": unified.select(*EVENT_COLUMNS, "source"),
        "sales_by_category": serving.sales_by_category(unified),
        "sales_by_store": serving.sales_by_store(unified),
        "hourly_sales_trend": serving.hourly_sales_trend(unified),
        "product_performance": serving.product_performance(unified),
        "daily_sales_summary": stored.get("daily", summarise(realtime, DAILY)),
        "hourly_sales_summary": stored.get("hourly", summarise(realtime, HOURLY)),
        "product_performance_summary": stored.get("product", summarise(realtime, PRODUCT)),
        "sales_anomaly_detection": anomaly.sales_anomaly_stats(realtime, as_of),
        "return_rate_analysis": serving.return_rate(unified),
        "store_performance_comparison": serving.store_daily_performance(unified, as_of),
        "peak_hours_by_day": serving.peak_hours(unified, as_of),
    }
    if predictions is not None:
        accuracy = forecast.prediction_accuracy(predictions, realtime)
        views |= {
            "demand_predictions": predictions,
            "prediction_accuracy": accuracy,
            "model_performance_summary": forecast.model_performance_summary(accuracy),
            "daily_demand_forecast": forecast.daily_demand_forecast(predictions, as_of),
            "restock_recommendations": forecast.restock_recommendations(
                predictions, realtime, as_of
            ),
        }
    if metrics is not None:
        views["model_metrics"] = metrics
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    return sorted(views)


def catalog_list(spark: SparkSession) -> DataFrame:
    """Names of the relations of the current database and session, sorted."""
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("name")).orderBy("name")


def relation_counts(**relations: DataFrame) -> DataFrame:
    """Row count of each named relation."""
    counts = [
        rows.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("name"), "row_count")
        for name, rows in relations.items()
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


def preview(unified: DataFrame, rows: int = 10) -> DataFrame:
    """A few rows, the earliest ones."""
    return unified.orderBy(*EVENT_COLUMNS).limit(rows).select(*EVENT_COLUMNS, "source")
