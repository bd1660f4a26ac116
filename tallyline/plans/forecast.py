"""Reports on stored demand predictions, alone and against what was sold."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import calendar
from tallyline.functions.ratios import percent, ratio
from tallyline.operators.newest import coming_forecasts
from tallyline.operators.quantiles import (
    aggregate_with_quantiles,
    quantiles_from_sketches,
    value_sketches,
)
from tallyline.plans.serving import sales, units

# Restock labels in the order they are tested, with the bound on the demand ratio.
HIGH_DEMAND, MODERATE_INCREASE = "HIGH_DEMAND", "MODERATE_INCREASE"
LOW_DEMAND, NORMAL = "LOW_DEMAND", "NORMAL"
HIGH_RATIO, MODERATE_RATIO, LOW_RATIO = 1.5, 1.2, 0.8

HISTORY_DAYS = 30
HOUR_KEYS = ["product_id", "store_id", "forecast_date", "forecast_hour"]
ERROR_QUANTILES = {"median_percentage_error": 0.5, "p90_percentage_error": 0.9}


def actual_demand(realtime: DataFrame) -> DataFrame:
    """Units sold per product, store, date and hour."""
    time = F.col("event_time")
    return (
        sales(realtime)
        .groupBy(
            "product_id",
            "store_id",
            F.to_date(time).alias("forecast_date"),
            F.hour(time).alias("forecast_hour"),
        )
        .agg(units().alias("actual_demand"))
    )


def _in_forecast_dates(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Events of the dates from the first to the last forecast."""
    bounds = predictions.agg(F.min("forecast_date").alias("first"), F.max("forecast_date").alias("last")).first()
    if bounds.first is None:
        return events.where(F.lit(False))
    start, end = (dt.datetime.combine(d, dt.time()) for d in (bounds.first, bounds.last))
    return calendar.before(calendar.since(events, start), end + dt.timedelta(days=1))


def prediction_accuracy(predictions: DataFrame, realtime: DataFrame) -> DataFrame:
    """Predictions that met an actual hour, with absolute and percentage error.

    Of the events only the dates between the first and the last forecast are read: their bounds come
    from the predictions, by a job of two values, and reach the scan.  Both sides are keyed by
    product, store, date and hour; the grouped side is already distributed that way, so only the
    predictions are shuffled for the join.
    """
    return errors_against(predictions, actual_demand(_in_forecast_dates(realtime, predictions)))


def errors_against(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Predictions next to stored actuals of the same hour.  Tables that are both bucketed by
    :data:`HOUR_KEYS` (``sources.bucketed``) are joined without a shuffle."""
    keys = HOUR_KEYS
    error = F.abs(F.col("predicted_demand") - F.col("actual_demand"))
    return (
        predictions.select(*keys, "predicted_demand", "model_version", "prediction_time")
        .join(actuals, keys)
        .withColumn("absolute_error", error)
        .withColumn("percentage_error", percent(F.col("absolute_error"), F.col("actual_demand")))
        .select(
            *keys,
            "predicted_demand",
            "actual_demand",
            "absolute_error",
            "percentage_error",
            "model_version",
            "prediction_time",
        )
    )


def model_performance_summary(accuracy: DataFrame) -> DataFrame:
    """Per model version: counts, mean errors, exact median and 90th percentile."""
    errors = aggregate_with_quantiles(
        accuracy,
        "model_version",
        [
            F.count("*").alias("predictions_made"),
            F.count("actual_demand").alias("predictions_with_actual"),
            F.count("absolute_error").alias("_errors"),
            F.sum("absolute_error").alias("_error"),
            F.count("percentage_error").alias("_percentages"),
            F.sum("percentage_error").alias("_percentage"),
        ],
        "percentage_error",
        ERROR_QUANTILES,
    )
    return errors.select(
        "model_version",
        "predictions_made",
        "predictions_with_actual",
        F.try_divide("_error", "_errors").alias("avg_absolute_error"),
        F.try_divide("_percentage", "_percentages").alias("avg_percentage_error"),
        *ERROR_QUANTILES,
    ).orderBy(F.desc("model_version"))


def store_error_sketches(accuracy: DataFrame, table: str) -> None:
    """Sketches of the percentage errors per version and date, one row each, to be merged by readers."""
    value_sketches(accuracy, ["model_version", "forecast_date"], "percentage_error").write.mode(
        "append"
    ).parquet(table)


def model_performance_sketched(sketches: DataFrame) -> DataFrame:
    """The summary of percentage errors from stored sketches, without their predictions: counts and
    mean are exact, the ranks of the quantiles are within ``quantiles.RANK_ERROR``."""
    found = quantiles_from_sketches(sketches, "model_version", ERROR_QUANTILES)
    return found.select(
        "model_version",
        F.col("rows").alias("predictions_made"),
        F.try_divide("total", "n").alias("avg_percentage_error"),
        *ERROR_QUANTILES,
    )


def model_history(accuracy: DataFrame, versions: int = 5) -> DataFrame:
    """The newest versions with their errors."""
    return (
        model_performance_summary(accuracy)
        .select(
            "model_version",
            "avg_percentage_error",
            "median_percentage_error",
            "predictions_made",
        )
        .orderBy(F.desc("model_version"))
        .limit(versions)
    )


def ml_metrics_sql(accuracy: DataFrame) -> DataFrame:
    """Root mean square error, mean absolute error and R² per version, as plain aggregates."""
    actual, predicted = F.col("actual_demand"), F.col("predicted_demand")
    squared = F.sum((predicted - actual) * (predicted - actual))
    spread = F.sum(actual * actual) - F.sum(actual) * F.sum(actual) / F.count("*")
    return accuracy.groupBy("model_version").agg(
        F.count("*").alias("samples"),
        F.sqrt(squared / F.count("*")).alias("rmse"),
        F.avg(F.abs(predicted - actual)).alias("mae"),
        (1 - F.try_divide(squared, spread)).alias("r2_score"),
    )


def daily_demand_forecast(predictions: DataFrame, as_of: dt.datetime) -> DataFrame:
    demand = "predicted_demand"
    return (
        predictions.where(F.col("forecast_date") >= calendar.day(as_of))
        .groupBy("forecast_date", "product_id", "store_id", "model_version")
        .agg(
            F.sum(demand).alias("total_daily_demand"),
            F.min(demand).alias("min_hourly_demand"),
            F.max(demand).alias("max_hourly_demand"),
            F.avg(demand).alias("avg_hourly_demand"),
            F.max("prediction_time").alias("latest_prediction_time"),
        )
        .orderBy("forecast_date", F.desc("total_daily_demand"), "product_id", "store_id")
    )


def average_sale(realtime: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Average units per sale of each product and store over the last 30 days."""
    recent = calendar.last_hours(realtime, as_of, 24 * HISTORY_DAYS)
    return (
        sales(recent).groupBy("product_id", "store_id").agg(F.avg("quantity").alias("historical_avg"))
    )


def restock_label(demand_ratio: Column) -> Column:
    """A missing ratio, and anything from 0.8 to 1.2, is normal."""
    return (
        F.when(demand_ratio > HIGH_RATIO, HIGH_DEMAND)
        .when(demand_ratio > MODERATE_RATIO, MODERATE_INCREASE)
        .when(demand_ratio < LOW_RATIO, LOW_DEMAND)
        .otherwise(NORMAL)
    )


def _demand_against_history(
    predictions: DataFrame, realtime: DataFrame, as_of: dt.datetime, all_versions: bool, *keys: str
) -> DataFrame:
    """Predicted demand per key next to the average sale of its product and store.

    The hours are summed before the join, which then moves one row per key.  The ratio sets demand
    per key against units per sale; the two differ in kind, and the report is defined that way.
    """
    demand = (
        coming_forecasts(predictions, as_of, all_versions)
        .groupBy(*keys)
        .agg(F.sum("predicted_demand").alias("predicted"))
        .where(F.col("predicted") > 0)
    )
    history = average_sale(realtime, as_of)
    return demand.join(history, ["product_id", "store_id"], "left").withColumn(
        "demand_ratio", ratio(F.col("predicted"), F.col("historical_avg"))
    )


def restock_recommendations(
    predictions: DataFrame,
    realtime: DataFrame,
    as_of: dt.datetime,
    labels: Sequence[str] | None = None,
    all_versions: bool = False,
) -> DataFrame:
    keys = ("product_id", "store_id", "forecast_date")
    rows = _demand_against_history(predictions, realtime, as_of, all_versions, *keys).select(
        *keys,
        F.col("predicted").alias("predicted_demand_7d"),
        F.col("historical_avg").alias("historical_avg_7d"),
        "demand_ratio",
        restock_label(F.col("demand_ratio")).alias("recommendation"),
    )
    if labels:
        rows = rows.where(F.col("recommendation").isin(*labels))
    return rows.orderBy(F.desc("demand_ratio"), *keys)


def restock_7d(
    predictions: DataFrame,
    realtime: DataFrame,
    as_of: dt.datetime,
    labels: Sequence[str] | None = None,
    top: int = 30,
    all_versions: bool = False,
) -> DataFrame:
    """The largest forecasts per product and store; ``labels`` filters the list of ``top`` rows."""
    keys = ("product_id", "store_id")
    rows = (
        _demand_against_history(predictions, realtime, as_of, all_versions, *keys)
        .select(
            *keys,
            F.col("predicted").alias("predicted_7d"),
            restock_label(F.col("demand_ratio")).alias("recommendation"),
        )
        .orderBy(F.desc("predicted_7d"), *keys)
        .limit(top)
    )
    return rows.where(F.col("recommendation").isin(*labels)) if labels else rows


def high_demand_restock(
    predictions: DataFrame,
    realtime: DataFrame,
    as_of: dt.datetime,
    top: int = 20,
    all_versions: bool = False,
) -> DataFrame:
    return (
        restock_recommendations(predictions, realtime, as_of, [HIGH_DEMAND], all_versions)
        .orderBy(F.desc("predicted_demand_7d"), "product_id", "store_id", "forecast_date")
        .limit(top)
        .select(
            "product_id",
            "store_id",
            "predicted_demand_7d",
            "historical_avg_7d",
            "recommendation",
        )
    )


def predictions_count(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count("*").alias("count"))


def newest_active(metrics: DataFrame) -> DataFrame:
    """The metrics row of the active model trained last."""
    active = metrics.where(F.col("is_active") == 1)
    return active.orderBy(F.desc("training_date"), F.desc("model_version")).limit(1)


def active_model(metrics: DataFrame) -> DataFrame:
    """The active model trained last."""
    return newest_active(metrics).select(
        "model_version", "rmse", "mae", "r2_score", "training_samples", "training_date"
    )


def forecast_dimensions(
    predictions: DataFrame, products: int = 50, stores: int = 20
) -> DataFrame:
    """The choices of the forecast page: the first products and the first stores."""
    product_list = predictions.select("product_id").distinct().orderBy("product_id").limit(products)
    store_list = predictions.select("store_id").distinct().orderBy("store_id").limit(stores)
    return product_list.select(
        F.lit("product_id").alias("dimension"), F.col("product_id").alias("choice")
    ).unionByName(
        store_list.select(
            F.lit("store_id").alias("dimension"), F.col("store_id").cast("string").alias("choice")
        )
    )


def _demand_by_day(
    predictions: DataFrame,
    as_of: dt.datetime,
    product: str | None = None,
    store: int | None = None,
    all_versions: bool = False,
) -> DataFrame:
    rows = coming_forecasts(predictions, as_of, all_versions)
    if product is not None:
        rows = rows.where(F.col("product_id") == product)
    if store is not None:
        rows = rows.where(F.col("store_id") == store)
    return (
        rows.groupBy("forecast_date")
        .agg(
            F.sum("predicted_demand").alias("total_demand"),
            F.avg("confidence_lower").alias("avg_lower"),
            F.avg("confidence_upper").alias("avg_upper"),
            F.count("*").alias("product_count"),
        )
    )


def forecast_by_day(
    predictions: DataFrame,
    as_of: dt.datetime,
    product: str | None = None,
    store: int | None = None,
    all_versions: bool = False,
) -> DataFrame:
    """Demand per date; the bounds are averaged over the rows while the demand is summed."""
    return _demand_by_day(predictions, as_of, product, store, all_versions).orderBy("forecast_date")


def forecast_totals(
    predictions: DataFrame, as_of: dt.datetime, all_versions: bool = False
) -> DataFrame:
    return _demand_by_day(predictions, as_of, all_versions=all_versions).agg(
        F.sum("total_demand").alias("total_forecast"),
        F.avg("total_demand").alias("avg_daily_demand"),
    )


def accuracy_by_product(
    accuracy: DataFrame, at_least: int = 3, top: int = 20
) -> DataFrame:
    return (
        accuracy.groupBy("product_id")
        .agg(
            F.avg("predicted_demand").alias("avg_predicted"),
            F.avg("actual_demand").alias("avg_actual"),
            F.avg("absolute_error").alias("avg_error"),
            F.avg("percentage_error").alias("avg_pct_error"),
            F.count("*").alias("sample_count"),
        )
        .where(F.col("sample_count") >= at_least)
        .orderBy("avg_pct_error", "product_id")
        .limit(top)
    )


def recent_accuracy(
    predictions: DataFrame, realtime: DataFrame, as_of: dt.datetime, days: int = 7
) -> DataFrame:
    """Mean percentage error of the forecasts of the last days; the events are cut to their dates."""
    first = calendar.midnight(as_of) - dt.timedelta(days=days)
    recent = predictions.where(F.col("forecast_date") >= calendar.day(first))
    accuracy = prediction_accuracy(recent, realtime)
    return accuracy.agg(F.avg("percentage_error").alias("avg_error"))


def forecast_next7_by_store(
    predictions: DataFrame, as_of: dt.datetime, all_versions: bool = False
) -> DataFrame:
    return (
        coming_forecasts(predictions, as_of, all_versions)
        .groupBy("forecast_date", "product_id", "store_id")
        .agg(F.sum("predicted_demand").alias("daily_forecast"))
        .orderBy("forecast_date", F.desc("daily_forecast"), "product_id", "store_id")
    )


def predictions_by_version(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model_version").agg(
        F.count("*").alias("predictions"),
        F.min("forecast_date").alias("first_date"),
        F.max("forecast_date").alias("last_date"),
    )


def latest_predictions(predictions: DataFrame, rows: int = 10) -> DataFrame:
    return (
        predictions.orderBy(
            F.desc("prediction_time"),
            "forecast_date",
            "product_id",
            "store_id",
            "forecast_hour",
            "model_version",
        )
        .limit(rows)
        .select("product_id", "forecast_date", "predicted_demand")
    )


def top_forecasts(predictions: DataFrame, as_of: dt.datetime, rows: int = 10) -> DataFrame:
    """The earliest dates first, the largest demand of a date first."""
    return (
        predictions.where(F.col("forecast_date") >= calendar.day(as_of))
        .orderBy(
            "forecast_date",
            F.desc("predicted_demand"),
            "product_id",
            "store_id",
            "forecast_hour",
            "model_version",
        )
        .limit(rows)
        .select(
            "forecast_date",
            "forecast_hour",
            "product_id",
            "store_id",
            "model_version",
            "predicted_demand",
        )
    )
