"""Unusual hours: hourly revenue against its moving mean and deviation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import calendar
from tallyline.functions.ratios import ratio
from tallyline.operators.moving import hourly_revenue, moving_stats


# Two rows alone lie exactly one deviation from their mean, so at a sensitivity of 1 the last bit of
# the quotient would decide.  The comparison ignores digits beyond this one.
COMPARED_DIGITS = 9


def beyond(score: Column, sensitivity: float) -> Column:
    return F.round(score, COMPARED_DIGITS) > sensitivity


def _stats(
    realtime: DataFrame, as_of: dt.datetime, days: int, fill_gaps: bool = False
) -> DataFrame:
    recent = calendar.last_hours(realtime, as_of, 24 * days)
    return moving_stats(hourly_revenue(recent), fill_gaps)


def sales_anomaly_stats(
    realtime: DataFrame, as_of: dt.datetime, days: int = 7, fill_gaps: bool = False
) -> DataFrame:
    return _stats(realtime, as_of, days, fill_gaps).orderBy(F.desc("hour"), "category")


def _newest_first(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("hour"), F.desc(F.abs("z_score")), "category")


def _alerts(
    realtime: DataFrame, as_of: dt.datetime, days: int, sensitivity: float, top: int | None
) -> DataFrame:
    """The alerts of a report in no order; the newest ``top`` of them, or all."""
    z_score = ratio(
        F.col("hourly_revenue") - F.col("moving_avg_24h"), F.col("std_dev_24h")
    )
    alerts = (
        _stats(realtime, as_of, days)
        .where(F.col("std_dev_24h") > 0)
        .withColumn("z_score", z_score)
        .where(beyond(F.abs("z_score"), sensitivity))
        .withColumn("anomaly_type", F.when(F.col("z_score") > 0, "High").otherwise("Low"))
    )
    return alerts if top is None else _newest_first(alerts).limit(top)


def anomaly_alerts(
    realtime: DataFrame,
    as_of: dt.datetime,
    days: int = 7,
    sensitivity: float = 2.0,
    top: int | None = 50,
) -> DataFrame:
    """Hours more than ``sensitivity`` deviations from the moving mean, newest first."""
    alerts = _alerts(realtime, as_of, days, sensitivity, top)
    return _newest_first(alerts) if top is None else alerts


def anomaly_counts(
    realtime: DataFrame,
    as_of: dt.datetime,
    days: int = 7,
    sensitivity: float = 2.0,
    top: int | None = 50,
) -> DataFrame:
    """Totals over the alerts listed; ``top=None`` counts all of them."""
    alerts = _alerts(realtime, as_of, days, sensitivity, top)
    return alerts.agg(
        F.count("*").alias("total_anomalies"),
        F.count_if(beyond(F.col("z_score"), sensitivity)).alias("high_anomalies"),
        F.count_if(beyond(-F.col("z_score"), sensitivity)).alias("low_anomalies"),
    )


def anomaly_bands(
    realtime: DataFrame,
    as_of: dt.datetime,
    days: int = 7,
    sensitivity: float = 2.0,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """Hourly revenue with mean ± ``sensitivity`` deviations, optionally of some categories."""
    if categories:
        realtime = realtime.where(F.col("category").isin(*categories))
    margin = sensitivity * F.col("std_dev")
    return (
        _stats(realtime, as_of, days)
        .withColumnsRenamed(
            {
                "hourly_revenue": "revenue",
                "moving_avg_24h": "moving_avg",
                "std_dev_24h": "std_dev",
            }
        )
        .withColumns(
            {
                "upper_band": F.col("moving_avg") + margin,
                "lower_band": F.col("moving_avg") - margin,
            }
        )
        .orderBy("hour", "category")
    )


def anomaly_summary(
    realtime: DataFrame,
    as_of: dt.datetime,
    days: int = 7,
    sensitivity: float = 2.0,
    top: int | None = 50,
) -> DataFrame:
    """Per category over the alerts listed; ``top=None`` covers all of them."""
    return (
        _alerts(realtime, as_of, days, sensitivity, top)
        .groupBy("category")
        .agg(
            F.count("*").alias("anomaly_count"),
            F.avg("z_score").alias("avg_z_score"),
            F.max("z_score").alias("max_z_score"),
            F.min("z_score").alias("min_z_score"),
        )
        .orderBy(F.desc("anomaly_count"), "category")
    )
