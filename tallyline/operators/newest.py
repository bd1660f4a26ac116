"""The newest forecast of each slot: daily runs overlap, so a slot is predicted several times."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import calendar

SLOT = ("product_id", "store_id", "forecast_date", "forecast_hour")
#: What decides which prediction is the newest, and what is taken from it.
ORDER = ("prediction_time", "model_version")
VALUES = ("predicted_demand", "confidence_lower", "confidence_upper")


def newest_forecasts(predictions: DataFrame) -> DataFrame:
    """One row per product, store, date and hour: the prediction made last.

    A maximum over structs, so each task sends at most one row per slot whatever the number of
    versions; ties of time go to the higher version.
    """
    last = F.max(F.struct(*ORDER, *VALUES)).alias("last")
    return predictions.groupBy(*SLOT).agg(last).select(*SLOT, "last.*")


def coming_forecasts(predictions: DataFrame, as_of: dt.datetime, all_versions: bool = False) -> DataFrame:
    """Forecasts for the next seven days, each slot once unless ``all_versions`` are added up.

    A relation without ``prediction_time`` tells no runs apart and is taken as one forecast.
    """
    window = calendar.forecast_window(predictions, as_of)
    if all_versions or "prediction_time" not in predictions.columns:
        return window
    return newest_forecasts(window)
