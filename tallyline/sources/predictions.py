"""Prediction files, their duplicate-safe import, and the table of model metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.functions.calendar import instant, version_stamp
from tallyline.schemas import DEMAND_PREDICTIONS, MODEL_METRICS, PREDICTION_FILE
from tallyline.sources import storage

IMPORT_WINDOW_HOURS = 2
FILE_COLUMNS = PREDICTION_FILE.fieldNames()


def save_predictions(predictions: DataFrame, root: str, as_of: dt.datetime) -> str:
    """Write one run of predictions below ``root`` and return its directory."""
    path = f"{root}/{version_stamp(as_of)}"
    predictions.select(*FILE_COLUMNS).write.mode("overwrite").parquet(path)
    return path


def save_predictions_csv(predictions: DataFrame, root: str, as_of: dt.datetime) -> str:
    path = f"{root}/{version_stamp(as_of)}"
    predictions.select(*FILE_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_FILE).option("header", True).csv(path)


def read_prediction_files(
    spark: SparkSession, root: str, as_of: dt.datetime | None = None
) -> DataFrame:
    """The files of all runs, or of the runs of the two hours before ``as_of``."""
    files = spark.read.schema(PREDICTION_FILE).parquet(f"{root}/*")
    if as_of is None:
        return files
    start = as_of - dt.timedelta(hours=IMPORT_WINDOW_HOURS)
    return files.where(F.col("prediction_time") >= instant(start))


def read_predictions(spark: SparkSession, table: str) -> DataFrame:
    """The serving table; ``forecast_month`` prunes its directories."""
    return spark.read.parquet(table)


def new_predictions(incoming: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Incoming rows whose ``prediction_id`` is neither stored nor repeated."""
    incoming = incoming.dropDuplicates(["prediction_id"])
    if stored is None:
        return incoming
    return incoming.join(stored.select("prediction_id"), "prediction_id", "left_anti")


def import_predictions(incoming: DataFrame, table: str) -> None:
    """Append what the table does not hold yet, however often the same files are imported.

    A duplicate has the same forecast date, so the table is only read for the dates that come in.
    """
    spark = incoming.sparkSession
    span = incoming.agg(F.min("forecast_date").alias("a"), F.max("forecast_date").alias("b")).first()
    if span.a is None:
        return
    stored = None
    if storage.child_directories(spark, table):
        stored = read_predictions(spark, table).where(
            F.col("forecast_date").between(F.lit(span.a), F.lit(span.b))
            & F.col("forecast_month").between(_month(span.a), _month(span.b))
        )
    (
        new_predictions(incoming, stored)
        .withColumn("created_at", F.current_timestamp())
        .select(
            *DEMAND_PREDICTIONS.fieldNames(),
            F.date_format("forecast_date", "yyyyMM").cast("int").alias("forecast_month"),
        )
        .hint("rebalance", "forecast_month")
        .sortWithinPartitions(
            "forecast_month", "forecast_date", "product_id", "store_id", "forecast_hour"
        )
        .write.mode("append")
        .partitionBy("forecast_month")
        .parquet(table)
    )


def _month(date: dt.date) -> int:
    return date.year * 100 + date.month


def record_metrics(rows: DataFrame, table: str) -> None:
    """Append rows of the metrics schema: a few per model, in one file, which readers see whole."""
    rows.select(*MODEL_METRICS.fieldNames()).coalesce(1).write.mode("append").parquet(table)


def read_metrics(spark: SparkSession, table: str) -> DataFrame:
    """The latest state of each model version; the table itself only grows."""
    rows = spark.read.schema(MODEL_METRICS).parquet(table)
    newest = Window.partitionBy("model_version").orderBy(F.desc("created_at"), F.desc("metric_id"))
    return (
        rows.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") == 1).drop("nth")
    )


def activate(spark: SparkSession, table: str, version: str) -> None:
    """Make one version the only active one by appending the changed states."""
    wanted = F.when(F.col("model_version") == version, 1).otherwise(0)
    changed = read_metrics(spark, table).where(F.col("is_active") != wanted)
    record_metrics(
        changed.withColumn("is_active", wanted)
        .withColumn("metric_id", F.expr("uuid()"))
        .withColumn("created_at", F.current_timestamp()),
        table,
    )
