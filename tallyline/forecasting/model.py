"""Demand model: training, evaluation, storage and scoring with MLlib."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.forecasting.features import CALENDAR_KEYS, HISTORY, PAIR
from tallyline.functions import calendar
from tallyline.plans.forecast import newest_active
from tallyline.schemas import MODEL_METRICS, PREDICTION_FILE

LABEL = "total_demand"
FEATURES = ["product_idx", "store_id", *CALENDAR_KEYS, *HISTORY]
# The features known without looking at the label.
CALENDAR_FEATURES = ["product_idx", "store_id", *CALENDAR_KEYS]

MODEL_TYPE = "demand_forecast"
# Trees, depth, bins, seed and training share of the forest.
NUM_TREES, MAX_DEPTH, MAX_BINS, SEED = 100, 10, 32, 42
TRAIN_PERCENT = 80
# Sampling of the trees depends on how rows are dealt out, so this is part of the model, not of the
# cluster's settings.
TRAIN_PARTITIONS = 32

# Shown seasonal factor and the band around a prediction.
HOLIDAY_FACTOR, SUMMER_FACTOR = 1.5, 1.1
LOWER_BAND, UPPER_BAND = 0.8, 1.2


@dataclass
class Trained:
    model: PipelineModel
    rmse: float
    mae: float
    r2_score: float
    training_samples: int
    parameters: dict


def in_training_part(*keys: str) -> Column:
    """An 80/20 split by MD5 of the key: a row stays on its side however data is partitioned, and any
    other engine finds the same side."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), *keys))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100 < TRAIN_PERCENT


def _pipeline(algorithm: str, features: Sequence[str], num_trees: int) -> Pipeline:
    """The product index is an ordinary number for any count of products: as a category it would
    need a bin per product in every node's statistics."""
    common = {"featuresCol": "features", "labelCol": LABEL, "maxBins": MAX_BINS, "seed": SEED}
    if algorithm == "RandomForest":
        learner = RandomForestRegressor(numTrees=num_trees, maxDepth=MAX_DEPTH, **common)
    else:
        learner = GBTRegressor(maxIter=num_trees, maxDepth=5, **common)
    indexer = StringIndexer(inputCol="product_id", outputCol="product_code", handleInvalid="keep")
    # Adding zero drops the category metadata of the index column.
    plain = SQLTransformer(statement="SELECT *, product_code + 0.0 AS product_idx FROM __THIS__")
    assembler = VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid="skip"
    )
    return Pipeline(stages=[indexer, plain, assembler, learner])


def train(
    features: DataFrame,
    algorithm: str = "RandomForest",
    columns: Sequence[str] = tuple(FEATURES),
    num_trees: int = NUM_TREES,
    partitions: int = TRAIN_PARTITIONS,
) -> Trained:
    """Fit on the training part and measure on the rest.

    The rows are few for the work they cause, so they are spread by key over more partitions than
    their size asks for; sorting them there makes the sampled trees the same on every run.
    """
    keys = [*PAIR, *CALENDAR_KEYS]
    features = features.persist()
    try:
        spread = features.repartition(partitions, *keys).sortWithinPartitions(*keys)
        training = spread.where(in_training_part(*keys))
        held_out = features.where(~in_training_part(*keys))
        samples = training.count()
        model = _pipeline(algorithm, columns, num_trees).fit(training)
        scored = model.transform(held_out).select(LABEL, "prediction").persist()
        try:
            scores = {
                metric: RegressionEvaluator(labelCol=LABEL, metricName=metric).evaluate(scored)
                for metric in ("rmse", "mae", "r2")
            }
        finally:
            scored.unpersist()
    finally:
        features.unpersist()
    parameters = {"algorithm": algorithm, "num_trees": num_trees, "partitions": partitions}
    parameters["max_depth"] = MAX_DEPTH if algorithm == "RandomForest" else 5
    return Trained(
        model, scores["rmse"], scores["mae"], scores["r2"], samples, parameters
    )


def metrics_row(
    spark: SparkSession, trained: Trained, version: str, trained_at: dt.datetime, active: bool = True
) -> DataFrame:
    """The trained model as one row of the metrics table."""
    parameters = F.to_json(
        F.struct(*[F.lit(value).alias(name) for name, value in trained.parameters.items()])
    )
    return (
        spark.range(1)
        .select(
            F.expr("uuid()").alias("metric_id"),
            F.lit(version).alias("model_version"),
            F.lit(MODEL_TYPE).alias("model_type"),
            calendar.instant(trained_at).alias("training_date"),
            F.lit(trained.training_samples).cast("bigint").alias("training_samples"),
            F.lit(trained.rmse).alias("rmse"),
            F.lit(trained.mae).alias("mae"),
            F.lit(trained.r2_score).alias("r2_score"),
            parameters.alias("parameters"),
            F.lit(int(active)).alias("is_active"),
            F.current_timestamp().alias("created_at"),
        )
        .select(*MODEL_METRICS.fieldNames())
    )


def save_model(trained: Trained, root: str, version: str) -> str:
    """Store the model in a folder of its own, named in its parameters.

    Nothing stored is overwritten, so a version trained again while it is in use is complete before
    its metrics row names it.
    """
    name = f"{MODEL_TYPE}_{version}_{uuid.uuid4().hex[:8]}"
    trained.model.write().save(f"{root}/{name}")
    trained.parameters["saved_as"] = name
    return f"{root}/{name}"


@dataclass
class Active:
    model: PipelineModel
    version: str
    parameters: dict


def load_active(metrics: DataFrame, root: str) -> Active:
    """The model that the metrics table says is active: its row is the only pointer."""
    chosen = newest_active(metrics).select("model_version", "parameters").first()
    if chosen is None:
        raise LookupError("the metrics table has no active model")
    parameters = json.loads(chosen.parameters)
    return Active(PipelineModel.load(f"{root}/{parameters['saved_as']}"), chosen.model_version, parameters)


def predict(
    model: PipelineModel, features: DataFrame, version: str, predicted_at: dt.datetime
) -> DataFrame:
    """Positive predictions with their band and seasonal factor, in the prediction file schema.

    The id is a hash of the prediction's key, so a repeated run yields the same ids and imports once.
    The prediction passes through a generator, which the filter on it cannot cross: otherwise the
    model would be evaluated once for the filter and again for the columns.
    """
    raw = F.col("raw")
    key = [
        F.lit(version),
        F.col("product_id"),
        F.col("store_id").cast("string"),
        F.col("forecast_date").cast("string"),
        F.col("hour_of_day").cast("string"),
    ]
    season = (
        F.when(F.col("is_holiday_season") == 1, HOLIDAY_FACTOR)
        .when(F.col("is_summer") == 1, SUMMER_FACTOR)
        .otherwise(1.0)
    )
    return (
        model.transform(features)
        .select("*", F.explode(F.array("prediction")).alias("raw"))
        .withColumns(
            {
                "prediction_id": F.sha2(F.concat_ws("|", *key), 256),
                "prediction_time": calendar.instant(predicted_at),
                "model_version": F.lit(version),
                "forecast_hour": F.col("hour_of_day"),
                "predicted_demand": F.round(raw, 2),
                "confidence_lower": F.round(raw * LOWER_BAND, 2),
                "confidence_upper": F.round(raw * UPPER_BAND, 2),
                "seasonal_factor": season,
            }
        )
        .select(*PREDICTION_FILE.fieldNames())
        .where(F.col("predicted_demand") > 0)
    )


def compare_models(features: DataFrame, version: str, trained_at: dt.datetime, **options) -> DataFrame:
    """Metrics rows of a random forest and of gradient-boosted trees on the same features."""
    spark = features.sparkSession
    rows = [
        metrics_row(
            spark,
            train(features, algorithm, **options),
            f"{version}_{algorithm}",
            trained_at,
            active=algorithm == "RandomForest",
        )
        for algorithm in ("RandomForest", "GBT")
    ]
    return rows[0].unionByName(rows[1])
