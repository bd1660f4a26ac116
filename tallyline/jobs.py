"""The scheduled work as calls: ingest, train, predict with import, and the upkeep of the tables.

Every job takes its clock, so a re-run for the same time does the same work.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tallyline.forecasting import features, model
from tallyline.functions.calendar import before, version_stamp
from tallyline.operators.rollup import ROLLUPS
from tallyline.session import build_session
from tallyline.sources import predictions as store
from tallyline.sources import tables
from tallyline.sources.messages import file_stream, topic_stream
from tallyline.streaming.rollups import compact_rollup, start_rollups, vacuum_rollup
from tallyline.streaming.sinks import start_lake_sink, start_realtime_sink


def ingest(messages: DataFrame, root: str) -> None:
    """Bring the lake, the realtime table and the rollups up to date with a message stream."""
    queries = [
        start_lake_sink(messages, f"{root}/lake", f"{root}/_checkpoints/lake"),
        start_realtime_sink(messages, f"{root}/realtime", f"{root}/_checkpoints/realtime"),
        start_rollups(messages, f"{root}/rollups"),
    ]
    for query in queries:
        query.awaitTermination()


def train(
    spark: SparkSession, root: str, as_of: dt.datetime, label: str = "week", **options
) -> str:
    """Train on the lake, store the model and its metrics; returns the version.

    ``label="week"`` forecasts the demand of one week, ``"total"`` that of the whole history.
    """
    version = version_stamp(as_of)
    events = before(tables.read_lake(spark, f"{root}/lake"), as_of)
    make = features.weekly_training_features if label == "week" else features.training_features
    trained = model.train(make(events), **options)
    trained.parameters["label"] = label
    model.save_model(trained, f"{root}/models", version)
    store.record_metrics(
        model.metrics_row(spark, trained, version, as_of), f"{root}/model_metrics"
    )
    return version


def predict_and_import(
    spark: SparkSession, root: str, as_of: dt.datetime, days: int = 7
) -> str:
    """Score the coming days with the active model and import the result; returns its files."""
    events = before(tables.read_lake(spark, f"{root}/lake"), as_of)
    active = model.load_active(store.read_metrics(spark, f"{root}/model_metrics"), f"{root}/models")
    weekly = active.parameters["label"] == "week"
    make = features.weekly_score_features if weekly else features.score_features
    scored = model.predict(active.model, make(events, as_of, days), version_stamp(as_of), as_of)
    path = store.save_predictions(scored, f"{root}/predictions", as_of)
    store.save_predictions_csv(spark.read.parquet(path), f"{root}/predictions_csv", as_of)
    store.import_predictions(
        store.read_prediction_files(spark, f"{root}/predictions", as_of),
        f"{root}/demand_predictions",
    )
    return path


def expire(spark: SparkSession, root: str, as_of: dt.datetime) -> list[str]:
    """Drop what is past retention from the realtime table."""
    dropped = tables.drop_expired(spark, f"{root}/realtime", as_of)
    tables.vacuum_table(spark, f"{root}/realtime", tables.REALTIME_TABLE)
    return dropped


def compact(spark: SparkSession, root: str, as_of: dt.datetime) -> None:
    """Merge the loads of closed dates and the partials of each rollup; remove what that replaced.

    Closed dates of the lake are ordered by product for lookups, those of the realtime table by time.

    What the previous run replaced goes first, so readers have the time between two runs.
    """
    stored = ((f"{root}/lake", tables.LAKE_TABLE), (f"{root}/realtime", tables.REALTIME_TABLE))
    for path, table in stored:
        tables.vacuum_table(spark, path, table)
        tables.compact_table(spark, path, table, as_of.date(), by_product=table is tables.LAKE_TABLE)
    for rollup in ROLLUPS:
        compact_rollup(spark, f"{root}/rollups", rollup)
        vacuum_rollup(spark, f"{root}/rollups", rollup)


def main(arguments: list[str] | None = None) -> None:
    """``spark-submit … jobs.py ingest --root s3a://bucket/retail --servers host:9092 --topic t``."""
    parser = argparse.ArgumentParser(description="Scheduled work on store events")
    parser.add_argument("job", choices=["ingest", "train", "predict", "expire", "compact"])
    parser.add_argument("--root", required=True, help="folder of all tables")
    parser.add_argument("--as-of", type=dt.datetime.fromisoformat, default=None)
    parser.add_argument("--landing", help="ingest JSON lines of this directory")
    parser.add_argument("--servers", help="ingest a topic of these servers")
    parser.add_argument("--topic", default="retail_events")
    parser.add_argument("--max-files", type=int, default=1_000, help="files in one batch of a backlog")
    parser.add_argument("--max-offsets", type=int, default=50_000_000, help="messages in one batch")
    chosen = parser.parse_args(arguments)
    as_of = chosen.as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    spark = build_session(f"tallyline-{chosen.job}")
    if chosen.job == "ingest":
        if not (chosen.landing or chosen.servers):
            parser.error("ingest needs --landing or --servers")
        stream = (
            topic_stream(spark, chosen.servers, chosen.topic, chosen.max_offsets)
            if chosen.servers
            else file_stream(spark, chosen.landing, chosen.max_files)
        )
        ingest(stream, chosen.root)
    elif chosen.job == "train":
        train(spark, chosen.root, as_of)
    elif chosen.job == "predict":
        predict_and_import(spark, chosen.root, as_of)
    elif chosen.job == "expire":
        expire(spark, chosen.root, as_of)
    else:
        compact(spark, chosen.root, as_of)


if __name__ == "__main__":
    main()
