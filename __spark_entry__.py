"""

Each query binds a report or job to relations derived from the supplied tables.  Averages and
deviations of doubles are rounded here, at the edge, because their last digits depend on the order
of summation; the reports themselves return them unrounded.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline import session
from tallyline.checks import oracle
from tallyline.forecasting import features, model
from tallyline.functions import calendar, text
from tallyline.operators import demand_shape, ingest
from tallyline.operators.quantiles import RANK_ERROR
from tallyline.operators.rollup import DAILY, HOURLY, PRODUCT
from tallyline.plans import anomaly, catalog, forecast, history, inventory, realtime, rolled, serving
from tallyline.schemas import EVENT_COLUMNS, LAKE, REALTIME
from tallyline.sources import bucketed, messages, predictions, sample, storage, tables
from tallyline.streaming import rollups, sinks

# The subpackage llm and the corpus pipeline can be removed; everything else then works without them.
try:
    import corpus_pipeline
    from tallyline.llm import registry as llm
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("corpus_pipeline", "tallyline.llm")):
        raise
    corpus_pipeline = llm = None

AS_OF, CUTOVER = sample.AS_OF, sample.CUTOVER
VERSION = calendar.version_stamp(AS_OF)

_trained: dict[tuple, tuple[model.Trained, str]] = {}


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def _events(spark: SparkSession, sf: str, hours: int | None = None) -> DataFrame:
    start = None if hours is None else AS_OF - dt.timedelta(hours=hours)
    return sample.store_events(spark, sf, start=start)


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.encode(_events(spark, sf))


def _past(spark: SparkSession, sf: str) -> DataFrame:
    """Events known when the sample forecast was made."""
    return sample.store_events(spark, sf, end=CUTOVER)


def _accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.prediction_accuracy(sample.predictions(spark, sf), _events(spark, sf))


# Ingest and storage


def parse_events(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse_events(_messages(spark, sf)).select(*EVENT_COLUMNS)


def enrich_events(spark: SparkSession, sf: str) -> DataFrame:
    parsed = ingest.parse_events(_messages(spark, sf))
    return ingest.enrich(parsed).select(*LAKE.fieldNames())


def validate_events(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.lake_rows(_messages(spark, sf))


def rejected_events(spark: SparkSession, sf: str) -> DataFrame:
    """The event messages together with the ``props`` texts, which are JSON of another kind."""
    stored = spark.read.schema(sample.EVENTS_TABLE).parquet(f"{sf}/events.parquet")
    other = stored.select(F.col("props").alias("value"))
    enriched = ingest.enrich(ingest.parse_events(_messages(spark, sf).unionByName(other)))
    return ingest.rejected_events(enriched).groupBy("reason").agg(F.count("*").alias("rejected"))


def _realtime_rows(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _events(spark, sf)
        .withColumn("event_date", F.to_date("event_time"))
        .select(*REALTIME.fieldNames())
    )


def realtime_table(spark: SparkSession, sf: str) -> DataFrame:
    path = session.scratch_path(spark, "realtime")
    tables.write_realtime(_realtime_rows(spark, sf), path)
    return tables.read_realtime(spark, path)


def lake_pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = session.scratch_path(spark, "lake")
    tables.write_lake(validate_events(spark, sf), path)
    recent = calendar.since(tables.read_lake(spark, path), CUTOVER)
    return recent.select(*LAKE.fieldNames())


def retention_90d(spark: SparkSession, sf: str) -> DataFrame:
    as_of = dt.datetime(2024, 4, 10, 12)
    path = session.scratch_path(spark, "retention")
    tables.write_realtime(_realtime_rows(spark, sf), path)
    tables.drop_expired(spark, path, as_of)
    tables.vacuum_table(spark, path, tables.REALTIME_TABLE)
    return tables.read_realtime(spark, path)


def _stored_in_loads(rows: DataFrame, write: Callable[..., None], path: str, loads: int = 4) -> None:
    """The rows in several loads, each with a part of every date."""
    for i in range(loads):
        write(rows.where(F.pmod(F.hash("event_time", "store_id"), F.lit(loads)) == i), path, f"part{i}")


def realtime_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Dates before the cut-over merged from several loads, the later ones as they were loaded."""
    path = session.scratch_path(spark, "realtime-compacted")
    _stored_in_loads(_realtime_rows(spark, sf), tables.write_realtime, path)
    tables.compact_table(spark, path, tables.REALTIME_TABLE, CUTOVER.date())
    tables.vacuum_table(spark, path, tables.REALTIME_TABLE)
    return tables.read_realtime(spark, path)


def product_history(spark: SparkSession, sf: str) -> DataFrame:
    """One product looked up in a table whose closed dates are ordered by product."""
    path = session.scratch_path(spark, "by-product")
    _stored_in_loads(_realtime_rows(spark, sf), tables.write_realtime, path)
    tables.compact_table(spark, path, tables.REALTIME_TABLE, CUTOVER.date(), by_product=True)
    tables.vacuum_table(spark, path, tables.REALTIME_TABLE)
    return history.product_history(tables.read_realtime(spark, path), "P07", AS_OF)


def lake_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """As above, read before the merged loads are removed, and with a load that came late."""
    path = session.scratch_path(spark, "lake-compacted")
    rows = validate_events(spark, sf)
    late = F.pmod(F.hash("event_time"), F.lit(7)) == 0
    _stored_in_loads(rows.where(~late), tables.write_lake, path)
    tables.compact_table(spark, path, tables.LAKE_TABLE, CUTOVER.date())
    tables.write_lake(rows.where(late), path)
    return tables.read_lake(spark, path).select(*LAKE.fieldNames())


def unified_by_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Both layers while half of a date is being loaded into the lake: the date before the cut-over
    and all earlier ones are complete, and the realtime table holds the last days."""
    path = session.scratch_path(spark, "completeness")
    rows = validate_events(spark, sf)
    first, border = dt.date(2000, 1, 1), CUTOVER.date()
    tables.write_lake(rows.where(F.col("event_time") < calendar.instant(CUTOVER)), f"{path}/lake")
    tables.mark_complete(spark, f"{path}/lake", first, border - dt.timedelta(days=1))
    half = F.to_date("event_time") == F.lit(border)
    tables.write_lake(rows.where(half & (F.hour("event_time") < 12)), f"{path}/lake", "half")
    recent = F.col("event_date") >= F.lit(border - dt.timedelta(days=3))
    tables.write_realtime(_realtime_rows(spark, sf).where(recent), f"{path}/realtime")
    lake = tables.read_lake(spark, f"{path}/lake")
    complete = tables.complete_dates(spark, f"{path}/lake")
    both = serving.combine_by_completeness(tables.read_realtime(spark, f"{path}/realtime"), lake, complete)
    return serving.unified_events(both)


# Streams


def stream_lake_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = session.scratch_path(spark, "lake-stream")
    query = sinks.start_lake_sink(
        sample.message_stream(spark, sf), f"{path}/lake", f"{path}/_checkpoint"
    )
    query.awaitTermination()
    return tables.read_lake(spark, f"{path}/lake").select(*LAKE.fieldNames())


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    path = session.scratch_path(spark, "realtime-stream")
    query = sinks.start_realtime_sink(
        sample.message_stream(spark, sf), f"{path}/realtime", f"{path}/_checkpoint"
    )
    query.awaitTermination()
    return tables.read_realtime(spark, f"{path}/realtime").select(*EVENT_COLUMNS)


def stream_restart(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the messages, a stop, the rest, and a second run on the same checkpoint."""
    path = session.scratch_path(spark, "restart")
    halves = [_past(spark, sf), sample.store_events(spark, sf, start=CUTOVER)]
    for half in halves:
        messages.write_messages(ingest.encode(half), f"{path}/landing")
        stream = messages.file_stream(spark, f"{path}/landing")
        sinks.start_lake_sink(stream, f"{path}/lake", f"{path}/_checkpoint").awaitTermination()
    return tables.read_lake(spark, f"{path}/lake").select(*LAKE.fieldNames())


def lake_history_then_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The older events by a batch load, the newer ones by the stream, into one lake."""
    path = session.scratch_path(spark, "lake-both")
    tables.write_lake(ingest.lake_rows(ingest.encode(_past(spark, sf))), f"{path}/lake")
    newer = sample.store_events(spark, sf, start=CUTOVER)
    messages.write_messages(ingest.encode(newer), f"{path}/landing")
    stream = messages.file_stream(spark, f"{path}/landing")
    sinks.start_lake_sink(stream, f"{path}/lake", f"{path}/_checkpoint").awaitTermination()
    return tables.read_lake(spark, f"{path}/lake").select(*LAKE.fieldNames())


def _stored_layers(spark: SparkSession, sf: str, cutover: dt.datetime | None) -> DataFrame:
    path = session.scratch_path(spark, "layers")
    tables.write_lake(validate_events(spark, sf), f"{path}/lake")
    tables.write_realtime(_realtime_rows(spark, sf), f"{path}/realtime")
    recent = tables.read_realtime(spark, f"{path}/realtime", cutover)
    both = serving.combine_layers(recent, tables.read_lake(spark, f"{path}/lake"), cutover)
    return serving.unified_events(both)


def unified_json(spark: SparkSession, sf: str) -> DataFrame:
    """Both layers as JSON, with their source."""
    return ingest.encode(sample.unified(spark, sf), "source")


def _streamed_rollup(spark: SparkSession, sf: str, rollup) -> DataFrame:
    path = session.scratch_path(spark, f"rollup-{rollup.name}")
    rollups.start_rollups(sample.message_stream(spark, sf), path, [rollup]).awaitTermination()
    return rollups.read_rollup(spark, path, rollup)


def _late_rollup(spark: SparkSession, sf: str, rollup) -> str:
    """The newer messages first, the older ones in a second run."""
    path = session.scratch_path(spark, f"late-{rollup.name}")
    for part in [sample.store_events(spark, sf, start=CUTOVER), _past(spark, sf)]:
        messages.write_messages(ingest.encode(part), f"{path}/landing")
        stream = messages.file_stream(spark, f"{path}/landing")
        rollups.start_rollups(stream, f"{path}/rollup", [rollup]).awaitTermination()
    return f"{path}/rollup"


def rollup_late_data(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.read_rollup(spark, _late_rollup(spark, sf, HOURLY), HOURLY)


def rollup_compacted(spark: SparkSession, sf: str) -> DataFrame:
    root = _late_rollup(spark, sf, PRODUCT)
    rollups.compact_rollup(spark, root, PRODUCT)
    rollups.vacuum_rollup(spark, root, PRODUCT)
    return rollups.read_rollup(spark, root, PRODUCT)


_rollups: dict[tuple, str] = {}


def _rolled(spark: SparkSession, sf: str) -> str:
    """Rollups and bitmaps of the events before the cut-over, stored once a session for these tables."""
    key = (spark.sparkContext.applicationId, sf, storage.state(spark, sf))
    if key not in _rollups:
        root, events = session.scratch_path(spark, "rolled"), sample.store_events(spark, sf)
        rolled.load_overview(events, root, CUTOVER)
        for rollup in (HOURLY, PRODUCT):
            rollups.load_rollup(events, root, rollup, CUTOVER)
        _rollups[key] = root
    return _rollups[key]


def _from_rollup(report: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A report from the stored rollups and the events from the cut-over on."""
    return lambda s, d: report(s, _rolled(s, d), sample.store_events(s, d, start=CUTOVER))


def rollup_hourly_read(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.read_rollup(spark, _rolled(spark, sf), HOURLY)


# Prediction files


def save_predictions(spark: SparkSession, sf: str) -> DataFrame:
    root = session.scratch_path(spark, "predictions")
    predictions.save_predictions(sample.predictions(spark, sf), root, CUTOVER)
    return predictions.read_prediction_files(spark, root)


def predictions_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    root = session.scratch_path(spark, "predictions-csv")
    path = predictions.save_predictions_csv(sample.predictions(spark, sf), root, CUTOVER)
    return predictions.read_predictions_csv(spark, path)


def import_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs saved and imported, the second import repeating the first run's files."""
    root = session.scratch_path(spark, "import")
    for i, version in enumerate(sample.VERSIONS):
        rows = sample.predictions(spark, sf, version)
        predictions.save_predictions(rows, f"{root}/files", CUTOVER + dt.timedelta(minutes=i))
        files = predictions.read_prediction_files(spark, f"{root}/files", CUTOVER)
        predictions.import_predictions(files, f"{root}/table")
    stored = predictions.read_predictions(spark, f"{root}/table")
    return stored.select(*predictions.FILE_COLUMNS)


def prediction_accuracy_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions and hourly actuals stored in buckets of their join key."""
    path = session.scratch_path(spark, "buckets")
    name = "buckets_" + path.rsplit("-", 1)[-1]
    actuals = forecast.actual_demand(_events(spark, sf))
    sides = [
        bucketed.write_bucketed(rows, f"{name}_{part}", f"{path}/{part}", forecast.HOUR_KEYS, buckets=8)
        for part, rows in (("predictions", sample.predictions(spark, sf)), ("actuals", actuals))
    ]
    return forecast.errors_against(sides[0].hint("merge"), sides[1])


def model_performance_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """The summary from sketches stored by two runs, and whether its quantiles are within the stated
    bound of the exact ranks."""
    accuracy, path = _accuracy(spark, sf), session.scratch_path(spark, "sketches")
    middle = F.lit((CUTOVER + dt.timedelta(days=3)).date())
    for part in (F.col("forecast_date") < middle, F.col("forecast_date") >= middle):
        forecast.store_error_sketches(accuracy.where(part), path)
    found = forecast.model_performance_sketched(spark.read.parquet(path))
    error, within = F.col("percentage_error"), []
    for name, f in forecast.ERROR_QUANTILES.items():
        n = F.count(error)
        low, high = F.count_if(error < F.col(name)) / n, F.count_if(error <= F.col(name)) / n
        within.append(F.lit(f).between(low - RANK_ERROR, high + RANK_ERROR).alias(f"{name}_within"))
    ranks = accuracy.join(found, "model_version").groupBy("model_version").agg(*within)
    result = found.drop(*forecast.ERROR_QUANTILES).join(ranks, "model_version")
    return _rounded(result, "avg_percentage_error")


# Models


def _train(spark: SparkSession, sf: str) -> tuple[model.Trained, str]:
    """The forest for these tables, saved, and fitted anew in a session once they have changed."""
    key = (spark.sparkContext.applicationId, sf, storage.state(spark, sf))
    if key not in _trained:
        root = session.scratch_path(spark, "models")
        fitted = model.train(features.training_features(_events(spark, sf)))
        model.save_model(fitted, root, VERSION)
        _trained[key] = fitted, root
    return _trained[key]


def ml_train(spark: SparkSession, sf: str) -> DataFrame:
    fitted, _ = _train(spark, sf)
    return model.metrics_row(spark, fitted, calendar.version_stamp(AS_OF), AS_OF)


def model_metrics_log(spark: SparkSession, sf: str) -> DataFrame:
    table = session.scratch_path(spark, "model-metrics")
    predictions.record_metrics(ml_train(spark, sf), table)
    return predictions.read_metrics(spark, table)


def ml_predict(spark: SparkSession, sf: str) -> DataFrame:
    fitted, _ = _train(spark, sf)
    grid = features.score_features(_events(spark, sf), AS_OF)
    return model.predict(fitted.model, grid, VERSION, AS_OF)


def ml_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every training row with the side it falls on."""
    keys = [*features.PAIR, *features.CALENDAR_KEYS]
    rows = features.training_features(_events(spark, sf))
    return rows.select(*keys, model.in_training_part(*keys).alias("in_training"))


def _prediction_checks(spark: SparkSession, sf: str, scored: DataFrame) -> DataFrame:
    """Each slot of the whole grid with what its prediction must hold whatever the model says."""
    grid = features.forecast_grid(_events(spark, sf), AS_OF)
    slots = grid.select(*features.PAIR, "forecast_date", F.col("hour_of_day").alias("forecast_hour"))
    demand = F.col("predicted_demand")
    # Bounds are rounded from the unrounded prediction.
    band = (F.abs(F.col("confidence_lower") - demand * model.LOWER_BAND) < 0.0112) & (
        F.abs(F.col("confidence_upper") - demand * model.UPPER_BAND) < 0.0112
    )
    return slots.join(scored, slots.columns, "left").select(
        *slots.columns,
        "prediction_id",
        "model_version",
        "prediction_time",
        "day_of_week",
        "month",
        "is_weekend",
        "seasonal_factor",
        ((demand > 0) & band).alias("in_band"),
    )


def ml_predict_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _prediction_checks(spark, sf, ml_predict(spark, sf))


def ml_predict_active(spark: SparkSession, sf: str) -> DataFrame:
    """Two stored versions, the older one activated again: the scores are those of the older one."""
    fitted, root = _train(spark, sf)
    table = session.scratch_path(spark, "model-registry")
    newer = model.train(features.training_features(_events(spark, sf)), num_trees=3)
    model.save_model(newer, root, "newer")
    later = AS_OF + dt.timedelta(days=1)
    predictions.record_metrics(model.metrics_row(spark, fitted, VERSION, AS_OF), table)
    predictions.record_metrics(model.metrics_row(spark, newer, "newer", later), table)
    predictions.activate(spark, table, VERSION)
    active = model.load_active(predictions.read_metrics(spark, table), root)
    grid = features.score_features(_events(spark, sf), AS_OF)
    return _prediction_checks(spark, sf, model.predict(active.model, grid, active.version, AS_OF))


def ml_compare_models(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.training_features(_events(spark, sf))
    return model.compare_models(rows, calendar.version_stamp(AS_OF), AS_OF)


def active_model(spark: SparkSession, sf: str) -> DataFrame:
    """The measured versions as a metrics table, all of them active."""
    measured = forecast.ml_metrics_sql(_accuracy(spark, sf))
    table = (
        measured.withColumnRenamed("samples", "training_samples")
        .withColumn("training_date", calendar.instant(CUTOVER))
        .withColumn("is_active", F.lit(1))
    )
    return _rounded(forecast.active_model(table), "rmse", "mae", "r2_score")


def model_activation(spark: SparkSession, sf: str) -> DataFrame:
    """The measured versions as a metrics table, all inactive, of which the first is activated."""
    table = session.scratch_path(spark, "model-activation")
    measured = forecast.ml_metrics_sql(_accuracy(spark, sf)).withColumns(
        {
            "metric_id": F.col("model_version"),
            "model_type": F.lit(model.MODEL_TYPE),
            "training_date": calendar.instant(CUTOVER),
            "training_samples": F.col("samples"),
            "parameters": F.lit("{}"),
            "is_active": F.lit(0),
            "created_at": calendar.instant(CUTOVER),
        }
    )
    predictions.record_metrics(measured, table)
    predictions.activate(spark, table, next(iter(sample.VERSIONS)))
    states = predictions.read_metrics(spark, table)
    return states.select("model_version", "training_samples", F.col("is_active").cast("int").alias("is_active"))


# Display text


def product_cards(spark: SparkSession, sf: str) -> DataFrame:
    returned = F.count_if(F.col("transaction_type") == "RETURN")
    report = _events(spark, sf).groupBy("product_id").agg(
        serving.revenue().alias("r"),
        serving.basket_value().alias("a"),
        serving.units().alias("u"),
        (returned / F.count("*")).alias("s"),
    )
    return report.select(
        "product_id",
        text.currency_text(F.col("r")).alias("revenue_text"),
        text.currency_text(F.col("a")).alias("avg_value_text"),
        text.number_text(F.col("u"), 1).alias("items_text"),
        text.percentage_text(F.col("s")).alias("return_text"),
    )


def entry(spark: SparkSession) -> DataFrame:
    """Product performance over both layers of the smallest tables."""
    return serving.product_performance(sample.unified(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    unified, store, lines = sample.unified, sample.store_events, sample.lineitem_events
    forecasts = sample.predictions
    week = 24 * 7
    stats = ("moving_avg_24h", "std_dev_24h")
    scores = ("avg_z_score", "max_z_score", "min_z_score")
    mean_errors = ("avg_absolute_error", "avg_percentage_error")
    tails = ("median_percentage_error", "p90_percentage_error")
    return {
        # ingest and storage
        "parse_events": parse_events,
        "enrich_events": enrich_events,
        "validate_events": validate_events,
        "rejected_events": rejected_events,
        "events_to_json": _messages,
        "realtime_table": realtime_table,
        "lake_pruned_scan": lake_pruned_scan,
        "retention_90d": retention_90d,
        "realtime_compacted": realtime_compacted,
        "lake_compacted": lake_compacted,
        "product_history": product_history,
        "unified_by_completeness": unified_by_completeness,
        # streams
        "stream_lake_sink": stream_lake_sink,
        "stream_ingest": stream_ingest,
        "stream_restart": stream_restart,
        "lake_history_then_stream": lake_history_then_stream,
        "unified_from_tables": lambda s, d: _stored_layers(s, d, CUTOVER),
        "unified_raw": lambda s, d: _stored_layers(s, d, None),
        "unified_json": unified_json,
        "rollup_daily": lambda s, d: _streamed_rollup(s, d, DAILY),
        "rollup_hourly": lambda s, d: _streamed_rollup(s, d, HOURLY),
        "rollup_product": lambda s, d: _streamed_rollup(s, d, PRODUCT),
        "rollup_late_data": rollup_late_data,
        "rollup_compacted": rollup_compacted,
        "rollup_hourly_read": rollup_hourly_read,
        # reports from rollups
        "sales_by_category_rolled": _from_rollup(rolled.sales_by_category),
        "sales_by_store_rolled": _from_rollup(rolled.sales_by_store),
        "hourly_sales_trend_rolled": _from_rollup(rolled.hourly_sales_trend),
        "product_performance_rolled": _from_rollup(rolled.product_performance),
        "daily_sales_rolled": _from_rollup(
            lambda s, root, events: rolled.daily_sales(s, root, events, AS_OF - dt.timedelta(days=14), AS_OF)
        ),
        "home_kpis_rolled": _from_rollup(rolled.home_kpis),
        # serving
        "unified_events": lambda s, d: serving.unified_events(unified(s, d)),
        "unified_preview": lambda s, d: catalog.preview(unified(s, d)),
        "sales_by_category": lambda s, d: serving.sales_by_category(unified(s, d)),
        "sales_by_category_lineitem": lambda s, d: serving.sales_by_category(lines(s, d)),
        "sales_by_store": lambda s, d: serving.sales_by_store(unified(s, d)),
        "hourly_sales_trend": lambda s, d: serving.hourly_sales_trend(unified(s, d)),
        "product_performance": lambda s, d: serving.product_performance(unified(s, d)),
        "return_rate": lambda s, d: serving.return_rate(unified(s, d)),
        "store_daily_performance": lambda s, d: serving.store_daily_performance(
            unified(s, d, days=30), AS_OF
        ),
        "peak_hours": lambda s, d: serving.peak_hours(unified(s, d, days=30), AS_OF),
        "relation_counts": lambda s, d: catalog.relation_counts(
            realtime=store(s, d),
            historical=_past(s, d),
            unified=unified(s, d),
            predictions=forecasts(s, d),
        ),
        # live
        "home_kpis": lambda s, d: realtime.home_kpis(unified(s, d)),
        "data_freshness": lambda s, d: realtime.data_freshness(store(s, d)),
        "latest_events": lambda s, d: realtime.latest_events(store(s, d)),
        "realtime_kpis": lambda s, d: realtime.realtime_kpis(_events(s, d, 24), AS_OF),
        "realtime_hourly": lambda s, d: realtime.realtime_hourly(_events(s, d, 24), AS_OF),
        "realtime_by_category": lambda s, d: realtime.realtime_by_category(
            _events(s, d, week), AS_OF, week
        ),
        "realtime_by_store": lambda s, d: realtime.realtime_by_store(
            _events(s, d, week), AS_OF, week
        ),
        "top_products": lambda s, d: realtime.top_products(_events(s, d, 24), AS_OF),
        "monthly_distribution": lambda s, d: realtime.monthly_distribution(lines(s, d)),
        "event_span": lambda s, d: realtime.event_span(store(s, d)),
        # history
        "daily_sales_trend": lambda s, d: history.daily_sales_trend(unified(s, d, days=30), AS_OF),
        "daily_sales_summary_stats": lambda s, d: history.daily_sales_summary_stats(
            unified(s, d, days=30), AS_OF
        ),
        "peak_hours_heatmap": lambda s, d: history.peak_hours_heatmap(
            unified(s, d, days=30), AS_OF
        ),
        "peak_hours_matrix": lambda s, d: history.peak_hours_matrix(unified(s, d, days=30), AS_OF),
        "peak_hour": lambda s, d: history.peak_hour(unified(s, d, days=30), AS_OF),
        "store_performance": lambda s, d: history.store_performance(unified(s, d, days=30), AS_OF),
        "return_rate_top": lambda s, d: history.return_rate_top(unified(s, d, days=30), AS_OF),
        "category_performance": lambda s, d: _rounded(
            history.category_performance(unified(s, d, days=30), AS_OF), "revenue_share"
        ),
        "growth_rate": lambda s, d: _rounded(history.growth_rate(lines(s, d)), "growth_pct"),
        "store_leaderboard": lambda s, d: history.store_leaderboard(unified(s, d)),
        "revenue_metrics": lambda s, d: history.revenue_metrics(
            serving.product_figures(unified(s, d))
        ),
        "performance_metrics": lambda s, d: history.performance_metrics(unified(s, d)),
        "product_cards": product_cards,
        "category_cards": lambda s, d: history.category_cards(unified(s, d, days=30), AS_OF),
        # inventory
        "stock_movement": lambda s, d: inventory.stock_movement(unified(s, d, days=30), AS_OF),
        "net_stock_movement": lambda s, d: inventory.net_stock_movement(
            unified(s, d, days=30), AS_OF
        ),
        "category_stock_status": lambda s, d: inventory.category_stock_status(
            unified(s, d, days=30), AS_OF
        ),
        "slow_moving_products": lambda s, d: inventory.slow_moving_products(
            unified(s, d, days=30), AS_OF
        ),
        "high_demand_products": lambda s, d: inventory.high_demand_products(
            store(s, d), forecasts(s, d), CUTOVER
        ),
        "restock_priority": lambda s, d: inventory.restock_priority(
            store(s, d), forecasts(s, d), CUTOVER
        ),
        "restock_priority_counts": lambda s, d: inventory.restock_priority_counts(
            store(s, d), forecasts(s, d), CUTOVER
        ),
        "restock_priority_counts_all": lambda s, d: inventory.restock_priority_counts(
            store(s, d), forecasts(s, d), CUTOVER, top=None
        ),
        "realtime_kpis_past": lambda s, d: realtime.realtime_kpis(store(s, d), CUTOVER),
        # anomalies
        "sales_anomaly_stats": lambda s, d: _rounded(
            anomaly.sales_anomaly_stats(_events(s, d, week), AS_OF), *stats
        ),
        "anomaly_stats_filled": lambda s, d: _rounded(
            anomaly.sales_anomaly_stats(_events(s, d, week), AS_OF, fill_gaps=True), *stats
        ),
        "anomaly_alerts": lambda s, d: _rounded(
            anomaly.anomaly_alerts(_events(s, d, week), AS_OF), *stats, "z_score"
        ),
        "anomaly_alerts_all": lambda s, d: _rounded(
            anomaly.anomaly_alerts(_events(s, d, week), AS_OF, sensitivity=1.0, top=None),
            *stats,
            "z_score",
        ),
        "anomaly_counts": lambda s, d: anomaly.anomaly_counts(
            _events(s, d, week), AS_OF, sensitivity=1.0
        ),
        "anomaly_counts_all": lambda s, d: anomaly.anomaly_counts(
            _events(s, d, week), AS_OF, sensitivity=1.0, top=None
        ),
        "anomaly_bands": lambda s, d: _rounded(
            anomaly.anomaly_bands(_events(s, d, week), AS_OF),
            "moving_avg",
            "std_dev",
            "upper_band",
            "lower_band",
        ),
        "anomaly_bands_filtered": lambda s, d: _rounded(
            anomaly.anomaly_bands(_events(s, d, week), AS_OF, categories=["C1", "C3"]),
            "moving_avg",
            "std_dev",
            "upper_band",
            "lower_band",
        ),
        "anomaly_summary": lambda s, d: _rounded(
            anomaly.anomaly_summary(_events(s, d, week), AS_OF, sensitivity=1.0), *scores
        ),
        "anomaly_summary_all": lambda s, d: _rounded(
            anomaly.anomaly_summary(_events(s, d, week), AS_OF, sensitivity=1.0, top=None), *scores
        ),
        # forecasts
        "save_predictions": save_predictions,
        "predictions_csv_roundtrip": predictions_csv_roundtrip,
        "import_predictions": import_predictions,
        "prediction_accuracy": lambda s, d: _rounded(_accuracy(s, d), "percentage_error"),
        "model_performance_summary": lambda s, d: _rounded(
            forecast.model_performance_summary(_accuracy(s, d)), *mean_errors, *tails
        ),
        "model_performance_sketched": model_performance_sketched,
        "prediction_accuracy_bucketed": lambda s, d: _rounded(
            prediction_accuracy_bucketed(s, d), "percentage_error"
        ),
        "model_history": lambda s, d: _rounded(
            forecast.model_history(_accuracy(s, d)), "avg_percentage_error", tails[0]
        ),
        "ml_metrics_sql": lambda s, d: _rounded(
            forecast.ml_metrics_sql(_accuracy(s, d)), "rmse", "mae", "r2_score"
        ),
        "active_model": active_model,
        "model_activation": model_activation,
        "daily_demand_forecast": lambda s, d: forecast.daily_demand_forecast(
            forecasts(s, d), CUTOVER
        ),
        "restock_recommendations": lambda s, d: forecast.restock_recommendations(
            forecasts(s, d), store(s, d), CUTOVER
        ),
        "high_demand_restock": lambda s, d: forecast.high_demand_restock(
            forecasts(s, d), store(s, d), CUTOVER
        ),
        "restock_7d": lambda s, d: forecast.restock_7d(forecasts(s, d), store(s, d), CUTOVER),
        "high_demand_products_all_versions": lambda s, d: inventory.high_demand_products(
            store(s, d), forecasts(s, d), CUTOVER, all_versions=True
        ),
        "restock_priority_all_versions": lambda s, d: inventory.restock_priority(
            store(s, d), forecasts(s, d), CUTOVER, all_versions=True
        ),
        "restock_recommendations_all_versions": lambda s, d: forecast.restock_recommendations(
            forecasts(s, d), store(s, d), CUTOVER, all_versions=True
        ),
        "forecast_totals_all_versions": lambda s, d: forecast.forecast_totals(
            forecasts(s, d), CUTOVER, all_versions=True
        ),
        "forecast_next7_by_store_all_versions": lambda s, d: forecast.forecast_next7_by_store(
            forecasts(s, d), CUTOVER, all_versions=True
        ),
        "restock_7d_filtered": lambda s, d: forecast.restock_7d(
            forecasts(s, d), store(s, d), CUTOVER, labels=["HIGH_DEMAND"]
        ),
        "predictions_count": lambda s, d: forecast.predictions_count(forecasts(s, d)),
        "forecast_dimensions": lambda s, d: forecast.forecast_dimensions(forecasts(s, d)),
        "forecast_by_day": lambda s, d: _rounded(
            forecast.forecast_by_day(forecasts(s, d), CUTOVER), "avg_lower", "avg_upper"
        ),
        "forecast_by_day_filtered": lambda s, d: _rounded(
            forecast.forecast_by_day(forecasts(s, d), CUTOVER, product="P03", store=4),
            "avg_lower",
            "avg_upper",
        ),
        "forecast_totals": lambda s, d: forecast.forecast_totals(forecasts(s, d), CUTOVER),
        "accuracy_by_product": lambda s, d: _rounded(
            forecast.accuracy_by_product(_accuracy(s, d)),
            "avg_predicted",
            "avg_actual",
            "avg_error",
            "avg_pct_error",
        ),
        "recent_accuracy": lambda s, d: _rounded(
            forecast.recent_accuracy(forecasts(s, d), store(s, d), AS_OF),
            "avg_error",
        ),
        "forecast_next7_by_store": lambda s, d: forecast.forecast_next7_by_store(
            forecasts(s, d), CUTOVER
        ),
        "predictions_by_version": lambda s, d: forecast.predictions_by_version(forecasts(s, d)),
        "latest_predictions": lambda s, d: forecast.latest_predictions(forecasts(s, d)),
        "top_forecasts": lambda s, d: forecast.top_forecasts(forecasts(s, d), CUTOVER),
        # models
        "training_features": lambda s, d: _rounded(
            features.training_features(store(s, d), history="slot"), "avg_demand"
        ),
        "training_features_weekday": lambda s, d: _rounded(
            features.training_features(store(s, d)), "avg_demand"
        ),
        "training_features_weekly": lambda s, d: _rounded(
            features.weekly_training_features(store(s, d)),
            "total_demand",
            "avg_demand",
            "transaction_count",
        ),
        "score_features_weekly": lambda s, d: _rounded(
            features.weekly_score_features(store(s, d), AS_OF), "avg_demand", "transaction_count"
        ),
        "ml_split": ml_split,
        "forecast_grid": lambda s, d: features.forecast_grid(store(s, d), AS_OF),
        "score_features": lambda s, d: _rounded(
            features.score_features(store(s, d), AS_OF), "avg_demand"
        ),
        "ml_train": ml_train,
        "model_metrics_log": model_metrics_log,
        "ml_predict": ml_predict,
        "ml_predict_checks": ml_predict_checks,
        "ml_predict_active": ml_predict_active,
        "ml_compare_models": ml_compare_models,
        # demand shape
        "calendar_weight": lambda s, d: store(s, d).select(
            "event_id", F.round(demand_shape.calendar_weight(F.col("event_time")), 6).alias("weight")
        ),
        "price_adjustment": lambda s, d: _rounded(
            demand_shape.level_prices(store(s, d), AS_OF).select(
                "event_id", "adjustment", "level_price"
            ),
            "adjustment",
            "level_price",
        ),
        "weighted_sample": lambda s, d: demand_shape.weighted_sample(store(s, d), "event_id").select(
            "event_id", *EVENT_COLUMNS
        ),
        **_llm_queries(),
    }


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if llm is None:
        return {}
    return {**llm.QUERIES, "pipeline": lambda s, d: corpus_pipeline.run(s, d)}


def _llm_sql() -> dict[str, str]:
    if llm is None:
        return {}
    pipeline = corpus_pipeline.ORACLE_SQL
    return {**llm.SQL, **({"pipeline": pipeline} if pipeline else {})}


def oracle_sql() -> dict[str, str]:
    """No entry for model training and scoring: their results are not expressible in SQL."""
    return {**oracle.sql(), **_llm_sql()}
