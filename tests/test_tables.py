"""Stored tables: partition pruning, retention, predictions and metrics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY
from tallyline.functions import calendar
from tallyline.operators import ingest
from tallyline.plans import forecast, serving
from tallyline.schemas import EVENT_COLUMNS, REALTIME
from tallyline.sources import predictions as store
from tallyline.sources import sample, storage, tables


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def scan_lines(frame):
    return [line for line in plan_of(frame).splitlines() if "FileScan" in line]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    events = sample.store_events(spark, SF_TINY)
    tables.write_lake(ingest.lake_rows(ingest.encode(events)), f"{root}/lake")
    rows = events.withColumn("event_date", F.to_date("event_time")).select(*REALTIME.fieldNames())
    tables.write_realtime(rows, f"{root}/realtime")
    return root


def test_recent_report_reads_recent_directories_only(spark, stored):
    unified = serving.combine_layers(
        tables.read_realtime(spark, f"{stored}/realtime"),
        tables.read_lake(spark, f"{stored}/lake"),
        sample.CUTOVER,
    )
    report = serving.peak_hours(unified, sample.AS_OF, days=10)
    scans = scan_lines(report)
    assert len(scans) == 2
    for scan in scans:
        partition_filters = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
        assert "event_date" in partition_filters or "make_date" in partition_filters
        pushed = scan.split("PushedFilters: [")[1]
        assert "GreaterThanOrEqual(event_time" in pushed
        assert "EqualTo(transaction_type,SALE)" in pushed
    assert report.count() > 0


def test_only_recent_directories_are_listed(spark, stored):
    path = f"{stored}/realtime"
    whole, recent = tables.read_realtime(spark, path), tables.read_realtime(spark, path, sample.CUTOVER)
    assert len(whole.inputFiles()) == 30 and len(recent.inputFiles()) == 7
    expected = calendar.since(whole, sample.CUTOVER)
    assert recent.columns == whole.columns
    assert recent.exceptAll(expected).count() == 0 and expected.exceptAll(recent).count() == 0
    nothing = tables.read_realtime(spark, path, dt.datetime(2030, 1, 1))
    assert nothing.schema == whole.schema and nothing.count() == 0


def test_report_reads_only_its_columns(spark, stored):
    report = serving.sales_by_store(tables.read_lake(spark, f"{stored}/lake"))
    (scan,) = scan_lines(report)
    read = scan.split("ReadSchema: ")[1]
    assert read.startswith(
        "struct<store_id:int,transaction_type:string,quantity:int,unit_price:double>"
    )


def test_files_are_sorted_by_time_within_their_partition(stored):
    from pathlib import Path

    import pyarrow.parquet as pq

    for table in ("lake", "realtime"):
        files = list(Path(f"{stored}/{table}").rglob("*.parquet"))
        assert len(files) == 30
        for file in files:
            times = pq.ParquetFile(file).read(["event_time"])["event_time"].to_pylist()
            assert times == sorted(times)


def test_union_of_stored_layers_equals_the_events(spark, stored):
    unified = serving.combine_layers(
        tables.read_realtime(spark, f"{stored}/realtime"),
        tables.read_lake(spark, f"{stored}/lake"),
        sample.CUTOVER,
    ).select(*EVENT_COLUMNS)
    events = sample.store_events(spark, SF_TINY).select(*EVENT_COLUMNS)
    assert unified.exceptAll(events).count() == 0 and events.exceptAll(unified).count() == 0


def test_retention_boundary(spark, tmp_path, events, at):
    as_of = at("2024-06-01 12:00:00")
    cutoff = as_of - dt.timedelta(days=90)
    frame = events(
        *[(str(cutoff + dt.timedelta(seconds=s)),) for s in (-1, 0, 1)],
        (str(cutoff - dt.timedelta(days=1)),),
        (str(as_of),),
    )
    rows = frame.withColumn("inserted_at", F.col("event_time")).withColumn(
        "event_date", F.to_date("event_time")
    )
    path = str(tmp_path / "realtime")
    tables.write_realtime(rows.select(*REALTIME.fieldNames()), path)
    dropped = tables.drop_expired(spark, path, as_of)
    assert dropped == [f"event_date={(cutoff - dt.timedelta(days=1)).date()}"]
    assert tables.drop_expired(spark, path, as_of) == []
    kept = tables.retained(tables.read_realtime(spark, path), as_of)
    assert sorted(r.event_time for r in kept.collect()) == [cutoff + dt.timedelta(seconds=1), as_of]


def test_rows_without_a_date_expire_by_their_storing(spark, tmp_path, events, at):
    path = str(tmp_path / "realtime")
    rows = events((None,)).withColumn("event_date", F.to_date("event_time"))
    for load, stored_at in (("old", "2024-01-01"), ("new", "2024-05-01")):
        stamped = rows.withColumn("inserted_at", F.lit(stored_at).cast("timestamp"))
        tables.write_realtime(stamped.select(*REALTIME.fieldNames()), path, load)
    (dropped,) = tables.drop_expired(spark, path, at("2024-06-01 12:00:00"))
    assert dropped.endswith("/load=old")
    assert tables.read_realtime(spark, path).count() == 1


def test_messages_round_trip_through_text_files(spark, tmp_path, events):
    from tallyline.sources import messages

    frame = events(("2024-01-01 10:00:00",), ("2024-01-02 10:00:00",))
    messages.write_messages(ingest.encode(frame), str(tmp_path / "m"))
    back = ingest.parse_events(messages.read_messages(spark, str(tmp_path / "m")))
    assert sorted(back.select(*EVENT_COLUMNS).collect()) == sorted(frame.collect())


# Predictions


@pytest.fixture(scope="module")
def forecasts(spark):
    return sample.predictions(spark, SF_TINY, "fixture_v1").where("product_id = 'P03'").persist()


def test_accuracy_reads_the_dates_of_the_forecasts(spark, stored, forecasts):
    recent = tables.read_realtime(spark, f"{stored}/realtime")
    two_days = forecasts.where("forecast_date IN (DATE'2024-01-25', DATE'2024-01-26')")
    found = forecast.prediction_accuracy(two_days, recent)
    (scan,) = [line for line in scan_lines(found) if "/realtime" in line]
    filters, pushed = scan.split("PartitionFilters: [")[1].split("PushedFilters: [")
    assert "event_date" in filters and "2024-01-25" in filters
    assert "GreaterThanOrEqual(event_time,2024-01-25" in pushed and "LessThan(event_time,2024-01-27" in pushed
    whole = forecast.prediction_accuracy(forecasts, recent)
    expected = whole.where("forecast_date IN (DATE'2024-01-25', DATE'2024-01-26')")
    assert found.count() > 0 and found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0
    assert forecast.prediction_accuracy(forecasts.where("false"), recent).count() == 0


def test_importing_twice_keeps_one(spark, tmp_path, forecasts):
    root, table = str(tmp_path / "files"), str(tmp_path / "table")
    store.save_predictions(forecasts, root, sample.CUTOVER)
    for _ in range(2):
        store.import_predictions(store.read_prediction_files(spark, root, sample.CUTOVER), table)
    repeated = forecasts.unionByName(forecasts.withColumn("predicted_demand", F.lit(1.0)))
    store.import_predictions(repeated.select(*store.FILE_COLUMNS), table)
    imported = store.read_predictions(spark, table)
    assert imported.count() == forecasts.count()
    assert imported.where("created_at IS NULL").count() == 0
    assert storage.child_directories(spark, table) == ["forecast_month=202401"]


def test_import_of_nothing_changes_nothing(spark, tmp_path, forecasts):
    table = str(tmp_path / "table")
    store.import_predictions(forecasts.where("false").select(*store.FILE_COLUMNS), table)
    assert not storage.exists(spark, table)


def test_only_files_of_the_last_two_hours(spark, tmp_path, forecasts):
    root = str(tmp_path / "files")
    store.save_predictions(forecasts, root, sample.CUTOVER)
    at_limit = sample.CUTOVER + dt.timedelta(hours=2)
    assert store.read_prediction_files(spark, root, at_limit).count() == forecasts.count()
    later = at_limit + dt.timedelta(seconds=1)
    assert store.read_prediction_files(spark, root, later).count() == 0
    assert store.read_prediction_files(spark, root).count() == forecasts.count()


def test_month_prunes_the_stored_side_of_an_import(spark, tmp_path, forecasts):
    table = str(tmp_path / "table")
    store.import_predictions(forecasts.select(*store.FILE_COLUMNS), table)
    read = store.read_predictions(spark, table).where("forecast_month BETWEEN 202401 AND 202401")
    (scan,) = scan_lines(read)
    assert "forecast_month" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def metrics(spark, version, trained, active=1, created="2024-01-01 00:00:00"):
    return spark.sql(
        f"SELECT uuid() AS metric_id, '{version}' AS model_version, 'demand_forecast' AS model_type, "
        f"TIMESTAMP'{trained}' AS training_date, 10L AS training_samples, 1.0D AS rmse, 1.0D AS mae, "
        f"0.5D AS r2_score, '{{}}' AS parameters, {active} AS is_active, TIMESTAMP'{created}' AS created_at"
    )


def test_newest_active_model_and_activation(spark, tmp_path):
    table = str(tmp_path / "metrics")
    store.record_metrics(metrics(spark, "a", "2024-01-01 00:00:00"), table)
    store.record_metrics(metrics(spark, "b", "2024-01-02 00:00:00"), table)
    store.record_metrics(metrics(spark, "c", "2024-01-03 00:00:00", active=0), table)
    assert forecast.active_model(store.read_metrics(spark, table)).first().model_version == "b"
    store.activate(spark, table, "a")
    now = store.read_metrics(spark, table)
    assert now.count() == 3
    assert [r.model_version for r in now.where("is_active = 1").collect()] == ["a"]
    assert forecast.active_model(now).first().model_version == "a"


def test_later_run_replaces_an_earlier_forecast_of_a_slot(forecasts):
    later = forecasts.withColumn("prediction_time", F.col("prediction_time") + F.expr("INTERVAL 1 DAY"))
    later = later.withColumns({"predicted_demand": F.lit(0.5), "model_version": F.lit("a")})
    both = forecasts.unionByName(later.where("forecast_hour < 12"))
    def total(rows, **options):
        return forecast.forecast_totals(rows, sample.CUTOVER, **options).first().total_forecast
    half = forecasts.where("forecast_hour < 12")
    assert total(both) == total(forecasts.where("forecast_hour >= 12")) + 0.5 * half.count()
    assert total(both, all_versions=True) == total(forecasts) + 0.5 * half.count()


def test_filters_by_product_and_store(forecasts):
    days = forecast.forecast_by_day(forecasts, sample.CUTOVER, product="P03", store=1)
    assert days.count() == 7
    assert forecast.forecast_by_day(forecasts, sample.CUTOVER, product="' OR 1=1").count() == 0


def test_labels_filter_the_listed_rows(spark, forecasts):
    past = sample.store_events(spark, SF_TINY, end=sample.CUTOVER)
    listed = forecast.restock_7d(forecasts, past, sample.CUTOVER, top=5)
    labels = {r.recommendation for r in listed.collect()}
    kept = forecast.restock_7d(forecasts, past, sample.CUTOVER, labels=sorted(labels), top=5)
    assert kept.count() == listed.count() == 5
    assert forecast.restock_7d(forecasts, past, sample.CUTOVER, labels=["NONE"], top=5).count() == 0


def test_since_without_partition_column(events, at):
    assert calendar.since(events(("2024-01-01 00:00:00",)), at("2024-01-01")).count() == 1
