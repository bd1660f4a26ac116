"""Streams: restart, replay, late rows, compaction; each result equals the batch result."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY
from tallyline import jobs
from tallyline.operators import ingest
from tallyline.operators.rollup import DAILY, HOURLY, PRODUCT, ROLLUPS, summarise
from tallyline.schemas import EVENT_COLUMNS
from tallyline.sources import messages, sample, storage, tables
from tallyline.streaming import rollups, sinks


def same(left, right):
    columns = sorted(left.columns)
    assert sorted(right.columns) == columns
    left, right = left.select(columns), right.select(columns)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.fixture()
def landing(spark, tmp_path):
    def put(frame, name="landing"):
        path = str(tmp_path / name)
        messages.write_messages(ingest.encode(frame), path)
        return path

    return put


@pytest.fixture(scope="module")
def stored(spark):
    return sample.store_events(spark, SF_TINY).select(*EVENT_COLUMNS)


def test_rollups_follow_small_batches_and_a_restart(spark, tmp_path, landing, stored):
    root = str(tmp_path / "rollups")
    for part in (stored.where("day(event_time) > 15"), stored.where("day(event_time) <= 15")):
        path = landing(part.repartition(4))
        stream = messages.file_stream(spark, path, files_per_trigger=1)
        rollups.start_rollups(stream, root).awaitTermination()
    for rollup in ROLLUPS:
        same(rollups.read_rollup(spark, root, rollup), summarise(stored, rollup))


def test_replayed_batch_replaces_itself(spark, tmp_path, events):
    root = str(tmp_path)
    first = events(("2024-01-01 10:00:00", 1, "A", "C", "SALE", 1, 2.0), ("2024-01-01 10:30:00", 1, "A", "C", "SALE", 1, 4.0))
    late = events(("2023-12-31 10:00:00", 1, "A", "C", "SALE", 1, 9.0))
    rollups.store_partials(first, 0, PRODUCT, root)
    rollups.store_partials(first, 0, PRODUCT, root)
    rollups.store_partials(late, 1, PRODUCT, root)
    row = rollups.read_rollup(spark, root, PRODUCT).first()
    # The average is over all three prices: neither the sum nor the mean of batch averages.
    assert (row.transaction_count, row.total_revenue, row.avg_unit_price) == (3, 15.0, 5.0)


def test_compaction_keeps_the_result_and_vacuum_the_data(spark, tmp_path, events, stored):
    root = str(tmp_path)
    halves = [stored.where("store_id <= 5"), stored.where("store_id > 5")]
    for batch, half in enumerate(halves + [events(("2024-03-01 00:00:00",))]):
        rollups.store_partials(half, batch, DAILY, root)
    expected = summarise(stored.unionByName(events(("2024-03-01 00:00:00",))), DAILY)
    assert rollups.compact_rollup(spark, root, DAILY) == 1
    assert rollups.compact_rollup(spark, root, DAILY) is None
    same(rollups.read_rollup(spark, root, DAILY), expected)
    assert rollups.vacuum_rollup(spark, root, DAILY) == 2
    assert storage.child_directories(spark, f"{root}/daily/partials") == ["batch_id=2"]
    same(rollups.read_rollup(spark, root, DAILY), expected)


def test_unfinished_compaction_is_ignored(spark, tmp_path, events):
    root = str(tmp_path)
    rollups.store_partials(events(("2024-03-01 00:00:00",)), 0, DAILY, root)
    (tmp_path / "daily" / "merged" / "upto=0").mkdir(parents=True)
    assert rollups.read_rollup(spark, root, DAILY).first().transaction_count == 1


def test_initial_load_and_stream_add_up(spark, tmp_path, stored):
    root = str(tmp_path)
    rollups.load_rollup(stored.where("store_id <= 5"), root, HOURLY)
    rollups.store_partials(stored.where("store_id > 5"), 0, HOURLY, root)
    same(rollups.read_rollup(spark, root, HOURLY), summarise(stored, HOURLY))


def test_lake_sink_resumes_from_its_checkpoint(spark, tmp_path, landing, stored):
    lake, checkpoint = str(tmp_path / "lake"), str(tmp_path / "checkpoint")
    for part in (stored.where("day(event_time) <= 15"), stored.where("day(event_time) > 15")):
        stream = messages.file_stream(spark, landing(part.repartition(3)), files_per_trigger=2)
        sinks.start_lake_sink(stream, lake, checkpoint).awaitTermination()
    batch = ingest.lake_rows(ingest.encode(stored))
    same(tables.read_lake(spark, lake).select(*batch.columns), batch)


def test_realtime_sink_takes_what_the_lake_rejects(spark, tmp_path, landing, events):
    frame = events(("2024-01-01 10:00:00", 1, "A", "C", "SALE", 0, 2.0), ("2024-01-02 10:00:00",))
    path = landing(frame)
    root = str(tmp_path)
    sinks.start_realtime_sink(messages.file_stream(spark, path), f"{root}/rt", f"{root}/c1").awaitTermination()
    sinks.start_lake_sink(messages.file_stream(spark, path), f"{root}/lake", f"{root}/c2").awaitTermination()
    recent = tables.read_realtime(spark, f"{root}/rt")
    same(recent.select(*EVENT_COLUMNS), frame)
    assert recent.where("inserted_at IS NULL OR event_date <> to_date(event_time)").count() == 0
    assert tables.read_lake(spark, f"{root}/lake").count() == 1


def test_batch_loads_and_streams_share_the_stored_tables(spark, tmp_path, landing, stored):
    root = str(tmp_path)
    old, new = stored.where("day(event_time) <= 15"), stored.where("day(event_time) > 15")
    path = landing(new)
    tables.write_lake(ingest.lake_rows(ingest.encode(old)), f"{root}/lake")
    tables.write_realtime(ingest.realtime_rows(ingest.encode(old)), f"{root}/rt")
    sinks.start_lake_sink(messages.file_stream(spark, path), f"{root}/lake", f"{root}/c1").awaitTermination()
    sinks.start_realtime_sink(messages.file_stream(spark, path), f"{root}/rt", f"{root}/c2").awaitTermination()
    same(tables.read_lake(spark, f"{root}/lake").select(*EVENT_COLUMNS), stored)
    same(tables.read_realtime(spark, f"{root}/rt").select(*EVENT_COLUMNS), stored)
    tables.write_lake(ingest.lake_rows(ingest.encode(old)).limit(3), f"{root}/lake", "named")
    for load in ("named", f"{sinks.stream_id(spark, f'{root}/c1')}-0"):
        tables.write_lake(ingest.lake_rows(ingest.encode(new)).limit(0), f"{root}/lake", load)
    same(tables.read_lake(spark, f"{root}/lake").select(*EVENT_COLUMNS), old)


def test_watermarked_rollup_drops_late_rows_and_holds_open_hours(spark, tmp_path, landing, events):
    root = str(tmp_path)

    def run(path):
        windowed = rollups.windowed_hourly(messages.file_stream(spark, path))
        (
            windowed.writeStream.format("parquet")
            .option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint")
            .outputMode("append")
            .trigger(**sinks.trigger(live=False))
            .start()
            .awaitTermination()
        )

    run(landing(events(("2024-01-01 01:10:00",), ("2024-01-01 05:10:00",))))
    run(landing(events(("2024-01-01 01:20:00",), ("2024-01-01 09:10:00",))))
    run(landing(events(("2024-01-01 09:20:00",))))
    rows = spark.read.parquet(f"{root}/out").orderBy("hour").collect()
    assert [(r.hour.hour, r.transaction_count) for r in rows] == [(1, 1), (5, 1)]


def test_live_trigger_fires_every_half_minute():
    assert sinks.trigger(live=True) == {"processingTime": "30 seconds"}
    assert sinks.trigger(live=False) == {"availableNow": True}


def test_freshness(spark, events):
    from tallyline.plans.realtime import data_freshness

    frame = events(("2024-01-01 10:00:00",), ("2024-01-02 10:00:00",)).withColumn(
        "inserted_at", F.col("event_time") + F.expr("INTERVAL 5 SECONDS")
    )
    row = data_freshness(frame).first()
    assert (row.latest_event.day, row.total_records, row.latest_insert.second) == (2, 2, 5)


def test_backlog_is_taken_in_limited_batches(spark, tmp_path, landing, stored):
    path = landing(stored.repartition(6))
    parts = len([n for n in storage.child_files(spark, path) if n.startswith("part-")])
    jobs.main(["ingest", "--root", str(tmp_path / "t"), "--landing", path, "--max-files", "2"])
    offsets = storage.child_files(spark, str(tmp_path / "t/_checkpoints/lake/offsets"))
    assert len([n for n in offsets if n.isdigit()]) == (parts + 1) // 2 > 1
    same(tables.read_lake(spark, str(tmp_path / "t/lake")).select(*EVENT_COLUMNS), stored)
