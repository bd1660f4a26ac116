"""Published states, merged dates, replaced loads, expired rows and completeness."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyline.operators import ingest
from tallyline.plans import history, serving
from tallyline.schemas import EVENT_COLUMNS, REALTIME
from tallyline.sources import messages, published, storage, tables
from tallyline.sources.tables import LAKE_TABLE, REALTIME_TABLE
from tallyline.streaming import sinks

DAY = dt.date(2024, 1, 31)


def rows_of(frame):
    stamped = frame.withColumn("inserted_at", F.col("event_time")).withColumn("event_date", F.to_date("event_time"))
    return stamped.select(*REALTIME.fieldNames())


def times(spark, path):
    return sorted(str(r.event_time) for r in tables.read_realtime(spark, path).collect())


@pytest.fixture()
def loaded(spark, tmp_path, events):
    """Three loads of two dates each, and one of a third date."""
    path = str(tmp_path / "realtime")
    for hour in (1, 2, 3):
        frame = events((f"2024-01-30 0{hour}:00:00",), (f"2024-01-31 0{hour}:00:00",))
        tables.write_realtime(rows_of(frame), path, f"part{hour}")
    tables.write_realtime(rows_of(events(("2024-02-01 00:00:00",))), path)
    return path


def directories(spark, path, date):
    return storage.child_directories(spark, f"{path}/event_date={date}")


def test_closed_dates_are_merged_and_readers_see_the_same(spark, loaded, events):
    before = times(spark, loaded)
    assert tables.compact_table(spark, loaded, REALTIME_TABLE, DAY) == ["event_date=2024-01-30"]
    assert times(spark, loaded) == before
    assert len(directories(spark, loaded, "2024-01-30")) == 4
    assert tables.vacuum_table(spark, loaded, REALTIME_TABLE) == 3
    (merged,) = directories(spark, loaded, "2024-01-30")
    files = storage.child_files(spark, f"{loaded}/event_date=2024-01-30/{merged}")
    assert sum(f.endswith(".parquet") for f in files) == 1
    assert len(directories(spark, loaded, "2024-01-31")) == 3
    assert times(spark, loaded) == before
    # Nothing is left to merge; a late load is, beside what was merged.
    assert tables.compact_table(spark, loaded, REALTIME_TABLE, DAY) == []
    tables.write_realtime(rows_of(events(("2024-01-30 09:00:00",))), loaded)
    assert tables.compact_table(spark, loaded, REALTIME_TABLE, DAY) == ["event_date=2024-01-30"]
    tables.vacuum_table(spark, loaded, REALTIME_TABLE)
    assert times(spark, loaded) == sorted([*before, "2024-01-30 09:00:00"])
    assert len(directories(spark, loaded, "2024-01-30")) == 1


def test_a_merge_that_dies_changes_nothing(spark, loaded, monkeypatch):
    before = times(spark, loaded)

    def dies(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables, "publish", dies)
        with pytest.raises(RuntimeError):
            tables.compact_table(spark, loaded, REALTIME_TABLE, DAY)
    assert times(spark, loaded) == before
    tables.vacuum_table(spark, loaded, REALTIME_TABLE)
    assert len(directories(spark, loaded, "2024-01-30")) == 4  # too young to be abandoned
    assert tables.vacuum_table(spark, loaded, REALTIME_TABLE, hours=0) == 1
    assert len(directories(spark, loaded, "2024-01-30")) == 3 and times(spark, loaded) == before


def test_a_load_that_arrives_during_a_merge_stays(spark, loaded, events, monkeypatch):
    before, staged = times(spark, loaded), tables._staged

    def late(rows, path, table):
        found = staged(rows, path, table)
        monkeypatch.setattr(tables, "_staged", staged)
        tables.write_realtime(rows_of(events(("2024-01-30 23:00:00",))), loaded)
        return found

    monkeypatch.setattr(tables, "_staged", late)
    tables.compact_table(spark, loaded, REALTIME_TABLE, DAY)
    tables.vacuum_table(spark, loaded, REALTIME_TABLE)
    assert times(spark, loaded) == sorted([*before, "2024-01-30 23:00:00"])


def test_of_two_writers_of_a_state_one_fails(spark, tmp_path):
    root = str(tmp_path)
    seen = published.read_state(spark, root)
    published.publish(spark, root, seen, gone=frozenset(["a"]))
    with pytest.raises(RuntimeError):
        published.publish(spark, root, seen, gone=frozenset(["b"]))
    assert published.read_state(spark, root).gone == {"a"}


def test_half_a_state_never_counted(spark, tmp_path):
    root = str(tmp_path)
    published.publish(spark, root, published.State(), shown=frozenset(["x@1"]))
    (tmp_path / "_state" / "2.json").write_text('{"shown": [')
    state = published.read_state(spark, root)
    assert state.shown == {"x@1"}
    assert published.publish(spark, root, state, gone=frozenset(["y"])).number == 3
    for _ in range(8):
        state = published.publish(spark, root, published.read_state(spark, root))
    published.forget_states(spark, root)
    assert len(storage.child_files(spark, f"{root}/_state")) == published.KEPT_STATES
    assert published.read_state(spark, root) == state


def test_a_named_load_is_replaced_in_one_step(spark, loaded, events, monkeypatch):
    before, seen = times(spark, loaded), []
    publish = tables.publish
    monkeypatch.setattr(tables, "publish", lambda *a, **k: seen.append(times(spark, loaded)) or publish(*a, **k))
    tables.write_realtime(rows_of(events(("2024-01-31 07:00:00",))), loaded, "part1")
    assert seen == [before]
    expected = sorted([t for t in before if " 01:" not in t] + ["2024-01-31 07:00:00"])
    assert times(spark, loaded) == expected
    tables.write_realtime(rows_of(events(("2024-01-31 08:00:00",))), loaded, "part1")
    assert times(spark, loaded) == [t.replace("07", "08") if " 07:" in t else t for t in expected]
    tables.vacuum_table(spark, loaded, REALTIME_TABLE)
    assert len(directories(spark, loaded, "2024-01-31")) == 3


def test_a_merged_load_cannot_be_replaced(spark, loaded, events):
    tables.compact_table(spark, loaded, REALTIME_TABLE, DAY)
    with pytest.raises(ValueError, match="part1"):
        tables.write_realtime(rows_of(events(("2024-01-31 07:00:00",))), loaded, "part1")
    with pytest.raises(ValueError, match="not a name"):
        tables.write_realtime(rows_of(events(("2024-01-31 07:00:00",))), loaded, "a/b")


def test_a_replayed_batch_adds_only_what_is_missing(spark, loaded, events):
    batch = rows_of(events(("2024-01-30 05:00:00",), ("2024-01-31 05:00:00",)))
    tables.write_realtime(batch, loaded, "stream-7", replayed=True)
    whole = times(spark, loaded)
    storage.remove(spark, f"{loaded}/event_date=2024-01-30/load=stream-7")
    tables.write_realtime(batch, loaded, "stream-7", replayed=True)
    assert times(spark, loaded) == whole


def test_the_newest_batch_of_a_stream_is_not_merged(spark, loaded, events):
    for n in range(9, 12):
        tables.write_realtime(rows_of(events((f"2024-01-30 {n}:00:00",))), loaded, f"stream-{n}", replayed=True)
    tables.compact_table(spark, loaded, REALTIME_TABLE, DAY)
    tables.vacuum_table(spark, loaded, REALTIME_TABLE)
    left = directories(spark, loaded, "2024-01-30")
    assert len(left) == 2 and "load=stream-11" in left
    whole = times(spark, loaded)
    tables.write_realtime(rows_of(events(("2024-01-30 11:00:00",))), loaded, "stream-11", replayed=True)
    assert times(spark, loaded) == whole


def test_driver_calls_of_a_batch_do_not_grow_with_the_table(spark, tmp_path, events, monkeypatch):
    path, calls = str(tmp_path / "lake"), []
    file_system = storage._file_system

    def counted(session, name):
        calls.append(name)
        return file_system(session, name)

    monkeypatch.setattr(storage, "_file_system", counted)
    numbers = []
    for day in (1, 2, 3, 20, 25):
        frame = events(*[(f"2024-01-{d:02d} 10:00:00",) for d in range(day, min(day + 3, 29))][:2])
        calls.clear()
        tables.write_lake(ingest.lake_rows(ingest.encode(frame)), path, f"stream-{day}", replayed=True)
        numbers.append(len(calls))
    assert len(set(numbers)) == 1 and not any("load=*" in c for c in calls)


def test_no_stored_row_outlives_retention(spark, tmp_path, events, at):
    path, as_of = str(tmp_path / "realtime"), at("2024-06-01 12:00:00")
    cutoff = as_of - dt.timedelta(days=90)
    offsets = (-1, 0, 1, 3_600)
    for i, s in enumerate(offsets):
        tables.write_realtime(rows_of(events((str(cutoff + dt.timedelta(seconds=s)),))), path, f"load{i}")
    assert tables.drop_expired(spark, path, as_of) == []
    kept = [str(cutoff + dt.timedelta(seconds=s)) for s in (1, 3_600)]
    assert times(spark, path) == kept
    tables.vacuum_table(spark, path, REALTIME_TABLE)
    everything = spark.read.option("basePath", path).parquet(path)
    assert sorted(str(r.event_time) for r in everything.collect()) == kept
    number = published.read_state(spark, path).number
    assert tables.drop_expired(spark, path, as_of) == [] and published.read_state(spark, path).number == number
    # A day on, the whole date goes, and with it what the state said of it.
    assert tables.drop_expired(spark, path, as_of + dt.timedelta(days=1)) == [f"event_date={cutoff.date()}"]
    assert published.read_state(spark, path).shown == frozenset()


def test_undated_rows_expire_one_by_one(spark, tmp_path, events, at):
    path = str(tmp_path / "realtime")
    undated = events((None, 1), (None, 2)).withColumn("event_date", F.to_date("event_time"))
    mixed = undated.withColumn("inserted_at", F.expr("if(store_id = 1, timestamp'2024-01-01', timestamp'2024-05-01')"))
    tables.write_realtime(mixed.select(*REALTIME.fieldNames()), path, "mixed")
    tables.drop_expired(spark, path, at("2024-06-01 12:00:00"))
    (row,) = tables.read_realtime(spark, path).collect()
    assert row.inserted_at.month == 5 and row.event_time is None
    tables.drop_expired(spark, path, at("2024-12-01 12:00:00"))
    assert tables.read_realtime(spark, path).count() == 0


def test_ranges_of_complete_dates(spark, tmp_path):
    day, root = (lambda n: dt.date(2024, 1, n)), str(tmp_path)
    for first, last in ((10, 12), (1, 3), (4, 4), (11, 14), (9, 8)):
        tables.mark_complete(spark, root, day(first), day(last))
    assert tables.complete_dates(spark, root) == ((day(1), day(4)), (day(10), day(14)))


def test_each_date_counts_once_while_it_is_loaded(spark, tmp_path, events):
    lake, recent = str(tmp_path / "lake"), str(tmp_path / "realtime")
    frame = events(*[(f"2024-01-{d:02d} {h:02d}:00:00",) for d in (1, 2, 3, 4) for h in (6, 18)])
    tables.write_realtime(rows_of(frame.where("day(event_time) > 1")), recent)

    def union():
        both = serving.combine_by_completeness(
            tables.read_realtime(spark, recent), tables.read_lake(spark, lake), tables.complete_dates(spark, lake)
        )
        return sorted((str(r.event_time), r.source) for r in both.collect())

    def load(condition):
        tables.write_lake(ingest.lake_rows(ingest.encode(frame.where(condition))), lake)

    every = sorted(str(r.event_time) for r in frame.collect())
    load("day(event_time) = 1")
    tables.mark_complete(spark, lake, dt.date(2024, 1, 1), dt.date(2024, 1, 1))
    for half in ("hour(event_time) < 12", "hour(event_time) >= 12"):
        load(f"day(event_time) = 2 AND {half}")
        found = union()
        assert [t for t, _ in found] == every
        assert [s for t, s in found] == ["historical"] * 2 + ["realtime"] * 6
    tables.mark_complete(spark, lake, dt.date(2024, 1, 2), dt.date(2024, 1, 2))
    found = union()
    assert [t for t, _ in found] == every and [s for _, s in found] == ["historical"] * 4 + ["realtime"] * 4


def test_complete_ranges_prune_directories(spark, loaded):
    border = dt.date(2024, 1, 30)
    rows = serving.combine_by_completeness(
        tables.read_realtime(spark, loaded), tables.read_realtime(spark, loaded), ((dt.date(2000, 1, 1), border),)
    )
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2
    for scan in scans:
        assert "event_date" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_streams_and_merges_share_a_lake(spark, tmp_path, events):
    lake, landing, checkpoint = (str(tmp_path / n) for n in ("lake", "landing", "checkpoint"))
    expected = []
    for hour in range(4):
        frame = events((f"2024-01-30 0{hour}:00:00",), (f"2024-01-31 0{hour}:00:00",))
        expected += [str(r.event_time) for r in frame.collect()]
        messages.write_messages(ingest.encode(frame), landing)
        sinks.start_lake_sink(messages.file_stream(spark, landing), lake, checkpoint).awaitTermination()
        tables.compact_table(spark, lake, LAKE_TABLE, DAY)
        tables.vacuum_table(spark, lake, LAKE_TABLE)
        found = tables.read_lake(spark, lake).select(*EVENT_COLUMNS).collect()
        assert sorted(str(r.event_time) for r in found) == sorted(expected)
    assert len(storage.child_directories(spark, f"{lake}/year=2024/month=1/day=30")) == 2


# Lookups by product


def rows_scanned(frame):
    """Rows that the scans of an executed plan give out, after skipped row groups and pages."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    waiting, total = [plan.finalPhysicalPlan()], 0
    while waiting:
        node = waiting.pop()
        if "FileSourceScanExec" in node.getClass().getName():
            total += node.metrics().apply("numOutputRows").value()
        elif "QueryStage" in node.getClass().getName():
            waiting.append(node.plan())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture()
def many_products(spark, tmp_path):
    """Two dates of 40,000 rows in two loads, a third of them of one product."""
    path = str(tmp_path / "products")
    stamped = spark.range(80_000).selectExpr(
        "timestamp_seconds(1706572800 + id % 2 * 86400 + (id * 7919) % 86400) AS event_time",
        "CAST(id % 9 AS INT) AS store_id",
        "if(id % 3 = 0, 'hot', concat('p', lpad((id * 31) % 5000, 5, '0'))) AS product_id",
        "'c' AS category",
        "'SALE' AS transaction_type",
        "CAST(1 AS INT) AS quantity",
        "CAST(2 AS DOUBLE) AS unit_price",
        "CAST(NULL AS TIMESTAMP) AS inserted_at",
        "id",
    ).withColumn("event_date", F.to_date("event_time"))
    for i in range(2):
        tables.write_realtime(stamped.where(f"id div 7 % 2 = {i}").select(*REALTIME.fieldNames()), path, f"part{i}")
    return path


def test_lookups_by_product_skip_row_groups(spark, many_products):
    def looked_up():
        return history.product_history(tables.read_realtime(spark, many_products), "p00310", dt.datetime(2024, 2, 2))

    expected, whole = [tuple(r) for r in looked_up().collect()], rows_scanned(looked_up())
    # The product is sold on one of the dates; of the other one every row group is skipped by its dictionary.
    assert expected and whole == 40_000
    small = {"parquet.block.size": "65536", "parquet.page.size": "4096"}
    after = dt.date(2024, 2, 2)
    merged = tables.compact_table(spark, many_products, REALTIME_TABLE, after, by_product=True, **small)
    assert len(merged) == 2
    assert [tuple(r) for r in looked_up().collect()] == expected
    assert rows_scanned(looked_up()) < whole / 4
    # A merge in this order is not done again; one by time is.
    assert tables.compact_table(spark, many_products, REALTIME_TABLE, after, by_product=True) == []


def test_a_date_of_one_load_is_ordered_by_product_once(spark, loaded, events):
    before = times(spark, loaded)
    tables.compact_table(spark, loaded, REALTIME_TABLE, DAY)
    assert tables.compact_table(spark, loaded, REALTIME_TABLE, DAY) == []
    assert tables.compact_table(spark, loaded, REALTIME_TABLE, DAY, by_product=True) == ["event_date=2024-01-30"]
    assert tables.compact_table(spark, loaded, REALTIME_TABLE, DAY, by_product=True) == []
    tables.write_realtime(rows_of(events(("2024-01-30 09:00:00",))), loaded)
    assert tables.compact_table(spark, loaded, REALTIME_TABLE, DAY, by_product=True) == ["event_date=2024-01-30"]
    assert times(spark, loaded) == sorted([*before, "2024-01-30 09:00:00"])


def test_history_of_a_product_nets_its_movement(events, at):
    rows = events(
        ("2024-01-30 01:00:00", 1, "P01", "C0", "SALE", 5, 2.0),
        ("2024-01-30 02:00:00", 1, "P01", "C0", "RETURN", 1, 2.0),
        ("2024-01-30 03:00:00", 2, "P01", "C0", "RESTOCK", 9, 2.0),
        ("2024-01-30 03:00:00", 1, "P02", "C0", "SALE", 7, 2.0),
        ("2024-02-01 03:00:00", 1, "P01", "C0", "SALE", 7, 2.0),
    )
    found = history.product_history(rows, "P01", at("2024-01-31 00:00:00"))
    assert [tuple(r)[1:] for r in found.collect()] == [(1, 2, 5, 1, 0, 10.0, -4), (2, 1, 0, 0, 9, 0.0, 9)]
    assert history.product_history(rows, "P01", at("2024-01-31 00:00:00"), store=2).count() == 1
    assert history.product_history(rows, "none", at("2024-01-31 00:00:00")).count() == 0
