"""Reports from rollups: what follows from which, tails, distinct counts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY
from tallyline.functions import money
from tallyline.operators import distinct
from tallyline.operators.rollup import DAILY, HOURLY, PRODUCT, finish, merge, partials
from tallyline.plans import realtime, rolled, serving
from tallyline.schemas import EVENT_COLUMNS, REALTIME, SALE
from tallyline.sources import sample, tables
from tallyline.streaming import rollups
from test_streams import same

DAY, HOUR, MINUTE = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5, 7), dt.datetime(2024, 1, 5, 7, 30)


@pytest.mark.parametrize(
    "keys, kind, start, end, expected",
    [
        (["category", "transaction_type"], SALE, None, None, PRODUCT),
        (["product_id"], SALE, None, None, PRODUCT),
        (["product_id", "category"], None, None, None, PRODUCT),
        (["category"], "RETURN", None, None, PRODUCT),
        (["store_id"], "RETURN", None, None, None),
        (["store_id"], None, None, None, None),
        (["store_id"], SALE, DAY, None, DAILY),
        (["store_id", "transaction_type"], SALE, DAY, DAY, DAILY),
        (["store_id"], SALE, HOUR, None, HOURLY),
        (["store_id"], SALE, MINUTE, None, None),
        (["product_id"], SALE, DAY, None, None),
        (["hour"], SALE, None, None, HOURLY),
        (["weekday", "hour_of_day"], SALE, None, None, HOURLY),
        (["date", "store_id"], SALE, HOUR, DAY, HOURLY),
        (["product_id", "store_id"], SALE, None, None, None),
        (["month"], SALE, None, None, None),
        ([], SALE, None, None, PRODUCT),
        (["weekday"], SALE, DAY, None, DAILY),
    ],
)
def test_what_follows_from_which_rollup(keys, kind, start, end, expected):
    assert rolled.source_of(keys, kind, start, end) is expected


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Rollups up to the cut-over and a realtime table with all events."""
    root = str(tmp_path_factory.mktemp("rolled"))
    events = sample.store_events(spark, SF_TINY)
    rolled.load_overview(events, root, sample.CUTOVER)
    for rollup in (HOURLY, PRODUCT):
        rollups.load_rollup(events, root, rollup, sample.CUTOVER)
    rows = events.withColumn("event_date", F.to_date("event_time")).select(*REALTIME.fieldNames())
    tables.write_realtime(rows, f"{root}/realtime")
    return root


REPORTS = ["sales_by_category", "sales_by_store", "hourly_sales_trend", "product_performance"]


@pytest.mark.parametrize("name", REPORTS)
def test_same_as_from_events_and_only_the_tail_is_read(spark, stored, name):
    recent = tables.read_realtime(spark, f"{stored}/realtime")
    report = getattr(rolled, name)(spark, stored, recent)
    same(report, getattr(serving, name)(recent))
    plan = report._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/realtime" in line]
    assert len(scans) == 1
    assert f"event_date" in scans[0].split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(event_time,2024-01-24" in scans[0]


def test_overview_same_as_from_events(spark, stored):
    recent = tables.read_realtime(spark, f"{stored}/realtime")
    same(rolled.home_kpis(spark, stored, recent), realtime.home_kpis(recent))


def test_range_of_whole_days(spark, stored):
    recent, start = tables.read_realtime(spark, f"{stored}/realtime"), sample.CUTOVER - dt.timedelta(days=3)
    found = rolled.daily_sales(spark, stored, recent, start, sample.AS_OF)
    sales = recent.where(F.col("transaction_type") == SALE).where(F.col("event_time") >= F.lit(start))
    expected = sales.groupBy(F.to_date("event_time").alias("date"), "store_id").agg(
        F.count("*").alias("transaction_count"), F.sum("quantity").alias("total_quantity"),
        money.money_sum("unit_price", "quantity").alias("total_revenue"),
    )
    same(found, expected)


def test_a_report_that_follows_from_none_is_refused(spark, stored):
    with pytest.raises(ValueError, match="no stored rollup"):
        rolled.figures(spark, stored, None, ["product_id", "store_id"])


def test_rollups_of_a_stream_have_no_tail(spark, tmp_path, events):
    root = str(tmp_path)
    frame = events(("2024-01-01 10:00:00", 1, "A", "C", "SALE", 1, 2.0))
    rollups.store_partials(frame, 0, DAILY, root)
    rollups.store_partials(frame, 1, DAILY, root)
    rollups.compact_rollup(spark, root, DAILY)
    assert rollups.loaded_until(spark, root, DAILY) is None
    (row,) = rolled.sales_by_category(spark, root, frame).collect()
    assert row.transaction_count == 2


def test_a_load_is_not_trusted_before_it_is_recorded(spark, tmp_path, events, monkeypatch):
    root = str(tmp_path)
    frame = events(("2024-01-01 10:00:00",), ("2024-01-03 10:00:00",))
    rollups.load_rollup(frame, root, DAILY, dt.datetime(2024, 1, 2))
    assert rollups.loaded_until(spark, root, DAILY) == dt.datetime(2024, 1, 2)
    assert rollups.read_rollup(spark, root, DAILY).count() == 1

    def dies(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(rollups.storage, "create_text", dies)
    with pytest.raises(RuntimeError):
        rollups.load_rollup(frame, root, DAILY, dt.datetime(2024, 1, 4))
    assert rollups.loaded_until(spark, root, DAILY) is None


def test_sums_beyond_one_bigint(spark):
    """Prices and quantities whose cents would overflow a single BIGINT, added up in partials."""
    frame = spark.range(1000).selectExpr(
        "timestamp'2024-01-01 10:00:00' AS event_time", "1 AS store_id", "'A' AS product_id", "'C' AS category",
        "'SALE' AS transaction_type", "2000000000 AS quantity", "9999999.99D AS unit_price",
    )
    batches = [partials(frame, DAILY)] * 10
    rows = batches[0]
    for more in batches[1:]:
        rows = rows.unionByName(more)
    (row,) = finish(merge(rows, DAILY), DAILY).collect()
    whole = 1_000 * 2_000_000_000 * 999_999_999 / 100
    assert row.total_revenue == pytest.approx(10 * whole, rel=1e-15)
    assert realtime.home_kpis(frame).first().total_revenue == pytest.approx(whole, rel=1e-15)


# Distinct counts


def test_distinct_counts_of_days_and_tail(spark, tmp_path, events):
    root = str(tmp_path)
    first = events(*[(f"2024-01-0{d} 10:00:00", d, f"P{p}") for d in (1, 2) for p in range(5)])
    more = events(*[(f"2024-01-0{d} 10:00:00", d, f"P{p}") for d in (2, 3) for p in range(3, 9)], ("2024-01-03 10:00:00", 9, None))
    for part in (first, more, more):  # a day stored twice
        distinct.store_days(part, root, "product_id")
    codes = distinct.read_codes(spark, root, "product_id").collect()
    assert sorted(r.code for r in codes) == list(range(9)) and len({r.value for r in codes}) == 9

    def count(**options):
        return distinct.distinct_count(spark, root, "product_id", **options).first().n

    assert count() == 9
    assert count(dates="date = DATE'2024-01-01'") == 5
    assert count(tail=events(("2024-01-09 10:00:00", 1, "P1"), ("2024-01-09 10:00:00", 1, "new"), ("2024-01-09 10:00:00", 2, "new"))) == 10
    assert count(tail=first.limit(0), dates="date > DATE'2025-01-01'") == 0


def test_numbers_are_dense_over_many_values_and_bitmaps(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(70_000).selectExpr("timestamp'2024-01-01' AS event_time", "concat('v', id % 40000) AS product_id")
    distinct.store_days(rows, root, "product_id")
    distinct.store_days(rows.selectExpr("event_time", "concat(product_id, 'x') AS product_id"), root, "product_id")
    codes = distinct.read_codes(spark, root, "product_id")
    bounds = codes.selectExpr("min(code) AS a", "max(code) AS b", "count(DISTINCT code) AS n", "count(*) AS m").first()
    assert (bounds.a, bounds.b, bounds.n, bounds.m) == (0, 79_999, 80_000, 80_000)
    assert distinct.distinct_count(spark, root, "product_id").first().n == 80_000
