"""Messages in every shape, and what becomes of them."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyline.operators import ingest
from tallyline.schemas import EVENT_COLUMNS

GOOD = {
    "event_time": "2025-01-02 03:04:05",
    "store_id": 3,
    "product_id": "Lamp",
    "category": "Home",
    "transaction_type": "SALE",
    "quantity": 2,
    "unit_price": 9.5,
}


def messages(spark, *values):
    texts = [(json.dumps(v) if isinstance(v, dict) else v,) for v in values]
    return spark.createDataFrame(texts, "value STRING")


def test_message_becomes_typed_event(spark):
    row = ingest.parse_events(messages(spark, GOOD)).select(*EVENT_COLUMNS).first()
    assert row == (dt.datetime(2025, 1, 2, 3, 4, 5), 3, "Lamp", "Home", "SALE", 2, 9.5)


@pytest.mark.parametrize("bad", ["{bad", "", "[]", "null", "7", "{}", None])
def test_malformed_message_is_all_null_and_rejected(spark, bad):
    parsed = ingest.parse_events(messages(spark, bad))
    assert parsed.count() == 1
    assert parsed.select(*EVENT_COLUMNS).first() == (None,) * 7
    rejected = ingest.rejected_events(ingest.enrich(parsed))
    assert [r.reason for r in rejected.collect()] == ["unreadable"]
    assert [r.value for r in rejected.collect()] == [bad]


def test_wrong_type_is_null_in_that_field(spark):
    row = ingest.parse_events(messages(spark, GOOD | {"quantity": "x"})).first()
    assert row.quantity is None


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"quantity": 0}, "non-positive quantity"),
        ({"quantity": -1}, "non-positive quantity"),
        ({"quantity": None}, "missing quantity"),
        ({"unit_price": 0.0}, "non-positive unit_price"),
        ({"unit_price": None}, "missing unit_price"),
        ({"quantity": "x"}, "missing quantity"),
    ],
)
def test_reject_reasons(spark, change, reason):
    enriched = ingest.enrich(ingest.parse_events(messages(spark, GOOD, GOOD | change)))
    assert ingest.valid_events(enriched).count() == 1
    assert [r.reason for r in ingest.rejected_events(enriched).collect()] == [reason]


def test_unreadable_time_is_kept_as_in_the_positive_value_rule(spark):
    enriched = ingest.enrich(ingest.parse_events(messages(spark, GOOD | {"event_time": "soon"})))
    row = ingest.valid_events(enriched).first()
    assert row.event_time is None and row.is_weekend is False and row.year is None


@pytest.mark.parametrize(
    "text, strict, lenient",
    [
        ("2025-01-02 03:04:05", True, "2025-01-02 03:04:05"),
        ("2025-01-02T03:04:05", False, "2025-01-02 03:04:05"),
        ("2025-01-02T03:04:05Z", False, "2025-01-02 03:04:05"),
        ("2025-01-02T03:04:05+02:00", False, "2025-01-02 01:04:05"),
        ("2025-01-02 03:04:05.987", False, "2025-01-02 03:04:05"),
        ("2025-01-02", False, "2025-01-02 00:00:00"),
        ("2025/01/02 03:04:05", False, "2025-01-02 03:04:05"),
        ("02/01/2025 03:04:05", False, "2025-01-02 03:04:05"),
        ("20250102030405", False, "2025-01-02 03:04:05"),
        ("1735787045", False, "2025-01-02 03:04:05"),
        ("1735787045678", False, "2025-01-02 03:04:05"),
        ("garbage", False, None),
        ("2025-13-40 00:00:00", False, None),
        ("", False, None),
        (None, False, None),
    ],
)
def test_time_forms(spark, text, strict, lenient):
    frame = spark.createDataFrame([(text,)], "t STRING").select(
        ingest.strict_time(F.col("t")).alias("strict"),
        F.date_format(ingest.lenient_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("lenient"),
    )
    row = frame.first()
    assert (row.strict is not None) == strict
    assert row.lenient == lenient


@pytest.mark.parametrize(
    "time, dow, weekend",
    [
        ("2024-01-06 10:00:00", 7, True),
        ("2024-01-07 10:00:00", 1, True),
        ("2024-01-08 10:00:00", 2, False),
    ],
)
def test_lake_weekday_counts_from_sunday(spark, time, dow, weekend):
    row = ingest.enrich(ingest.parse_events(messages(spark, GOOD | {"event_time": time}))).first()
    assert (row.day_of_week, row.is_weekend, row.hour_of_day) == (dow, weekend, 10)
    assert (row.year, row.month, row.day) == (2024, 1, int(time[8:10]))
    assert row.revenue == 19.0


def test_encode_then_parse_gives_the_event_back(spark, events):
    frame = events(("2024-02-03 04:05:06", 7, "Vacuüm \"X\"", "Home", "RETURN", 3, 19.99))
    back = ingest.parse_events(ingest.encode(frame)).select(*EVENT_COLUMNS)
    assert back.collect() == frame.collect()


def test_each_message_is_parsed_once(spark):
    plan = ingest.lake_rows(messages(spark, GOOD))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
