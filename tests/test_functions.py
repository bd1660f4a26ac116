"""Money, text, ratios and the calendar against plain Python."""

import datetime as dt
import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.functions import calendar, money, ratios, text


def one(frame):
    return frame.first()[0]


# Money


def test_sum_does_not_depend_on_order_or_partitions(spark):
    generator = random.Random(1)
    rows = [(generator.randint(1, 100), round(generator.uniform(0, 500), 2)) for _ in range(5000)]
    exact = sum(q * round(p * 100) for q, p in rows) / 100
    for partitions in (1, 3, 16):
        generator.shuffle(rows)
        frame = spark.createDataFrame(rows, "q INT, p DOUBLE").repartition(partitions)
        assert one(frame.agg(money.money_sum("p", "q"))) == exact


def test_fractions_of_a_cent_count(spark):
    frame = spark.createDataFrame([(3, 0.0004), (2, 1.2345)], "q INT, p DOUBLE")
    total = one(frame.agg(money.money_sum("p", "q")))
    assert total == pytest.approx(2.4702, abs=1e-12)


def test_huge_and_missing_values(spark):
    frame = spark.createDataFrame(
        [(2_000_000_000, 1e12), (None, 5.0), (5, None)], "q INT, p DOUBLE"
    )
    row = frame.agg(
        money.money_sum("p", "q"), money.money_avg("p", "q")
    ).first()
    assert row[0] == pytest.approx(2e21) and row[1] == pytest.approx(2e21)
    nothing = frame.where("q IS NULL").agg(money.money_sum("p", "q"))
    assert one(nothing) is None


def test_not_a_number_stays_visible(spark):
    frame = spark.createDataFrame([(1, float("nan")), (1, 1.0)], "q INT, p DOUBLE")
    assert pd.isna(one(frame.agg(money.money_sum("p", "q"))))


def test_rows_outside_the_condition_stay_in_the_average(spark):
    frame = spark.createDataFrame([("SALE", 1, 9.0), ("RETURN", 1, 5.0)], "t STRING, q INT, p DOUBLE")
    sold = "t = 'SALE'"
    row = frame.agg(
        money.money_sum("p", "q", sold), money.money_avg("p", "q", sold)
    ).first()
    assert tuple(row) == (9.0, 4.5)


# Text


def python_currency(v):
    if pd.isna(v):
        return "$0"
    for suffix, size in (("M", 1e6), ("K", 1e3)):
        if abs(v) >= size:
            return f"${v / size:.2f}{suffix}"
    return f"${v:.2f}"


def python_number(v, decimals):
    if pd.isna(v):
        return "0"
    for suffix, size in (("B", 1e9), ("M", 1e6), ("K", 1e3)):
        if abs(v) >= size:
            return f"{v / size:.{decimals}f}{suffix}"
    return f"{v:.{decimals}f}"


def python_percentage(v, decimals):
    if pd.isna(v):
        return "0%"
    return f"{v * 100 if abs(v) <= 1 else v:.{decimals}f}%"


EDGES = [None, 0.0, 0.5, 1.0, -1.0, 0.004, 999.0, 999.995, 1e3, 1115.0, 1225.0, 1235.0, 1e6, 1e9]
EDGES += [-5.0, -1234.5, 0.125, 2.5, 3.5, 1.005, 99.95, 12345678.9, 1e12, float("nan")]


def assert_texts(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select(
        text.currency_text(F.col("v")),
        text.number_text(F.col("v")),
        text.number_text(F.col("v"), 2),
        text.percentage_text(F.col("v")),
    )
    expected = [
        (python_currency(v), python_number(v, 0), python_number(v, 2), python_percentage(v, 1))
        for v in values
    ]
    assert [tuple(r) for r in frame.collect()] == expected


def test_text_edges(spark):
    assert_texts(spark, EDGES)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e11, 1e11), min_size=200, max_size=300))
def test_text_of_any_number(spark, values):
    assert_texts(spark, values)


def test_text_of_amounts_in_cents(spark):
    assert_texts(spark, [n / 100 for n in range(0, 400_000, 317)] + [float(n) for n in range(1000, 3000, 5)])


def test_percentage_without_the_ratio_rule(spark):
    frame = spark.createDataFrame([(0.5,)], "v DOUBLE")
    assert one(frame.select(text.percentage_text(F.col("v"), 1, ratio_below_one=False))) == "0.5%"


def test_type_label(spark):
    frame = spark.createDataFrame([("SALE",), ("RETURN",)], "t STRING")
    assert [r[0] for r in frame.select(text.type_label(F.col("t"))).collect()] == [
        "🛒 SALE",
        "↩️ RETURN",
    ]


# Ratios


@pytest.mark.parametrize(
    "current, previous, expected", [(0.0, 0.0, 0.0), (5.0, 0.0, 100.0), (15.0, 10.0, 50.0), (5.0, None, None)]
)
def test_growth(spark, current, previous, expected):
    frame = spark.createDataFrame([(current, previous)], "c DOUBLE, p DOUBLE")
    assert one(frame.select(ratios.growth_percent(F.col("c"), F.col("p")))) == expected


def test_ratio_of_zero_is_null(spark):
    frame = spark.createDataFrame([(1, 0)], "a INT, b INT")
    assert frame.select(ratios.ratio(F.col("a"), F.col("b")), ratios.percent(F.col("a"), F.col("b"))).first() == (None, None)


# Calendar


@pytest.mark.parametrize(
    "date, iso, weekend, holiday, summer",
    [
        ("2024-01-06", 6, True, 0, 0),
        ("2024-01-07", 7, True, 0, 0),
        ("2024-01-08", 1, False, 0, 0),
        ("2024-10-31", 4, False, 0, 0),
        ("2024-11-01", 5, False, 1, 0),
        ("2024-12-31", 2, False, 1, 0),
        ("2024-05-31", 5, False, 0, 0),
        ("2024-06-01", 6, True, 0, 1),
        ("2024-08-31", 6, True, 0, 1),
        ("2024-09-01", 7, True, 0, 0),
    ],
)
def test_calendar_parts(spark, date, iso, weekend, holiday, summer):
    t, month = F.col("t"), F.month("t")
    row = (
        spark.createDataFrame([(date,)], "d STRING")
        .select(F.col("d").cast("timestamp").alias("t"))
        .select(
            calendar.iso_weekday(t),
            calendar.is_weekend(t),
            calendar.holiday_season(month),
            calendar.summer(month),
            calendar.day_name(calendar.iso_weekday(t)),
            calendar.month_number(t),
        )
        .first()
    )
    assert tuple(row[:4]) == (iso, weekend, holiday, summer)
    assert row[4] == dt.date.fromisoformat(date).strftime("%A")
    assert row[5] == int(date[:4] + date[5:7])


def test_last_days_starts_at_midnight_and_last_hours_does_not(events, at):
    frame = events(
        ("2024-01-29 23:59:59",), ("2024-01-30 00:00:00",), ("2024-01-30 11:59:59",), ("2024-01-30 12:00:00",)
    )
    assert calendar.last_days(frame, at("2024-01-31 12:00:00"), 1).count() == 3
    assert calendar.last_hours(frame, at("2024-01-31 12:00:00"), 24).count() == 1


def test_forecast_window_covers_eight_dates(spark, at):
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-20', DATE'2024-02-10')) AS forecast_date")
    kept = [r[0].day for r in calendar.forecast_window(days, at("2024-01-24 15:00:00")).collect()]
    assert kept == [24, 25, 26, 27, 28, 29, 30, 31]


def test_version_stamp(at):
    assert calendar.version_stamp(at("2024-01-02 03:04:05")) == "20240102_030405"


def test_money_of_the_largest_prices_and_quantities_does_not_overflow(spark):
    rows = [(2**31 - 1, 9_999_999.99)] * 40 + [(1, 0.25)]
    frame = spark.createDataFrame(rows, "q INT, p DOUBLE")
    total = frame.agg(money.money_sum("p", "q")).first()[0]
    exact = (40 * (2**31 - 1) * 999_999_999 + 25) / 100
    assert total == exact
