"""Edge cases of the reports: layers, zero denominators, ties, empty input, frames."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tallyline.operators import moving
from tallyline.plans import anomaly, catalog, forecast, history, inventory, realtime, serving

AS_OF = dt.datetime(2024, 2, 1)


def hour(n):
    return (dt.datetime(2024, 1, 28) + dt.timedelta(hours=n)).strftime("%Y-%m-%d %H:%M:%S")


def test_event_in_both_layers_counts_twice_raw_and_once_with_cutover(events, at):
    both = events(("2024-01-10 10:00:00",), ("2024-01-20 10:00:00",))
    raw = serving.combine_layers(both, both)
    cut = serving.combine_layers(both, both, at("2024-01-20 10:00:00"))
    assert raw.count() == 4
    assert [(r.event_time.day, r.source) for r in cut.orderBy("event_time").collect()] == [
        (10, "historical"),
        (20, "realtime"),
    ]


def test_event_without_a_time_is_answered_by_the_archive(events, at):
    timeless = events((None, 1, "A", "C", "SALE", 2, 5.0))
    cut = serving.combine_layers(timeless, timeless, at("2024-01-20 10:00:00"))
    assert [(r.quantity, r.source) for r in cut.collect()] == [(2, "historical")]


def test_return_rate_leaves_out_products_never_sold(events):
    rows = serving.return_rate(
        events(
            (hour(0), 1, "A", "C", "SALE", 2, 5.0),
            (hour(1), 1, "A", "C", "RETURN", 1, 5.0),
            (hour(1), 1, "B", "C", "RETURN", 1, 5.0),
        )
    ).collect()
    assert [(r.product_id, r.return_rate_pct, r.total_return_value) for r in rows] == [("A", 100.0, 5.0)]


def test_store_rate_without_sales_is_null_and_zero_without_both(events):
    frame = events(
        (hour(0), 1, "A", "C", "RETURN", 1, 5.0),
        (hour(0), 2, "A", "C", "RESTOCK", 1, 5.0),
        (hour(0), 3, "A", "C", "SALE", 1, 5.0),
        (hour(0), 3, "A", "C", "RETURN", 1, 5.0),
    )
    rows = history.store_performance(frame, AS_OF).collect()
    assert {r.store_id: r.return_rate for r in rows} == {1: None, 2: 0.0, 3: 100.0}


def test_average_value_divides_by_all_movements(events):
    frame = events((hour(0), 1, "A", "C", "SALE", 1, 9.0), (hour(0), 1, "A", "C", "RETURN", 1, 5.0))
    row = serving.store_daily_performance(frame, AS_OF).first()
    assert (row.daily_revenue, row.avg_transaction_value, row.total_items_moved) == (9.0, 4.5, 2)


def test_empty_input_gives_zero_counts_and_null_sums(events):
    nothing = events((hour(0),)).where("false")
    row = realtime.realtime_kpis(nothing, AS_OF).first()
    assert tuple(row) == (0, None, None, None)
    assert tuple(realtime.home_kpis(nothing).first()) == (0, None, 0, 0)
    assert tuple(history.performance_metrics(nothing).first()) == (0, 0, 0)
    metrics = history.revenue_metrics(nothing.withColumn("total_revenue", F.col("unit_price")))
    assert tuple(metrics.first()) == (0.0, 0.0, 0.0, 0.0)
    assert tuple(inventory.net_stock_movement(nothing, AS_OF).first()) == (0, 0, 0, 0, "Decrease")
    assert tuple(anomaly.anomaly_counts(nothing, AS_OF).first()) == (0, 0, 0)


def test_ties_are_broken_by_key(events):
    rows = [(hour(72), s, f"P{s:02d}", "C", "SALE", 1, 5.0) for s in range(1, 31)]
    frame = events(*rows)
    top = [r.store_id for r in realtime.realtime_by_store(frame, AS_OF, 168).collect()]
    assert top == list(range(1, 11))
    products = [r.product_id for r in realtime.top_products(frame, AS_OF, 168).collect()]
    assert products == [f"P{s:02d}" for s in range(1, 16)]
    stamped = frame.withColumn("inserted_at", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    assert [r.store_id for r in realtime.latest_events(stamped).collect()] == [1, 2, 3, 4, 5]


def test_busiest_hour_is_the_first_of_equals(events):
    row = history.peak_hour(events((hour(30),), (hour(5),)), AS_OF).first()
    assert (row.day_of_week, row.hour, row.day_name) == (1, 6, "Monday")


def test_matrix_has_every_hour_and_null_for_none(events):
    matrix = history.peak_hours_matrix(events((hour(5),), (hour(5),)), AS_OF)
    assert matrix.columns == ["day_of_week", "day_name"] + [f"h{h}" for h in range(24)]
    row = matrix.first()
    assert (row.h5, row.h6) == (2, None)


def test_shares_add_up(events):
    rows = [(hour(0), 1, "P", f"C{i}", "SALE", 1, 1.0 + i) for i in range(7)]
    shares = [r.revenue_share for r in history.category_performance(events(*rows), AS_OF).collect()]
    assert sum(shares) == pytest.approx(100)


def test_leaders_with_equal_revenue_share_a_rank(events):
    rows = [(hour(0), s, "P", "C", "SALE", 1, p) for s, p in ((1, 5.0), (2, 9.0), (3, 5.0), (4, 1.0))]
    ranks = [(r.store_id, r.revenue_rank) for r in history.store_leaderboard(events(*rows)).collect()]
    assert ranks == [(2, 1), (1, 2), (3, 2), (4, 4)]


def test_growth_by_month(events):
    frame = events(
        ("2024-01-05 00:00:00", 1, "P", "C", "SALE", 1, 10.0),
        ("2024-02-05 00:00:00", 1, "P", "C", "SALE", 1, 15.0),
        ("2024-04-05 00:00:00", 1, "P", "C", "SALE", 1, 7.5),
    )
    rows = history.growth_rate(frame).collect()
    assert [(r.month, r.growth_pct) for r in rows] == [(202401, None), (202402, 50.0), (202404, -50.0)]


def test_slow_movers_use_the_span_of_dates(events):
    frame = events(
        ("2024-01-20 23:00:00", 1, "A", "C", "SALE", 6),
        ("2024-01-26 01:00:00", 1, "A", "C", "SALE", 6),
        ("2024-01-20 01:00:00", 1, "B", "C", "SALE", 6),
        ("2024-01-25 23:00:00", 1, "B", "C", "SALE", 6),
    )
    rows = inventory.slow_moving_products(frame, AS_OF).collect()
    assert [(r.product_id, r.days_active, r.avg_daily_sales) for r in rows] == [("A", 6, 2.0)]


def test_product_without_forecast_has_low_priority(spark, events):
    sold = events((hour(0), 1, "A", "C", "SALE", 30), (hour(0), 1, "B", "C", "SALE", 30))
    forecasts = spark.sql("SELECT 'A' AS product_id, DATE'2024-02-01' AS forecast_date, 100.0D AS predicted_demand")
    rows = inventory.restock_priority(sold, forecasts, AS_OF).collect()
    assert [(r.product_id, r.predicted_7d, r.priority) for r in rows] == [
        ("A", 100.0, "High Priority"),
        ("B", 0.0, "Low Priority"),
    ]
    demand = inventory.high_demand_products(sold, forecasts, AS_OF).collect()
    assert [(r.product_id, r.predicted_7d, r.avg_daily_sales) for r in demand] == [("A", 100.0, 1.0), ("B", 0.0, 1.0)]


@pytest.mark.parametrize(
    "ratio, label",
    [
        (None, "NORMAL"),
        (0.79, "LOW_DEMAND"),
        (0.8, "NORMAL"),
        (1.2, "NORMAL"),
        (1.21, "MODERATE_INCREASE"),
        (1.5, "MODERATE_INCREASE"),
        (1.51, "HIGH_DEMAND"),
    ],
)
def test_restock_labels(spark, ratio, label):
    frame = spark.createDataFrame([(ratio,)], "r DOUBLE")
    assert frame.select(forecast.restock_label(F.col("r"))).first()[0] == label


def test_accuracy_with_zero_actual_has_no_percentage(spark, events):
    sold = events(("2024-02-01 05:00:00", 1, "A", "C", "SALE", 0))
    predictions = spark.sql(
        "SELECT 'A' AS product_id, 1 AS store_id, DATE'2024-02-01' AS forecast_date, 5 AS forecast_hour, "
        "2.0D AS predicted_demand, 'v' AS model_version, TIMESTAMP'2024-02-01 00:00:00' AS prediction_time "
        "UNION ALL SELECT 'B', 1, DATE'2024-02-01', 5, 2.0D, 'v', TIMESTAMP'2024-02-01 00:00:00'"
    )
    rows = forecast.prediction_accuracy(predictions, sold).collect()
    assert [(r.product_id, r.absolute_error, r.percentage_error) for r in rows] == [("A", 2.0, None)]
    summary = forecast.model_performance_summary(forecast.prediction_accuracy(predictions, sold)).first()
    assert (summary.predictions_made, summary.median_percentage_error) == (1, None)


# Moving statistics


def test_frame_is_25_rows_with_the_current_one(events):
    rows = [(hour(n), 1, "P", "C", "SALE", 1, float(n + 1)) for n in range(30)]
    stats = moving.moving_stats(moving.hourly_revenue(events(*rows))).orderBy("hour").collect()
    assert stats[24].moving_avg_24h == statistics.mean(range(1, 26))
    assert stats[25].moving_avg_24h == statistics.mean(range(2, 27))
    assert stats[25].std_dev_24h == pytest.approx(statistics.pstdev(range(2, 27)))
    assert stats[0].std_dev_24h == 0.0


def test_missing_hours_are_skipped_or_filled(events):
    hourly = moving.hourly_revenue(
        events(*[(hour(n), 1, "P", "C", "SALE", 1, 30.0) for n in (1, 2, 30)])
    )
    plain = moving.moving_stats(hourly).orderBy("hour").collect()
    filled = moving.moving_stats(hourly, fill_gaps=True).orderBy("hour").collect()
    assert (len(plain), plain[-1].moving_avg_24h) == (3, 30.0)
    assert (len(filled), filled[-1].moving_avg_24h) == (30, 30.0 / 25)


def test_constant_revenue_raises_no_alert(events):
    rows = [(hour(n), 1, "P", "C", "SALE", 1, 5.0) for n in range(30)]
    assert anomaly.anomaly_alerts(events(*rows), AS_OF, sensitivity=0.0).count() == 0


def test_alerts_name_their_direction(events):
    values = [10.0 + n % 2 for n in range(24)] + [100.0, 10.0, 0.01]
    rows = [(hour(n), 1, "P", "C", "SALE", 1, v) for n, v in enumerate(values)]
    alerts = anomaly.anomaly_alerts(events(*rows), AS_OF, sensitivity=2.0).collect()
    assert [(r.hour, r.anomaly_type) for r in alerts] == [(dt.datetime(2024, 1, 29, 0), "High")]
    low = anomaly.anomaly_alerts(events(*rows[:24], (hour(24), 1, "P", "C", "SALE", 1, 0.5)), AS_OF)
    assert [r.anomaly_type for r in low.collect()] == ["Low"]


def test_bands_of_chosen_categories(events):
    frame = events((hour(0), 1, "P", "A", "SALE", 1, 5.0), (hour(0), 1, "P", "B", "SALE", 1, 5.0))
    assert anomaly.anomaly_bands(frame, AS_OF).count() == 2
    rows = anomaly.anomaly_bands(frame, AS_OF, categories=["B'; DROP"]).collect()
    assert rows == []
    assert [r.category for r in anomaly.anomaly_bands(frame, AS_OF, categories=["B"]).collect()] == ["B"]


# Catalog


def test_views_can_be_queried_by_name(spark, events):
    stored = events((hour(0), 1, "A", "C", "SALE", 2, 5.0)).withColumn("inserted_at", F.current_timestamp())
    names = catalog.register_views(spark, stored, stored, AS_OF)
    listed = [r.name for r in catalog.catalog_list(spark).collect()]
    assert set(names) <= set(listed) and listed == sorted(listed)
    assert len(names) == 14
    assert spark.sql("SELECT total_revenue FROM sales_by_category").first()[0] == 20.0
    assert spark.sql("SELECT total_revenue FROM daily_sales_summary").first()[0] == 10.0
    for name in names:
        spark.table(name).collect()
        spark.catalog.dropTempView(name)


def test_all_views_on_the_sample_tables(spark):
    from conftest import SF_TINY
    from tallyline.plans.forecast import ml_metrics_sql, prediction_accuracy
    from tallyline.sources import sample

    recent = sample.store_events(spark, SF_TINY)
    predictions = sample.predictions(spark, SF_TINY)
    metrics = ml_metrics_sql(prediction_accuracy(predictions, recent))
    names = catalog.register_views(
        spark, recent, recent, sample.CUTOVER, sample.CUTOVER, predictions, metrics
    )
    assert len(names) == 20
    for name in names:
        assert spark.table(name).count() > 0, name
        spark.catalog.dropTempView(name)
