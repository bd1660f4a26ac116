"""Features read the events once, and hold up on odd rows."""

from conftest import SF_TINY
from tallyline.forecasting import features
from tallyline.sources import sample


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_training_reads_the_events_once(spark):
    stored = sample.store_events(spark, SF_TINY)
    assert _plan(features.training_features(stored)).count("FileScan parquet") == 1


def test_scoring_groups_events_by_weekday_first(spark):
    """An event updates one average and one count, not those of seven weekdays."""
    for rows in (
        features.score_features(sample.store_events(spark, SF_TINY), sample.AS_OF),
        features.weekly_score_features(sample.store_events(spark, SF_TINY), sample.AS_OF),
    ):
        assert _plan(rows).count("partial_avg(") == 1


def test_weekday_figures_of_odd_rows(events):
    monday = "2024-01-01 10:00:00"
    rows = events(
        (monday, 1, "P00", "C0", "SALE", 4),
        ("2024-01-08 11:00:00", 1, "P00", "C0", "SALE", 2),
        ("2024-01-08 12:00:00", 1, "P00", "C0", "SALE", None),
        ("2024-01-08 13:00:00", 1, "P00", "C0", "SALE", -3),
        ("2024-01-02 10:00:00", 1, "P00", "C0", "SALE", None),
        ("2024-01-03 10:00:00", 1, "P00", "C0", "RETURN", 5),
        (None, 1, "P00", "C0", "SALE", 7),
        (monday, None, "P00", "C0", "SALE", 7),
        (monday, 1, None, "C0", "SALE", 7),
    )
    found = features.training_features(rows).orderBy("hour_of_day").collect()
    assert [(r.hour_of_day, r.total_demand, r.avg_demand, r.transaction_count) for r in found] == [(10, 4, 1.0, 4), (11, 2, 1.0, 4)]
    scored = features.score_features(rows, sample.AS_OF).where("product_id = 'P00' AND store_id = 1")
    by_day = {(r.day_of_week, r.avg_demand, r.transaction_count) for r in scored.collect()}
    assert by_day == {(1, 1.0, 4), (2, 1.0, 1), *((d, 1.0, 1) for d in range(3, 8))}
