"""Every registered query with SQL gives the same rows in DuckDB."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL, SF_TINY
from tallyline.checks.compare import connect, differences

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_TINY)


def test_every_sql_has_a_query():
    assert not SQL.keys() - entry.queries().keys()


def test_only_model_queries_have_no_sql():
    # The optional subpackage has tests of its own.
    assert entry.queries().keys() - SQL.keys() - entry._llm_queries().keys() == {
        "ml_train",
        "ml_predict",
        "ml_compare_models",
        "model_metrics_log",
    }


@pytest.mark.parametrize("key", sorted(SQL.keys() - entry._llm_queries().keys()))
def test_same_as_sql(spark, con, key):
    assert differences(entry.queries()[key](spark, SF_TINY), con, SQL[key]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


# Known figures of the small tables.
KNOWN_LAYERS = {
    ("RESTOCK", "historical"): (1552, 85348, 4449289.56),
    ("RESTOCK", "realtime"): (465, 25278, 1160364.64),
    ("RETURN", "historical"): (1550, 4551, 222428.29),
    ("RETURN", "realtime"): (464, 1386, 66571.97),
    ("SALE", "historical"): (4567, 25265, 1252086.70),
    ("SALE", "realtime"): (1402, 7799, 382947.88),
}


def test_known_layer_totals(spark):
    from pyspark.sql import functions as F

    from tallyline.plans.serving import revenue, units
    from tallyline.sources import sample

    rows = (
        sample.unified(spark, SF_SMALL)
        .groupBy("transaction_type", "source")
        .agg(F.count("*").alias("n"), units().alias("q"), revenue().alias("r"))
        .collect()
    )
    found = {(r.transaction_type, r.source): (r.n, r.q, r.r) for r in rows}
    assert found == KNOWN_LAYERS


def test_known_forecast_figures(spark):
    from pyspark.sql import functions as F

    from tallyline.plans import forecast
    from tallyline.sources import sample

    v1 = sample.predictions(spark, SF_SMALL, "fixture_v1")
    assert v1.count() == 42000
    assert v1.agg(F.sum("predicted_demand")).first()[0] == 8538.46875
    accuracy = forecast.prediction_accuracy(v1, sample.store_events(spark, SF_SMALL))
    assert accuracy.count() == 1386
    assert accuracy.agg(F.sum("absolute_error")).first()[0] == 7516.74609375
    summary = forecast.model_performance_summary(accuracy).first()
    assert round(summary.avg_percentage_error, 6) == 94.112106
    assert round(summary.median_percentage_error, 6) == 97.265625
    assert round(summary.p90_percentage_error, 6) == 99.553571


def test_known_restock_labels(spark):
    from tallyline.plans import forecast
    from tallyline.sources import sample

    past = sample.store_events(spark, SF_SMALL, end=sample.CUTOVER)
    v1 = sample.predictions(spark, SF_SMALL, "fixture_v1")
    rows = forecast.restock_recommendations(v1, past, sample.CUTOVER)
    counts = {r.recommendation: r["count"] for r in rows.groupBy("recommendation").count().collect()}
    assert counts == {
        "HIGH_DEMAND": 325,
        "MODERATE_INCREASE": 80,
        "NORMAL": 255,
        "LOW_DEMAND": 1090,
    }
