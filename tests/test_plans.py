"""Plans of the registered queries keep to what scales."""

import pytest

import __spark_entry__ as entry
from conftest import SF_TINY

# Queries that run jobs of their own while they are built.
EAGER = {k for k in entry.queries() if k.startswith(("stream_", "rollup_", "ml_", "model_metrics"))}
EAGER |= {"realtime_table", "lake_pruned_scan", "retention_90d", "save_predictions"}
EAGER |= {"predictions_csv_roundtrip", "import_predictions"}
EAGER |= {"lake_history_then_stream", "unified_from_tables", "unified_raw", "model_activation"}


# The optional subpackage has tests of its own.
EAGER |= entry._llm_queries().keys()


@pytest.mark.parametrize("key", sorted(entry.queries().keys() - EAGER))
def test_plan(spark, key):
    plan = entry.queries()[key](spark, SF_TINY)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "Pandas"):
        assert bad not in plan, bad


@pytest.mark.parametrize("key", ["realtime_kpis", "top_products", "anomaly_alerts", "sales_anomaly_stats"])
def test_recent_reports_push_their_range_to_the_scan(spark, key):
    plan = entry.queries()[key](spark, SF_TINY)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan


@pytest.mark.parametrize("key", ["top_products", "realtime_by_store", "return_rate_top", "top_forecasts"])
def test_top_lists_do_not_sort_everything(spark, key):
    plan = entry.queries()[key](spark, SF_TINY)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize(
    "key",
    ["revenue_metrics", "daily_sales_summary_stats", "forecast_totals", "anomaly_counts_all", "anomaly_summary_all"],
)
def test_no_sort_below_an_aggregate(spark, key):
    plan = entry.queries()[key](spark, SF_TINY)._jdf.queryExecution().executedPlan().toString()
    first = plan.index("HashAggregate")
    assert "rangepartitioning" not in plan[first:]


def test_matrix_is_one_grouping_and_one_sort(spark):
    plan = entry.queries()["peak_hours_matrix"](spark, SF_TINY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange rangepartitioning") <= 1


def test_summary_plans_two_small_scans(spark):
    plan = entry.queries()["model_performance_summary"](spark, SF_TINY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "events.parquet" not in plan


def test_bucketed_accuracy_has_no_exchange(spark):
    plan = entry.queries()["prediction_accuracy_bucketed"](spark, SF_TINY)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
