"""Exact quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators.quantiles import (
    RANK_ERROR,
    aggregate_with_quantiles,
    quantiles_from_sketches,
    value_sketches,
)

WANTED = {"q0": 0.0, "q1": 0.001, "q50": 0.5, "q90": 0.9, "q100": 1.0}


def check(frame):
    found = {
        r.g: r
        for r in aggregate_with_quantiles(frame, "g", [F.count("*").alias("n")], "v", WANTED).collect()
    }
    data = frame.where("v IS NOT NULL").toPandas()
    for group, values in data.groupby("g").v:
        for name, fraction in WANTED.items():
            expected = np.quantile(values.to_numpy(), fraction)
            assert found[group][name] == pytest.approx(expected, rel=1e-12, abs=1e-12), (group, name)
    return found


def test_small_groups(spark):
    rows = [("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 3.0), ("c", 1.0), ("c", 2.0), ("c", None)]
    rows += [("d", float(x)) for x in range(10)] + [("e", None)]
    found = check(spark.createDataFrame(rows, "g STRING, v DOUBLE"))
    assert found["e"].n == 1 and found["e"].q50 is None


def test_large_skewed_groups(spark):
    # One group holds most rows, a third of them the same value.
    frame = spark.range(400_000).select(
        F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("g"),
        F.when(F.col("id") % 3 == 0, 50.0).otherwise(F.exp(F.randn(7))).alias("v"),
    ).persist()
    check(frame)
    frame.unpersist()


@pytest.mark.parametrize("rows", [1, 10, 1_000, 200_000])
def test_one_path_for_every_size(spark, rows):
    frame = spark.range(rows).selectExpr("'a' AS g", "CAST(id * 7919 % 10007 AS DOUBLE) AS v")
    check(frame)


def test_null_groups_and_empty_input_keep_their_aggregates(spark):
    frame = spark.createDataFrame([(None, 1.0), (None, None), ("a", None), ("b", 2.0)], "g STRING, v DOUBLE")
    wanted = [F.count("*").alias("n"), F.sum("v").alias("s")]
    found = {r.g: tuple(r) for r in aggregate_with_quantiles(frame, "g", wanted, "v", {"q": 0.5}).collect()}
    assert found == {None: (None, 2, 1.0, None), "a": ("a", 1, None, None), "b": ("b", 1, 2.0, 2.0)}
    assert aggregate_with_quantiles(frame.limit(0), "g", wanted, "v", {"q": 0.5}).count() == 0


def test_rows_are_read_once(spark, tmp_path):
    spark.range(1000).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    plan = aggregate_with_quantiles(frame, "g", [F.count("*").alias("n")], "v", WANTED)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 2 and str(tmp_path) not in text


def test_sketches_of_dates_merge_within_the_bound(spark):
    rows = spark.range(200_000).selectExpr(
        "if(id % 10 = 0, 'small', 'large') AS g", "id % 7 AS day", "if(id % 3 = 0, 50.0D, exp(randn(7))) AS v"
    )
    rows = rows.unionByName(spark.createDataFrame([("none", 1, None), ("large", 99, None)], "g STRING, day BIGINT, v DOUBLE"))
    rows = rows.persist()
    wanted = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    stored = value_sketches(rows, ["g", "day"], "v")
    found = {r.g: r for r in quantiles_from_sketches(stored, "g", wanted).collect()}
    for g, values in rows.where("v IS NOT NULL").toPandas().groupby("g").v:
        for name, f in wanted.items():
            low, high = (values < found[g][name]).mean(), (values <= found[g][name]).mean()
            assert low - RANK_ERROR <= f <= high + RANK_ERROR, (g, name)
    assert found["none"].q50 is None and found["none"].rows == 1 and found["large"].rows == 180_001
    rows.unpersist()
