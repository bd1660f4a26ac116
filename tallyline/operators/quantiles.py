"""Exact interpolated quantiles of groups of any size, by one path, and sketches of them to be merged.

The built-in exact percentile keeps every distinct value of a group in one task.  Here equal values are
counted first, and that reduction is written once.  A sketch of bounded size cuts each group into ranges
with about as many different values; the exact counts of the ranges tell in which range a rank lies, and
only the values of that range are ranked.  The sketch decides how evenly the work is dealt out, never
the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.session import scratch_path

SKETCH_ACCURACY = 10_000
RANGES = 64
#: Size of a mergeable sketch, and a bound on the error of its ranks as a share of all values.
SKETCH_K, RANK_ERROR = 800, 0.01


def aggregate_with_quantiles(
    rows: DataFrame, group: str, aggregates: list[Column], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Per group the ``aggregates`` and one exact quantile column per entry.

    ``aggregates`` are named counts and sums: they are taken per value and then added up, so the rows
    are read once.  Two small tables are written: the counts per value, then the same with the range of
    each value; the result reads the second one twice.  A null group keeps its aggregates and has no
    quantiles; values that are null are in no range.
    """
    spark = rows.sparkSession
    values, ranged = scratch_path(spark, "value-counts"), scratch_path(spark, "value-ranges")
    counted = rows.groupBy(group, F.col(value).alias("_v")).agg(
        F.count(value).alias("_c"), *aggregates
    )
    added = counted.columns[3:]
    counted.write.parquet(values)
    counted = spark.read.parquet(values)
    marks = counted.groupBy(F.col(group).alias("_group")).agg(
        F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], SKETCH_ACCURACY).alias("_marks")
    )
    # One row per group on the right: AQE broadcasts it when its measured size allows, else this is an
    # ordinary shuffle join with skew handling.
    counted.join(marks, F.col(group).eqNullSafe(F.col("_group"))).selectExpr(
        group, "_v", "_c", *added, "if(_v IS NULL, -1, size(filter(_marks, m -> m < _v))) AS _part"
    ).write.parquet(ranged)
    placed = spark.read.parquet(ranged)

    # At most RANGES + 1 rows per group.
    parts = placed.groupBy(group, "_part").agg(
        F.sum("_c").alias("_size"), *[F.sum(a).alias(a) for a in added]
    )
    whole = f"OVER (PARTITION BY {group})"
    parts = parts.selectExpr(
        group,
        "_part",
        "_size",
        f"sum(_size) OVER (PARTITION BY {group} ORDER BY _part) - _size AS _past",
        f"sum(_size) {whole} AS _n",
        f"min(_part) {whole} AS _lowest",
        *[f"sum({a}) {whole} AS {a}" for a in added],
    )
    ranks = ", ".join(
        f"struct('{end}{i}' AS name, {end}({f!r}D * (_n - 1)) AS rank)"
        for i, f in enumerate(quantiles.values())
        for end in ("floor", "ceil")
    )
    # A range without a wanted rank is kept only to carry the aggregates of its group.
    wanted = (
        parts.withColumn(
            "_wanted", F.expr(f"filter(array({ranks}), w -> _past <= w.rank AND w.rank < _past + _size)")
        )
        .where("size(_wanted) > 0 OR _part = _lowest")
        .withColumn("_part", F.expr("if(size(_wanted) > 0, _part, NULL)"))
        .drop("_size", "_lowest")
    )
    ranked = wanted.join(placed.select(group, "_part", "_v", "_c"), [group, "_part"], "left").withColumn(
        "_last", F.expr(f"_past + sum(_c) OVER (PARTITION BY {group}, _part ORDER BY _v) - 1")
    )
    found = "filter(_wanted, w -> _last - _c < w.rank AND w.rank <= _last).name"
    ends = [(end, i) for i in range(len(quantiles)) for end in ("floor", "ceil")]
    result = (
        ranked.withColumn("_found", F.expr(found))
        .groupBy(group)
        .agg(
            F.first("_n").alias("_n"),
            *[F.first(a).alias(a) for a in added],
            *[
                F.expr(f"max(CASE WHEN array_contains(_found, '{end}{i}') THEN _v END) AS _{end}_{i}")
                for end, i in ends
            ],
        )
    )
    for i, (name, f) in enumerate(quantiles.items()):
        position = f"{f!r}D * (_n - 1)"
        between = f"_floor_{i} + (_ceil_{i} - _floor_{i}) * ({position} - floor({position}))"
        result = result.withColumn(name, F.expr(between))
    return result.drop("_n", *[f"_{end}_{i}" for end, i in ends])


def value_sketches(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One mergeable sketch of the values per key, to be stored: at most some kilobytes each."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count(value).alias("n"),
        F.sum(value).alias("total"),
        F.kll_sketch_agg_double(value, F.lit(SKETCH_K)).alias("sketch"),
    )


def quantiles_from_sketches(
    sketches: DataFrame, group: str, quantiles: dict[str, float]
) -> DataFrame:
    """Stored sketches merged per group.  The rank of each quantile is off by at most
    :data:`RANK_ERROR` of the group's values, with a probability above 99 %; a group without values
    has nulls."""
    merged = sketches.groupBy(group).agg(
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        # A key without values has an empty sketch, which is not merged.
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch")), F.lit(SKETCH_K)).alias("sketch"),
    )
    columns = {
        name: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(f)))
        for name, f in quantiles.items()
    }
    return merged.withColumns(columns).drop("sketch")
