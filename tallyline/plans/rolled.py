"""Standing reports answered from stored rollups and the events that came after them.

A report follows from a rollup if its keys are keys of the rollup or made of one of them, the rollup
holds its kinds of event, and its range begins and ends on the rollup's grain (:func:`source_of`).
Its figures are then the rollup's partial sums, added to the partial sums of the events from the time
on up to which the rollup was loaded: of the event table only that tail is read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import calendar, money
from tallyline.operators import distinct
from tallyline.operators.rollup import DAILY, ROLLUPS, Rollup, average_price, merge, partials
from tallyline.schemas import SALE
from tallyline.sources import storage
from tallyline.streaming import rollups as store

#: Keys made of a stored key, and the length of time that a stored key stands for.
MADE_OF = {
    "hour": {
        "date": lambda: F.to_date("hour"),
        "hour_of_day": lambda: F.hour("hour"),
        "weekday": lambda: calendar.iso_weekday(F.col("hour")),
    },
    "date": {"weekday": lambda: calendar.iso_weekday(F.col("date"))},
}
#: Columns of which the overview counts the different values.
COUNTED = {"product_id": "unique_products", "store_id": "unique_stores"}
GRAIN = {"hour": dt.timedelta(hours=1), "date": dt.timedelta(days=1)}


def _made(rollup: Rollup, key: str) -> list:
    return [MADE_OF[k][key] for k in rollup.keys if key in MADE_OF.get(k, {})]


def _key(rollup: Rollup, key: str) -> Column:
    return F.col(key) if key in rollup.keys else _made(rollup, key)[0]()


def _on_grain(at: dt.datetime, grain: dt.timedelta) -> bool:
    return (at - dt.datetime(1970, 1, 1)) % grain == dt.timedelta(0)


def follows(
    rollup: Rollup, keys: Sequence[str], kind: str | None, start: dt.datetime | None, end: dt.datetime | None
) -> bool:
    """Whether a report with these keys, of one kind of event (none: all) and range, follows from it."""
    if any(k not in rollup.keys and not _made(rollup, k) for k in keys):
        return False
    if rollup.sales_only and kind != SALE:
        return False
    if not rollup.sales_only and kind is not None and "transaction_type" not in rollup.keys:
        return False
    bounds = [b for b in (start, end) if b is not None]
    grains = [GRAIN[k] for k in rollup.keys if k in GRAIN]
    return not bounds or bool(grains) and all(_on_grain(b, grains[0]) for b in bounds)


def source_of(
    keys: Sequence[str], kind: str | None = SALE, start: dt.datetime | None = None, end: dt.datetime | None = None,
    stored: Sequence[Rollup] = ROLLUPS,
) -> Rollup | None:
    """The rollup, of those stored, that the report follows from; the coarsest if there are several."""
    fit = [r for r in stored if follows(r, keys, kind, start, end)]
    return min(fit, key=lambda r: ("hour" in r.keys, len(r.keys))) if fit else None


def _range(rows: DataFrame, rollup: Rollup, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    for key, bound in (("date", calendar.day), ("hour", calendar.instant)):
        if key in rollup.keys:
            rows = rows.where(F.col(key) >= bound(start)) if start else rows
            rows = rows.where(F.col(key) < bound(end)) if end else rows
    return rows


def figures(
    spark: SparkSession, root: str, events: DataFrame, keys: Sequence[str], kind: str | None = SALE,
    start: dt.datetime | None = None, end: dt.datetime | None = None,
) -> DataFrame:
    """Partial sums per key from a rollup that lies below ``root`` and the tail of ``events``."""
    names = storage.child_directories(spark, root)
    rollup = source_of(keys, kind, start, end, [r for r in ROLLUPS if r.name in names])
    if rollup is None:
        raise ValueError(f"no stored rollup answers for {list(keys)} of {kind or 'all kinds'} in this range")
    until = store.loaded_until(spark, root, rollup)
    rows = store.stored_partials(spark, root, rollup)
    if until is not None:
        rows = rows.unionByName(partials(calendar.since(events, until), rollup))
    rows = _range(rows, rollup, start, end)
    if kind is not None and "transaction_type" in rollup.keys:
        rows = rows.where(F.col("transaction_type") == kind)
    return merge(rows.withColumns({k: _key(rollup, k) for k in keys}), list(keys))


def _sums() -> list[Column]:
    return [F.col("transaction_count"), F.col("total_quantity"), money.amount("revenue").alias("total_revenue")]


def sales_by_category(spark: SparkSession, root: str, events: DataFrame) -> DataFrame:
    keys = ["category", "transaction_type"]
    rows = figures(spark, root, events, keys)
    return rows.select(*keys, *_sums(), average_price().alias("avg_unit_price"))


def sales_by_store(spark: SparkSession, root: str, events: DataFrame) -> DataFrame:
    return figures(spark, root, events, ["store_id"]).select("store_id", *_sums())


def hourly_sales_trend(spark: SparkSession, root: str, events: DataFrame) -> DataFrame:
    return figures(spark, root, events, ["hour"]).select("hour", *_sums()).orderBy(F.desc("hour"))


def product_performance(spark: SparkSession, root: str, events: DataFrame) -> DataFrame:
    keys = ["product_id", "category"]
    rows = figures(spark, root, events, keys).select(*keys, *_sums(), average_price().alias("avg_unit_price"))
    return rows.orderBy(F.desc("total_revenue"), *keys)


def daily_sales(
    spark: SparkSession, root: str, events: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> DataFrame:
    """Sales per date and store inside a range of whole days."""
    return figures(spark, root, events, ["date", "store_id"], start=start, end=end).select("date", "store_id", *_sums())


def home_kpis(spark: SparkSession, root: str, events: DataFrame) -> DataFrame:
    """Transactions, revenue, distinct products and stores of all sales, without the events that the
    rollups hold: sums from the daily rollup, distinct counts from its bitmaps."""
    until = store.loaded_until(spark, root, DAILY)
    tail = None if until is None else calendar.since(events, until).where(F.col("transaction_type") == SALE)
    rows = figures(spark, root, events, []).select(
        F.coalesce("transaction_count", F.lit(0)).alias("total_transactions"), money.amount("revenue").alias("total_revenue")
    )
    for column, name in COUNTED.items():
        counted = distinct.distinct_count(spark, f"{root}/distinct", column, tail)
        rows = rows.unionByName(counted.withColumnRenamed("n", name), allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def load_overview(events: DataFrame, root: str, until: dt.datetime) -> None:
    """What :func:`home_kpis` reads: the daily rollup and the bitmaps of the sales before ``until``."""
    sales = calendar.before(events, until).where(F.col("transaction_type") == SALE)
    for column in COUNTED:
        distinct.store_days(sales, f"{root}/distinct", column)
    store.load_rollup(events, root, DAILY, until)
