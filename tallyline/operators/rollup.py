"""Rollups kept as partial aggregates that can be added up in any order.

A partial row holds sums and counts only, never an average, so partials of different batches merge
by summing, late rows included.  Averages are derived on read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import calendar, money
from tallyline.functions.ratios import is_type
from tallyline.schemas import SALE

PARTIAL_SUMS = (
    "transaction_count",
    "total_quantity",
    *(f"{amount}_{part}" for amount in ("revenue", "price") for part in money.PARTIAL_PARTS),
    "price_count",
)


@dataclass(frozen=True)
class Rollup:
    name: str
    keys: dict[str, Callable[[], Column]]
    sales_only: bool = True
    average_price: bool = False

    @property
    def key_names(self) -> list[str]:
        return list(self.keys)


DAILY = Rollup(
    "daily",
    {
        "date": lambda: F.to_date("event_time"),
        "store_id": lambda: F.col("store_id"),
        "category": lambda: F.col("category"),
        "transaction_type": lambda: F.col("transaction_type"),
    },
)
HOURLY = Rollup(
    "hourly",
    {
        "hour": lambda: calendar.hour_bucket(F.col("event_time")),
        "store_id": lambda: F.col("store_id"),
        "category": lambda: F.col("category"),
    },
)
PRODUCT = Rollup(
    "product",
    {
        "product_id": lambda: F.col("product_id"),
        "category": lambda: F.col("category"),
        "transaction_type": lambda: F.col("transaction_type"),
    },
    sales_only=False,
    average_price=True,
)
ROLLUPS = (DAILY, HOURLY, PRODUCT)


def partials(events: DataFrame, rollup: Rollup) -> DataFrame:
    """One partial row per key of this set of events."""
    if rollup.sales_only:
        events = events.where(is_type(SALE))
    price, quantity = "unit_price", "quantity"
    return events.groupBy(*[key().alias(name) for name, key in rollup.keys.items()]).agg(
        F.count("*").alias("transaction_count"),
        F.sum(quantity).alias("total_quantity"),
        *money.partial_sums("revenue", price, quantity),
        *money.partial_sums("price", price),
        F.count(price).alias("price_count"),
    )


def merge(partial_rows: DataFrame, keys: Rollup | Sequence[str]) -> DataFrame:
    """Partials of any number of batches → one partial row per key."""
    names = keys.key_names if isinstance(keys, Rollup) else keys
    return partial_rows.groupBy(*names).agg(*[F.sum(name).alias(name) for name in PARTIAL_SUMS])


def finish(merged: DataFrame, rollup: Rollup) -> DataFrame:
    """Merged partials → the measures a reader sees."""
    measures = [
        F.col("transaction_count"),
        F.col("total_quantity"),
        money.amount("revenue").alias("total_revenue"),
    ]
    if rollup.average_price:
        measures.append(average_price().alias("avg_unit_price"))
    return merged.select(*rollup.key_names, *measures)


def average_price() -> Column:
    return F.try_divide(money.amount("price"), F.col("price_count"))


def summarise(events: DataFrame, rollup: Rollup) -> DataFrame:
    """The rollup straight from events, as a batch query."""
    return finish(partials(events, rollup), rollup)
