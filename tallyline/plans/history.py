"""Reports over weeks and months of the unified relation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import calendar, money, text
from tallyline.functions.ratios import growth_percent, is_type, percent
from tallyline.plans.serving import basket_value, return_counts, revenue, sales, units
from tallyline.schemas import RESTOCK, RETURN, SALE


#: Ranges of revenue in which stores are ranked side by side.
RANK_RANGES = 100


def _daily_sales(unified: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    return (
        sales(calendar.last_days(unified, as_of, days))
        .groupBy(F.to_date("event_time").alias("date"))
        .agg(
            revenue().alias("revenue"),
            F.count("*").alias("transactions"),
            units().alias("items_sold"),
        )
    )


def daily_sales_trend(unified: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    return _daily_sales(unified, as_of, days).orderBy("date")


def daily_sales_summary_stats(unified: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    return _daily_sales(unified, as_of, days).agg(
        money.money_sum("revenue").alias("total_revenue"),
        money.money_avg("revenue").alias("avg_daily_revenue"),
        F.sum("transactions").alias("total_transactions"),
        F.sum("items_sold").alias("total_items"),
    )


def peak_hours_heatmap(unified: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    time = F.col("event_time")
    return (
        sales(calendar.last_days(unified, as_of, days))
        .groupBy(calendar.iso_weekday(time).alias("day_of_week"), F.hour(time).alias("hour"))
        .agg(F.count("*").alias("transaction_count"))
        .withColumn("day_name", calendar.day_name(F.col("day_of_week")))
        .orderBy("day_of_week", "hour")
    )


def peak_hours_matrix(unified: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """One row per weekday, one column ``h0`` … ``h23`` per hour; null where nothing was sold.

    The hours are given, so one grouping by weekday counts them all.
    """
    time = F.col("event_time")
    counts = [F.nullif(F.count_if(F.hour(time) == h), F.lit(0)).alias(f"h{h}") for h in range(24)]
    return (
        sales(calendar.last_days(unified, as_of, days))
        .groupBy(calendar.iso_weekday(time).alias("day_of_week"))
        .agg(*counts)
        .select("day_of_week", calendar.day_name(F.col("day_of_week")).alias("day_name"), *[f"h{h}" for h in range(24)])
        .orderBy("day_of_week")
    )


def peak_hour(unified: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """The busiest weekday and hour, the earliest one on a tie."""
    return (
        peak_hours_heatmap(unified, as_of, days)
        .orderBy(F.desc("transaction_count"), "day_of_week", "hour")
        .limit(1)
    )


def store_performance(
    unified: DataFrame, as_of: dt.datetime, days: int = 30, top: int = 15
) -> DataFrame:
    """Per store; a store with returns but no sales has no rate, one with neither has 0."""
    sold, returned = F.col("sales_count"), F.col("return_count")
    rate = F.when((sold == 0) & (returned == 0), 0.0).otherwise(percent(returned, sold))
    return (
        calendar.last_days(unified, as_of, days)
        .groupBy("store_id")
        .agg(
            revenue(SALE).alias("total_revenue"),
            F.count_if(is_type(SALE)).alias("sales_count"),
            F.count_if(is_type(RETURN)).alias("return_count"),
        )
        .orderBy(F.desc("total_revenue"), "store_id")
        .limit(top)
        .withColumn("return_rate", rate)
    )


def return_rate_top(
    unified: DataFrame, as_of: dt.datetime, days: int = 30, top: int = 20, more_than: int = 5
) -> DataFrame:
    return (
        return_counts(calendar.last_days(unified, as_of, days), "category", "product_id")
        .where(F.col("sales_count") > more_than)
        .select("category", "product_id", "sales_count", "return_count", "return_rate_pct")
        .orderBy(F.desc("return_rate_pct"), "category", "product_id")
        .limit(top)
    )


def category_performance(unified: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Per category with its share of all revenue; the total is taken over the category rows."""
    everything = Window.partitionBy()
    return (
        sales(calendar.last_days(unified, as_of, days))
        .groupBy("category")
        .agg(
            F.count("*").alias("total_transactions"),
            revenue().alias("total_revenue"),
            basket_value().alias("avg_transaction_value"),
            units().alias("total_items"),
        )
        .withColumn(
            "revenue_share",
            percent(F.col("total_revenue"), F.sum("total_revenue").over(everything)),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def growth_rate(unified: DataFrame) -> DataFrame:
    """Month-over-month revenue growth; the window sees one row per month."""
    monthly = (
        sales(unified)
        .groupBy(calendar.month_number(F.col("event_time")).alias("month"))
        .agg(revenue().alias("revenue"))
    )
    previous = F.lag("revenue").over(Window.orderBy("month"))
    return (
        monthly.withColumn("previous_revenue", previous)
        .withColumn("growth_pct", growth_percent(F.col("revenue"), F.col("previous_revenue")))
        .orderBy("month")
    )


def store_leaderboard(unified: DataFrame) -> DataFrame:
    """Stores ranked by revenue, those without a revenue last.

    Approximate percentiles cut the stores into ranges of revenue, which only decide what is ranked
    where: a rank is the exact number of stores in higher ranges and the rank within the range.
    """
    by_store = sales(unified).groupBy("store_id").agg(revenue().alias("revenue"))
    shares = [i / RANK_RANGES for i in range(1, RANK_RANGES)]
    cuts = by_store.agg(F.percentile_approx("revenue", shares, 10_000).alias("cuts")).scalar()
    above = F.size(F.filter("cuts", lambda cut: cut > F.col("revenue")))
    ranged = by_store.withColumn("cuts", cuts).select(
        "store_id", "revenue", F.when(F.col("revenue").isNull(), RANK_RANGES).otherwise(above).alias("range")
    )
    higher = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        ranged.groupBy("range")
        .agg(F.count("*").alias("stores"))
        .select("range", F.coalesce(F.sum("stores").over(higher), F.lit(0)).alias("ahead"))
    )
    inside = F.rank().over(Window.partitionBy("range").orderBy(F.desc("revenue")))
    return (
        ranged.withColumn("inside", inside)
        .join(ahead, "range")
        .select("store_id", "revenue", (F.col("ahead") + F.col("inside")).cast("int").alias("revenue_rank"))
        .orderBy("revenue_rank", "store_id")
    )


def revenue_metrics(rows: DataFrame, revenue_column: str = "total_revenue") -> DataFrame:
    """Total, mean, largest and smallest of a revenue column; zeros when there is no row."""
    value = F.col(revenue_column)
    measures = {
        "total_revenue": money.money_sum(revenue_column),
        "avg_revenue": money.money_avg(revenue_column),
        "max_revenue": F.max(value),
        "min_revenue": F.min(value),
    }
    return rows.agg(*[F.coalesce(m, F.lit(0.0)).alias(name) for name, m in measures.items()])


def performance_metrics(events: DataFrame) -> DataFrame:
    """Row count with the distinct products and stores, from one row per product and store."""
    pairs = events.groupBy("product_id", "store_id").agg(F.count("*").alias("n"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_transactions"),
        F.countDistinct("product_id").alias("unique_products"),
        F.countDistinct("store_id").alias("unique_stores"),
    )


def category_cards(unified: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """The category report as display text."""
    report = category_performance(unified, as_of, days)
    return report.select(
        "category",
        text.currency_text(F.col("total_revenue")).alias("revenue_text"),
        text.currency_text(F.col("avg_transaction_value")).alias("avg_value_text"),
        text.number_text(F.col("total_items"), 1).alias("items_text"),
        text.percentage_text(F.col("revenue_share")).alias("share_text"),
    )


def product_history(
    unified: DataFrame, product: str, as_of: dt.datetime, store: int | None = None, days: int | None = None
) -> DataFrame:
    """What happened to one product, per date and store: sales, returns, restocks and net movement of stock.

    A lookup: product and store are compared as they are stored, so that a table clustered by product is
    read at the product's row groups only.
    """
    rows = calendar.before(unified, as_of) if days is None else calendar.last_days(unified, as_of, days)
    rows = rows.where(F.col("product_id") == product)
    if store is not None:
        rows = rows.where(F.col("store_id") == store)
    moved = lambda kind: F.sum(F.when(is_type(kind), F.col("quantity")).otherwise(0))
    found = rows.groupBy(F.to_date("event_time").alias("date"), "store_id").agg(
        F.count("*").alias("events"),
        moved(SALE).alias("units_sold"),
        moved(RETURN).alias("units_returned"),
        moved(RESTOCK).alias("units_restocked"),
        revenue(SALE).alias("revenue"),
    )
    net = F.col("units_restocked") + F.col("units_returned") - F.col("units_sold")
    return found.withColumn("net_units", net).orderBy("date", "store_id")
