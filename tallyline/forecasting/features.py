"""Training and scoring features.  Weekdays are 1 = Monday … 7 = Sunday on both sides."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import calendar
from tallyline.plans.serving import sales, units
from tallyline.schemas import SALE

PAIR = ["product_id", "store_id"]
CALENDAR_KEYS = [
    "day_of_week",
    "hour_of_day",
    "month",
    "is_weekend",
    "is_holiday_season",
    "is_summer",
]
HISTORY = ["avg_demand", "transaction_count"]


def _flags(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "is_weekend": calendar.flag(F.col("day_of_week") >= 6),
            "is_holiday_season": calendar.holiday_season(F.col("month")),
            "is_summer": calendar.summer(F.col("month")),
        }
    )


def training_features(events: DataFrame, history: str = "weekday") -> DataFrame:
    """One row per product, store, weekday, hour and month with its demand.

    The average and count are those of the weekday, as in scoring.  With ``history="slot"`` they are
    those of the row itself, so their product is the label.

    Events are read once: a weekday's figures are added up from its slots, 24 per month at most.
    """
    time = F.col("event_time")
    slots = (
        sales(events)
        .groupBy(
            *PAIR,
            calendar.iso_weekday(time).alias("day_of_week"),
            F.hour(time).alias("hour_of_day"),
            F.month(time).alias("month"),
        )
        .agg(
            units().alias("total_demand"),
            F.avg("quantity").alias("avg_demand"),
            F.count("*").alias("transaction_count"),
            F.count("quantity").alias("counted"),
        )
    )
    if history == "weekday":
        day = Window.partitionBy(*PAIR, "day_of_week")
        slots = slots.dropna(subset=[*PAIR, "day_of_week"]).withColumns(
            {
                "avg_demand": F.try_divide(F.sum("total_demand").over(day), F.sum("counted").over(day)),
                "transaction_count": F.sum("transaction_count").over(day),
            }
        )
    return _flags(slots.where(F.col("total_demand") > 0)).select(*PAIR, *CALENDAR_KEYS, "total_demand", *HISTORY)


def _slots(pairs: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Each row of ``pairs`` at every hour of the next days.

    A row expands into its own slots where it is: no join, and nothing is shuffled afterwards.
    """
    first = calendar.midnight(as_of)
    last = first + dt.timedelta(days=days, hours=-1)
    hours = F.sequence(calendar.instant(first), calendar.instant(last), F.expr("INTERVAL 1 HOUR"))
    slots = pairs.withColumn("slot", F.explode(hours)).withColumns(
        {
            "forecast_date": F.to_date("slot"),
            "hour_of_day": F.hour("slot"),
            "day_of_week": calendar.iso_weekday(F.col("slot")),
            "month": F.month("slot"),
        }
    )
    return _flags(slots).drop("slot")


def forecast_grid(events: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Every product and store seen before ``as_of``, at every hour of the next days."""
    grid = _slots(calendar.before(events, as_of).select(*PAIR).distinct(), as_of, days)
    return grid.select(*PAIR, "forecast_date", *CALENDAR_KEYS)


def _dates_held(events: DataFrame) -> dict[tuple[int, int], int]:
    """How many dates of each weekday and month lie between the first and the last event: at most 84
    entries, from one job of two values."""
    bounds = events.agg(F.min("event_time").alias("first"), F.max("event_time").alias("last")).first()
    if bounds.first is None:
        return {}
    first, days = bounds.first.date(), (bounds.last.date() - bounds.first.date()).days + 1
    dates = (first + dt.timedelta(days=i) for i in range(days))
    return Counter((d.isoweekday(), d.month) for d in dates)


def _past_weekdays(events: DataFrame) -> DataFrame:
    """Per product and store an array of the seven weekdays' units per sale and number of sales, null
    for a weekday without events.

    Events are grouped by weekday first, so an event adds to one weekday's figures only.
    """
    sold = F.col("transaction_type") == SALE
    days = events.groupBy(*PAIR, calendar.iso_weekday(F.col("event_time")).alias("day")).agg(
        F.avg(F.when(sold, F.col("quantity"))).alias("avg_demand"),
        F.count_if(sold).alias("transaction_count"),
    )
    # One row a weekday, so the largest is the only one.
    past = F.struct(*HISTORY)
    history = F.array(*[F.max(F.when(F.col("day") == d, past)) for d in range(1, 8)])
    return days.groupBy(*PAIR).agg(history.alias("history"))


def _weekly_history(events: DataFrame, held: dict[tuple[int, int], int]) -> DataFrame:
    """Per product and store the seven weekdays' units per sale and sales per date; 1 and 0 without any."""
    dates = [max(1, sum(n for (d, _), n in held.items() if d == day)) for day in range(1, 8)]
    past = [F.get("history", F.lit(d)) for d in range(7)]
    history = F.array(
        *[
            F.struct(
                F.coalesce(past[d]["avg_demand"], F.lit(1.0)).alias("avg_demand"),
                (F.coalesce(past[d]["transaction_count"], F.lit(0)) / dates[d]).alias("transaction_count"),
            )
            for d in range(7)
        ]
    )
    return _past_weekdays(events).withColumn("history", history)


def weekly_training_features(events: DataFrame) -> DataFrame:
    """One row per product, store, weekday, hour and month with its demand in one week.

    Units are divided by the dates of that weekday and month in the history, and slots without a sale
    count as zero, so neither label nor features grow with the length of the history.  A pair expands
    into its slots where it is, by an array of at most 84 entries; the units join by an equi-join.
    """
    held = _dates_held(events)
    time, slot = F.col("event_time"), ["day_of_week", "hour_of_day", "month"]
    spans = F.array(
        *[
            F.struct(F.lit(d).alias("day_of_week"), F.lit(m).alias("month"), F.lit(n).alias("dates"))
            for (d, m), n in sorted(held.items() or {(1, 1): 1}.items())
        ]
    )
    slots = (
        _weekly_history(events, held)
        .withColumn("span", F.explode(spans))
        .withColumn("hour_of_day", F.explode(F.sequence(F.lit(0), F.lit(23))))
        .select(*PAIR, "hour_of_day", "span.*", F.get("history", F.col("span.day_of_week") - 1).alias("past"))
    )
    sold = (
        sales(events)
        .groupBy(
            *PAIR,
            calendar.iso_weekday(time).alias("day_of_week"),
            F.hour(time).alias("hour_of_day"),
            F.month(time).alias("month"),
        )
        .agg(units().alias("units"))
    )
    demand = F.coalesce(F.col("units"), F.lit(0)) / F.col("dates")
    rows = slots.join(sold, [*PAIR, *slot], "left").withColumn("total_demand", demand)
    return _flags(rows).select(*PAIR, *CALENDAR_KEYS, "total_demand", "past.*")


def weekly_score_features(events: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """The grid with the history that :func:`weekly_training_features` takes, from before ``as_of``."""
    known = calendar.before(events, as_of)
    past = F.get("history", F.col("day_of_week") - 1).alias("past")
    slots = _slots(_weekly_history(known, _dates_held(known)), as_of, days)
    return slots.select(*PAIR, "forecast_date", *CALENDAR_KEYS, past).select(
        *PAIR, "forecast_date", *CALENDAR_KEYS, "past.*"
    )


def score_features(events: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """The grid with the sales history of its weekday before ``as_of``; without history both are 1.

    The seven weekdays travel with the pair and are looked up after the expansion, so the grid, 168
    rows per pair, is never joined.
    """
    pairs = _past_weekdays(calendar.before(events, as_of))
    past = F.get("history", F.col("day_of_week") - 1)
    return _slots(pairs, as_of, days).select(
        *PAIR,
        "forecast_date",
        *CALENDAR_KEYS,
        F.coalesce(past["avg_demand"], F.lit(1.0)).alias("avg_demand"),
        F.greatest(past["transaction_count"], F.lit(1)).alias("transaction_count"),
    )
