"""Calendar demand weight, price adjustment by age and season, and thinning by weight.

All three turn a timestamp column into a factor, so they apply to any event relation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import calendar

# Demand factor of each month, January first.
MONTH_FACTORS = (0.7, 0.75, 0.9, 0.95, 1.0, 1.05, 1.1, 1.05, 1.0, 1.1, 1.5, 1.8)
# First hour, last hour and demand factor; the first range that holds the hour counts.
HOUR_FACTORS = (
    (9, 12, 1.5),
    (12, 14, 1.3),
    (17, 20, 1.7),
    (20, 22, 1.2),
    (0, 6, 0.2),
)
WEEKEND_FACTOR = 1.4
BASE_PROBABILITY = 0.3

# Price loss per 30 days of age, and the months sold at a discount.
PRICE_LOSS_PER_MONTH = 0.005
HOLIDAY_PRICE_FACTOR = 0.85
CLEARANCE_MONTHS = (1, 7)
CLEARANCE_PRICE_FACTOR = 0.90


def month_factor(time: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in MONTH_FACTORS]), F.month(time))


def hour_factor(time: Column) -> Column:
    ranges = F.when(F.lit(False), F.lit(1.0))
    for first, last, factor in HOUR_FACTORS:
        ranges = ranges.when(F.hour(time).between(first, last), F.lit(factor))
    return ranges.otherwise(F.lit(1.0))


def weekend_factor(time: Column) -> Column:
    return F.when(calendar.is_weekend(time), F.lit(WEEKEND_FACTOR)).otherwise(F.lit(1.0))


def calendar_weight(time: Column) -> Column:
    """Expected demand relative to an ordinary hour."""
    return hour_factor(time) * month_factor(time) * weekend_factor(time)


def price_adjustment(time: Column, as_of: dt.datetime) -> Column:
    """Price level at ``time`` relative to the undiscounted level at ``as_of``."""
    whole_days = F.floor((F.unix_timestamp(calendar.instant(as_of)) - F.unix_timestamp(time)) / 86400)
    by_age = 1.0 - whole_days / 30 * PRICE_LOSS_PER_MONTH
    month = F.month(time)
    discount = (
        F.when(month.isin(*calendar.HOLIDAY_MONTHS), F.lit(HOLIDAY_PRICE_FACTOR))
        .when(month.isin(*CLEARANCE_MONTHS), F.lit(CLEARANCE_PRICE_FACTOR))
        .otherwise(F.lit(1.0))
    )
    return by_age * discount


def level_prices(events: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Each price with its adjustment and the undiscounted price at ``as_of`` it stands for."""
    adjustment = price_adjustment(F.col("event_time"), as_of)
    return events.withColumn("adjustment", adjustment).withColumn(
        "level_price", F.try_divide("unit_price", "adjustment")
    )


def keep_probability(time: Column) -> Column:
    return F.lit(BASE_PROBABILITY) * calendar_weight(time)


def unit_interval_hash(key: Column) -> Column:
    """A number in [0, 1) that depends on the key only, so a re-run keeps the same rows."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32


def weighted_sample(events: DataFrame, key: str | None = None, seed: int = 42) -> DataFrame:
    """Keep each event with the probability of its hour.

    With ``key`` the draw is a hash of that column, else a seeded random number per row.
    """
    draw = F.rand(seed) if key is None else unit_interval_hash(F.col(key))
    return events.where(draw <= keep_probability(F.col("event_time")))
