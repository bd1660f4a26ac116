"""Compact display text for amounts, counts and percentages, as column expressions.

``format_number`` with a pattern rounds the exact binary value half-even, which is also what a
fixed-point format of a double means elsewhere; ``format_string`` would round the shortest decimal
text half-up and differ on values such as 1.115.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.schemas import SALE

# Suffix and size of the unit it stands for, largest first.
MONEY_UNITS = (("M", 1e6), ("K", 1e3))
COUNT_UNITS = (("B", 1e9), ("M", 1e6), ("K", 1e3))


def fixed_point(value: Column, decimals: int) -> Column:
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def _with_unit(value: Column, units, decimals: int) -> Column:
    shown = fixed_point(value, decimals)
    for suffix, size in reversed(units):
        scaled = F.concat(fixed_point(value / size, decimals), F.lit(suffix))
        shown = F.when(F.abs(value) >= size, scaled).otherwise(shown)
    return shown


def currency_text(value: Column, currency: str = "$") -> Column:
    """1234.5 → ``$1.23K``; null → ``$0``."""
    missing = value.isNull() | F.isnan(value.cast("double"))
    text = F.concat(F.lit(currency), _with_unit(value, MONEY_UNITS, 2))
    return F.when(missing, F.lit(f"{currency}0")).otherwise(text)


def number_text(value: Column, decimals: int = 0) -> Column:
    """1234567 → ``1M``; null → ``0``."""
    missing = value.isNull() | F.isnan(value.cast("double"))
    return F.when(missing, F.lit("0")).otherwise(_with_unit(value, COUNT_UNITS, decimals))


def percentage_text(value: Column, decimals: int = 1, ratio_below_one: bool = True) -> Column:
    """12.34 → ``12.3%``; null → ``0%``.

    With ``ratio_below_one`` a value within [-1, 1] is taken for a ratio and shown times 100.
    """
    missing = value.isNull() | F.isnan(value.cast("double"))
    shown = F.when(F.abs(value) <= 1, value * 100).otherwise(value) if ratio_below_one else value
    text = F.concat(fixed_point(shown, decimals), F.lit("%"))
    return F.when(missing, F.lit("0%")).otherwise(text)


def type_label(kind: Column) -> Column:
    """The transaction type with the mark shown beside it in the live event list."""
    mark = F.when(kind == SALE, F.lit("🛒 ")).otherwise(F.lit("↩️ "))
    return F.concat(mark, kind)
