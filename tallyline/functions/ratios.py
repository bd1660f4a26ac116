"""Ratios with the zero rules the reports need; none of them throws under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, null where ``whole`` is zero."""
    return F.try_divide(part, whole)


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def growth_percent(current: Column, previous: Column) -> Column:
    """Change against the previous period; from zero it is 0 (still zero) or 100."""
    from_zero = F.when(current == 0, 0.0).otherwise(100.0)
    change = F.try_divide(current - previous, previous) * 100
    return F.when(previous == 0, from_zero).otherwise(change)


def is_type(kind: str) -> Column:
    return F.col("transaction_type") == kind
