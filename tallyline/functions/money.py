"""Sums of money that do not depend on the order in which rows arrive.

A sum of doubles changes in its last digits with every shuffle.  Here each amount is split into
whole cents, summed as BIGINT inside the generated code, and what is left below a cent, summed as
DOUBLE.  For prices in whole cents the second part is exactly zero, so totals are exact; finer
prices still count in full.

Columns and conditions are given as SQL text, so that each sum is one expression to parse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Larger values (and NaN) go to the DOUBLE part: cents times an INT quantity must fit a BIGINT,
# and cents of an amount that is not multiplied must be exact in a DOUBLE.
PRICE_LIMIT = 1e7
AMOUNT_LIMIT = 1e13
BILLION = 1_000_000_000


def _parts(value: str, quantity: str | None, where: str | None) -> tuple[str, str]:
    """SQL of the cents and of the rest of one row; rows outside ``where`` are 0."""
    limit = AMOUNT_LIMIT if quantity is None else PRICE_LIMIT
    cents = f"if(abs({value}) <= {limit!r}D, floor({value} * 100 + 0.5D), 0L)"
    rest = f"({value} - {cents} / 100)"
    if quantity is not None:
        cents, rest = f"{quantity} * {cents}", f"{quantity} * {rest}"
    if where is not None:
        cents, rest = f"if({where}, {cents}, 0L)", f"if({where}, {rest}, 0D)"
    return cents, rest


#: What the columns of :func:`partial_sums` end in.
PARTIAL_PARTS = ("billions", "cents", "rest")


def partial_sums(prefix: str, value: str, quantity: str | None = None) -> list[Column]:
    """The three sums that make up an amount, each of which may be summed again.

    Cents are summed in two BIGINTs, of billions and of what is left, which billions of rows with
    the largest prices and quantities do not fill.
    """
    cents, rest = _parts(value, quantity, None)
    sums = (f"sum(({cents}) div {BILLION}L)", f"sum(({cents}) % {BILLION}L)", f"sum({rest})")
    return [F.expr(s).alias(f"{prefix}_{part}") for s, part in zip(sums, PARTIAL_PARTS)]


def _total(billions: str, cents: str, rest: str) -> str:
    whole = f"CAST(CAST({billions} AS DECIMAL(20, 0)) * {BILLION}L + {cents} AS DOUBLE)"
    return f"({whole} / 100 + {rest})"


def amount(prefix: str, summed: bool = False) -> Column:
    """The DOUBLE value of the columns of :func:`partial_sums`, or of their sums over a group."""
    parts = [f"{prefix}_{part}" for part in PARTIAL_PARTS]
    return F.expr(_total(*(f"sum({p})" if summed else p for p in parts)))


def _sum(value: str, quantity: str | None, where: str | None) -> str:
    cents, rest = _parts(value, quantity, where)
    return _total(f"sum(({cents}) div {BILLION}L)", f"sum(({cents}) % {BILLION}L)", f"sum({rest})")


def money_sum(value: str, quantity: str | None = None, where: str | None = None) -> Column:
    """``sum(quantity * value)``; rows outside ``where`` count as 0."""
    return F.expr(_sum(value, quantity, where))


def money_avg(value: str, quantity: str | None = None, where: str | None = None) -> Column:
    """``avg(quantity * value)``; rows outside ``where`` count as 0 and stay in the divisor."""
    counted = value if quantity is None else f"{quantity} * {value}"
    if where is not None:
        counted = f"if({where}, {counted}, 0D)"
    return F.expr(f"try_divide({_sum(value, quantity, where)}, count({counted}))")
