"""Money expressions on exact decimals, rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def line_amount(qty: Column, price: Column) -> Column:
    return F.round(qty * price, 2).cast(MONEY)


def percent_of(amount: Column, percent: Column) -> Column:
    """amount * percent / 100, by a decimal factor: no division of money."""
    return F.round(amount * percent.cast("decimal(9,2)") * F.lit("0.01").cast("decimal(4,2)"), 2).cast(MONEY)


def margin_state(price: Column, cost: Column, known: Column) -> Column:
    return F.when(~known, "not_in_master").when(cost.isNull() | (cost <= 0), "no_cost").when(price > 0, "ok").otherwise("no_price")


def tier_price(base: Column, percent: Column, places: int = 2) -> Column:
    """Price after a discount on the snapshot base; unpriced stays unpriced."""
    factor = (F.lit(100).cast("decimal(9,2)") - percent.cast("decimal(9,2)")) * F.lit("0.01").cast("decimal(4,2)")
    return F.when(base > 0, F.round(base * factor, places).cast(MONEY)).otherwise(base)
