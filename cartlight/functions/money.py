"""Exact money totals.

Adding doubles gives a last digit that depends on the order of the partitions, and decimal sums cost about three times
as much per row. So whole units, split into a high and a low half, and millionths are added as three bigints: all stay
in the fast aggregate map, and none can overflow at any table size that fits on a cluster. Only an amount's digits
beyond the sixth place are rounded; an amount that is not a number counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = 1e6
_PART_BITS = 21


def _finite(amount: Column) -> Column:
    """The amount as a double, NULL for NaN and infinity."""
    value = amount.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def micros(amount: Column) -> Column:
    """An amount in millionths, NULL where a bigint does not hold it."""
    return F.rint(_finite(amount) * F.lit(MICROS)).try_cast("bigint")


def micros_sum(amount: Column) -> Column:
    """Aggregate: the exact total in millionths as a decimal without fraction (NULL for no amounts)."""
    value = _finite(amount)
    whole = F.floor(value)
    high = F.shiftright(whole, _PART_BITS)
    low = whole.bitwiseAND(F.lit((1 << _PART_BITS) - 1).cast("bigint"))
    small = F.rint((value - whole.cast("double")) * F.lit(MICROS)).cast("bigint")
    units = F.sum(high).cast("decimal(20,0)") * F.lit(1 << _PART_BITS) + F.sum(low)
    return units.cast("decimal(30,0)") * F.lit(int(MICROS)) + F.sum(small)


def money(total: Column) -> Column:
    """A total in millionths as the nearest double."""
    return (total.cast("decimal(32,0)") * F.expr("cast(0.000001 as decimal(6,6))")).cast("double")


def money_sum(amount: Column) -> Column:
    """Aggregate: the exact total as a double."""
    return money(micros_sum(amount))


def average(total: Column, count: Column) -> Column:
    return F.try_divide(total, count)


def money_text(amount: Column) -> Column:
    """An amount as text with two decimals, for display."""
    return F.format_string("%.2f", amount)


def micros_key(total: Column) -> Column:
    """A total in millionths as a bigint for ranking; totals beyond bigint sort as the largest value."""
    largest = F.lit(9223372036854775807)
    return F.coalesce(total.try_cast("bigint"), F.when(total.isNotNull(), largest))
