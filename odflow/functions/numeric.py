"""Guarded arithmetic: an undefined score is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flows smaller than this count as zero.
ZERO_FLOW = 1e-6
# Spread below which a correlation is undefined, and floor of a divergence ratio.
TINY = 1e-12


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom where bottom is positive, else NULL."""
    return F.when(bottom > 0, F.try_divide(top, bottom))


def number_or_zero(value: Column) -> Column:
    """Text or number to double; unparseable, NULL and NaN become 0."""
    parsed = value.try_cast("double")
    return F.coalesce(F.nanvl(parsed, F.lit(0.0)), F.lit(0.0))


def flush_tiny(value: Column) -> Column:
    return F.when(F.abs(value) < ZERO_FLOW, F.lit(0.0)).otherwise(value)


def dice(common: Column, left: Column, right: Column) -> Column:
    """2·common / (left + right), NULL when the total is not positive."""
    return ratio(2.0 * common, left + right)


def correlation(covariance: Column, spread_x: Column, spread_y: Column, count: Column) -> Column:
    """Pearson r from population moments, NULL for a constant side or fewer than two points."""
    usable = (count >= 2) & (spread_x >= TINY) & (spread_y >= TINY)
    return F.when(usable, F.try_divide(covariance, spread_x * spread_y))
