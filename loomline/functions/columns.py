"""Column expressions used across operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL for NaN and infinities: a missing value has one form everywhere."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with NULL for a zero or missing denominator."""
    return F.try_divide(num, den)


def clip(c: Column, lo: float, hi: float) -> Column:
    """``c`` limited to ``[lo, hi]``, NULL kept."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sample_skew(g1: Column, n: Column) -> Column:
    """Sample-corrected skewness from the population skewness; NULL below three rows."""
    n = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Sample-corrected excess kurtosis from the population excess; NULL below four rows."""
    n = n.cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def serial_id(prefix: str, number: Column, width: int = 3) -> Column:
    """Zero-padded id such as ``T007``; numbers wider than ``width`` are kept whole."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))


def softmax(c: Column, *keys: str) -> Column:
    """Share of each value's exponential in its group, by differences from the largest value."""
    group = Window.partitionBy(*keys)
    power = F.exp(c - F.max(c).over(group))
    return power / F.sum(power).over(group)


def slug(c: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def truthy(c: Column) -> Column:
    """Boolean from registry text: ``true``, ``1``, ``yes``, ``y`` in any case."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y")


def safe_divisor(sd: Column) -> Column:
    """A usable scale: the value when positive and finite, else 1."""
    return F.when(finite(sd) > 0, sd).otherwise(F.lit(1.0))
