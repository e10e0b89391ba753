"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    """0 for an empty vector."""
    return F.when(F.size(a) > 0, F.try_divide(total(a), F.size(a))).otherwise(0.0)


def variance(a: Column) -> Column:
    """Population variance; 0 for fewer than two values."""
    return F.when(F.size(a) < 2, 0.0).otherwise(F.aggregate(F.transform(a, lambda x: F.pow(x.cast("double") - mean(a), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))
