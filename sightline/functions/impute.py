"""Imputation of missing values, as column expressions over a series' order.

Strategies look at the original values only; an imputed value is never fed to
another. All of them share one window order, so a plan sorts a series once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..errors import ImputationError

#: From the value column and the series' window to a value for each row.
Imputer = Callable[[Column, WindowSpec], Column]


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _after(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(1, Window.unboundedFollowing)


def linear_interpolation(v: Column, w: WindowSpec) -> Column:
    """Midpoint of the last valid value before and the first after; null at the ends."""
    return (F.last(v, True).over(_before(w)) + F.first(v, True).over(_after(w))) / 2


def forward_fill(v: Column, w: WindowSpec) -> Column:
    return F.last(v, True).over(_before(w))


def backward_fill(v: Column, w: WindowSpec) -> Column:
    return F.first(v, True).over(_after(w))


def nearest_neighbor(v: Column, w: WindowSpec) -> Column:
    """The closer of the valid values on either side; the earlier of two as close."""
    at = F.when(v.isNotNull(), F.struct(F.col("idx"), v.alias("v")))
    prev, post = F.last(at, True).over(_before(w)), F.first(at, True).over(_after(w))
    near = (F.col("idx") - prev["idx"]) <= (post["idx"] - F.col("idx"))
    return F.when(prev.isNull(), post["v"]).when(post.isNull() | near, prev["v"]).otherwise(post["v"])


def mean_imputation(window_size: int) -> Imputer:
    """Mean of the valid values within half a window on each side."""
    half = window_size // 2
    return lambda v, w: F.avg(v).over(w.rowsBetween(-half, half))


def median_imputation(window_size: int) -> Imputer:
    half = window_size // 2

    def impute(v: Column, w: WindowSpec) -> Column:
        near = F.array_sort(F.collect_list(v).over(w.rowsBetween(-half, half)))
        n = F.size(near)
        return F.when(n > 0, (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2)

    return impute


def zero_fill(v: Column, w: WindowSpec) -> Column:
    return F.lit(0.0)


def drop(v: Column, w: WindowSpec) -> Column:
    """No value: the sample stays missing, which ``impute`` reports."""
    return F.lit(None).cast("double")


def fallback(*strategies: Imputer) -> Imputer:
    """The first strategy that has a value."""
    return lambda v, w: F.coalesce(*(s(v, w) for s in strategies))


STRATEGIES: dict[str, Imputer] = {
    "linear": linear_interpolation, "ffill": forward_fill, "bfill": backward_fill, "nearest": nearest_neighbor,
    "mean3": mean_imputation(3), "median5": median_imputation(5), "zero": zero_fill, "drop": drop,
}


@dataclass(frozen=True)
class Missing:
    """A strategy that can be chained: ``Missing("linear").with_fallback("ffill")``."""

    strategy: str | Imputer

    def column(self, v: Column, w: WindowSpec) -> Column:
        return resolve(self.strategy)(v, w)

    def with_fallback(self, other: str | Imputer | Missing) -> Missing:
        return Missing(fallback(resolve(self.strategy), resolve(other)))


def resolve(strategy: str | Imputer | Missing) -> Imputer:
    if isinstance(strategy, Missing):
        return resolve(strategy.strategy)
    if callable(strategy):
        return strategy
    if strategy not in STRATEGIES:
        raise ImputationError(f"no strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy]


def order() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("idx")


def impute(series: DataFrame, strategy: str | Imputer | Missing, strict: bool = True) -> DataFrame:
    """``series`` with its missing values filled; where the strategy has none, the
    query fails (``strict``) or the value stays null."""
    filled = F.coalesce(F.col("value"), resolve(strategy)(F.col("value"), order()))
    out = series.withColumn("value", filled)
    if not strict:
        return out
    message = F.concat(F.lit("no strategy gives a value in series "), F.col("series_id").cast("string"), F.lit(" at "), F.col("idx").cast("string"))
    return out.withColumn("value", F.when(F.col("value").isNull(), F.raise_error(message).cast("double")).otherwise(F.col("value")))
