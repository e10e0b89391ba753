"""Features of samples, as column expressions over a series' order.

A feature is a function from a value column and the series' window to a column,
so that any set of them shares one sort. Missing values are imputed first (zero
unless told otherwise); a feature that can't be computed is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .impute import Imputer, Missing, order, resolve, zero_fill

Feature = Callable[[Column, WindowSpec], Column]


def delta_forward(y: Column, w: WindowSpec) -> Column:
    return F.lead(y).over(w) - y


def delta_backward(y: Column, w: WindowSpec) -> Column:
    return y - F.lag(y).over(w)


def delta_symmetric(y: Column, w: WindowSpec) -> Column:
    return (F.lead(y).over(w) - F.lag(y).over(w)) / 2


def acceleration(y: Column, w: WindowSpec) -> Column:
    return F.lead(y).over(w) - 2 * y + F.lag(y).over(w)


def local_mean(window_size: int = 3) -> Feature:
    half = window_size // 2
    return lambda y, w: F.avg(y).over(w.rowsBetween(-half, half))


def local_variance(window_size: int = 3) -> Feature:
    half = window_size // 2
    return lambda y, w: F.var_pop(y).over(w.rowsBetween(-half, half))


def is_local_max(y: Column, w: WindowSpec) -> Column:
    """1 where strictly above both neighbours, else 0, also at the ends."""
    return F.when((y > F.lag(y).over(w)) & (y > F.lead(y).over(w)), 1.0).otherwise(0.0)


def is_local_min(y: Column, w: WindowSpec) -> Column:
    return F.when((y < F.lag(y).over(w)) & (y < F.lead(y).over(w)), 1.0).otherwise(0.0)


def z_score(y: Column, w: WindowSpec) -> Column:
    """By the whole series; null for a single sample, 0 where there is no spread."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sd = F.stddev_pop(y).over(whole)
    return F.when(F.count(y).over(whole) < 2, None).when(sd <= 1e-10, 0.0).otherwise(F.try_divide(y - F.avg(y).over(whole), sd))


BUILTIN: dict[str, Feature] = {
    "delta_forward": delta_forward, "delta_backward": delta_backward, "delta_symmetric": delta_symmetric, "local_slope": delta_symmetric,
    "acceleration": acceleration, "local_mean": local_mean(3), "local_variance": local_variance(3),
    "is_local_max": is_local_max, "is_local_min": is_local_min, "z_score": z_score,
}


@dataclass(frozen=True)
class FeatureSet:
    """Named features and how missing values are filled for them. Immutable: each call gives a new set."""

    features: dict[str, Feature] = field(default_factory=dict)
    missing: Imputer = zero_fill

    def add_builtin(self, name: str) -> FeatureSet:
        if name not in BUILTIN:
            raise ValueError(f"no feature {name!r}; there are {', '.join(BUILTIN)}")
        return replace(self, features=self.features | {name: BUILTIN[name]})

    def add_function(self, name: str, feature: Feature) -> FeatureSet:
        """A feature of one's own, as a function of the value column and the window."""
        return replace(self, features=self.features | {name: feature})

    def with_missing_data_strategy(self, strategy: str | Imputer | Missing) -> FeatureSet:
        return replace(self, missing=resolve(strategy))

    def __len__(self) -> int:
        return len(self.features)

    def compute(self, series: DataFrame) -> DataFrame:
        """series_id, node and a nullable column for each feature, by name."""
        w = order()
        filled = series.withColumn("y", F.coalesce("value", self.missing(F.col("value"), w)))
        return filled.select("series_id", F.col("idx").alias("node"), *(self.features[k](F.col("y"), w).cast("double").alias(k) for k in sorted(self.features)))


def all_builtin() -> FeatureSet:
    out = FeatureSet()
    for name in BUILTIN:
        out = out.add_builtin(name)
    return out


def with_pandas_feature(series: DataFrame, name: str, function: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """series_id, node and a feature that only Python can say: a function of a whole series' values."""
    schema = T.StructType([series.schema["series_id"], T.StructField("node", T.LongType()), T.StructField(name, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        return pd.DataFrame({"series_id": pdf["series_id"], "node": pdf["idx"], name: function(pdf["value"]).astype(float)})

    return series.groupBy("series_id").applyInPandas(lambda pdf: run(pdf), schema)


def as_map(features: DataFrame) -> DataFrame:
    """series_id, node, features: a map without the features that are null."""
    names = [c for c in features.columns if c not in ("series_id", "node")]
    pairs: Iterable[Column] = [F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in names]
    return features.select("series_id", "node", F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())).alias("features"))
