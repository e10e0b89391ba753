"""Sliding windows over series, and splits of them for training."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SeriesError
from ..scratch import stored
from .running import numbered, running

#: Fixed value: the multiplier that orders series in a split by series.
SPLIT_MULTIPLIER = 2654435761


def sliding(series: DataFrame, size: int, stride: int) -> DataFrame:
    """window_no, series_id, series_no, window_start, window (one feature of ``size`` steps).

    Missing values leave a window and zeros fill it up on the right. Series shorter than a window give none.
    window_no counts within the frame's series, in their order: it needs the number of windows
    of each series only, summed over ranges of series (``running``).
    """
    if size < 1 or stride < 1:
        raise SeriesError("size and stride are 1 at least")
    w = Window.partitionBy("series_id").orderBy("idx")
    near = F.collect_list("value").over(w.rowsBetween(0, size - 1))
    n = F.count("*").over(Window.partitionBy("series_id"))
    rows = series.select("series_id", "idx", near.alias("near"), n.alias("n")).filter((F.col("idx") % stride == 0) & (F.col("idx") + size <= F.col("n")))
    # One row for each series: the place of its first window among all.
    counts = series.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("k", F.greatest(F.floor((F.col("n") - size) / stride) + 1, F.lit(0)))
    counts = running(stored(counts.select("series_id", "k"), "counts"), ["series_id"], {"series_no": F.lit(1), "first": F.col("k")})
    padded = F.concat("near", F.array_repeat(F.lit(0.0), size - F.size("near")))
    return rows.join(counts.drop("k"), "series_id").select((F.col("first") + F.col("idx") / stride).cast("long").alias("window_no"), "series_id", "series_no", F.col("idx").alias("window_start"), F.array(padded).alias("window"))


def with_labels(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels``: window_no, label."""
    return windows.join(labels, "window_no", "left")


def get_window(windows: DataFrame, window_no: int) -> DataFrame:
    return windows.filter(F.col("window_no") == window_no)


def extract_windows(windows: DataFrame, numbers: Iterable[int] | DataFrame) -> DataFrame:
    if isinstance(numbers, DataFrame):
        return windows.join(numbers.select("window_no"), "window_no", "left_semi")
    return windows.filter(F.col("window_no").isin(list(numbers)))


def _cut(at: Column, train: Column, val: Column) -> Column:
    return F.when(at < train, "train").when(at < train + val, "val").otherwise("test")


def _part(total: Column, share: float) -> Column:
    """Floor of a share of ``total``; the share is the decimal that it is written as, so 0.7 of 90 is 63."""
    return F.floor(total.cast("decimal(18,0)") * F.lit(Decimal(repr(float(share))).quantize(Decimal("1e-17")))).cast("long")


def _total(windows: DataFrame) -> Column:
    """Number of windows, as a scalar subquery."""
    return windows.agg(F.count("*").alias("total")).scalar()


def split_by_time(windows: DataFrame, train: float, val: float) -> DataFrame:
    """By place among all windows: floor of the shares, the rest for test."""
    both = windows.withColumn("total", _total(windows))
    return both.withColumn("split", _cut(F.col("window_no"), _part(F.col("total"), train), _part(F.col("total"), val))).drop("total")


def split_by_series(windows: DataFrame, train: float, val: float) -> DataFrame:
    """Whole series, in the order of a multiplicative hash of series_no."""
    key = F.pmod(F.col("series_no").cast("decimal(20,0)") * F.lit(SPLIT_MULTIPLIER).cast("decimal(12,0)"), F.lit(1 << 32).cast("decimal(12,0)")).cast("long")
    series = windows.select("series_no").distinct().withColumn("h", key)
    ranked = numbered(series, ["h", "series_no"], "rank").withColumn("total", series.agg(F.count("*").alias("total")).scalar())
    split = _cut(F.col("rank"), _part(F.col("total"), train), _part(F.col("total"), val))
    return windows.join(ranked.select("series_no", split.alias("split")), "series_no")


def split_rolling(windows: DataFrame, train_windows: int, val_windows: int) -> DataFrame:
    """The first windows to train, the next to validate, the rest to test; fails where nothing is left to test."""
    both = windows.withColumn("total", _total(windows))
    at = F.when(F.col("total") <= train_windows + val_windows, F.raise_error(F.lit("no window is left to test")).cast("long")).otherwise(F.col("window_no"))
    return both.withColumn("split", _cut(at, F.lit(train_windows), F.lit(val_windows))).drop("total")


def split(windows: DataFrame, strategy: str, train: float, val: float) -> DataFrame:
    strategies = {"time": split_by_time, "series": split_by_series, "rolling": split_rolling}
    if strategy not in strategies:
        raise SeriesError(f"no strategy {strategy!r}; there are {', '.join(strategies)}")
    return strategies[strategy](windows, train, val)


def batches(windows: DataFrame, batch_size: int) -> DataFrame:
    """window_no, batch, input (flat float array) and label where there is one, for a loader; Arrow hands it on."""
    label = ["label"] if "label" in windows.columns else []
    return windows.select("window_no", F.floor(F.col("window_no") / batch_size).alias("batch"), F.transform(F.flatten("window"), lambda x: x.cast("float")).alias("input"), *label)
