"""Frequency, wavelet and complexity measures of series."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .impute import order


def fft_windows(series: DataFrame, window_size: int) -> DataFrame:
    """series_id, idx, magnitudes: of the discrete Fourier transform around each sample.

    The window is [idx - w/2, idx + w/2), clipped at the ends and padded on the right with zeros.
    """
    half = window_size // 2
    near = F.collect_list(F.coalesce("value", F.lit(0.0))).over(order().rowsBetween(-half, half - 1))

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def magnitudes(windows: pa.Array) -> pa.Array:
        lengths = windows.value_lengths().to_numpy()
        padded = np.zeros((len(windows), window_size))
        padded[np.arange(window_size) < lengths[:, None]] = windows.flatten().to_numpy()
        # The bins past the middle mirror those before it.
        half_bins = np.abs(np.fft.rfft(padded))
        bins = np.concatenate([half_bins, half_bins[:, (window_size - 1) // 2 : 0 : -1]], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(windows) + 1) * window_size, pa.int32()), pa.array(bins.ravel()))

    return series.select("series_id", "idx", near.alias("x")).select("series_id", "idx", magnitudes("x").alias("magnitudes"))


def dominant_frequency(magnitudes: Column) -> Column:
    """Bin from 1 up to half the window with the greatest magnitude; the last of equals."""
    bins = F.sequence(F.lit(1), F.greatest(F.floor(F.size(magnitudes) / 2), F.lit(1)).cast("int"))
    return F.array_max(F.transform(bins, lambda k: F.struct(F.round(F.get(magnitudes, k), 9).alias("m"), k.alias("k"))))["k"]


def spectral_energy(magnitudes: Column, start: int, end: int) -> Column:
    """Sum of squared magnitudes over the bins start..end-1."""
    return F.aggregate(F.slice(magnitudes, start + 1, max(0, end - start)), F.lit(0.0), lambda s, m: s + m * m)


def haar(series: DataFrame) -> DataFrame:
    """series_id, k, approximation, detail: one level; an odd sample at the end is dropped."""
    pair = F.floor(F.col("idx") / 2)
    left, right = (F.max(F.when(F.col("idx") % 2 == side, F.col("value"))) for side in (0, 1))
    pairs = series.groupBy("series_id", pair.alias("k")).agg(left.alias("a"), right.alias("b"), F.count("*").alias("n")).filter("n = 2")
    return pairs.select("series_id", "k", ((F.col("a") + F.col("b")) / math.sqrt(2)).alias("approximation"), ((F.col("a") - F.col("b")) / math.sqrt(2)).alias("detail"))


def haar_levels(series: DataFrame, levels: int) -> DataFrame:
    """series_id, level, k, approximation, detail of 1..levels."""
    now, out = series.select("series_id", "idx", "value"), None
    for level in range(1, levels + 1):
        step = haar(now)
        part = step.select("series_id", F.lit(level).alias("level"), "k", "approximation", "detail")
        out = part if out is None else out.union(part)
        now = step.select("series_id", F.col("k").alias("idx"), F.col("approximation").alias("value"))
    return out


def wavelet_energy(series: DataFrame, level: int) -> DataFrame:
    return haar_levels(series, level).filter(F.col("level") == level).groupBy("series_id").agg(F.sum(F.col("detail") * F.col("detail")).alias("energy"))


def sample_entropy(series: DataFrame, m: int, r: float) -> DataFrame:
    """series_id, sample_entropy: n - m templates for each length, ordered pairs, greatest
    difference up to r; 0 where one of the shares is none, or for n <= m + 1.

    Templates lie in cells of side r by their first samples, so one that is near lies in the same or a neighbouring cell; a template meets
    only these, wherever its series is. Templates of the same samples are counted first and meet as one, and
    pairs of the longer templates are those of the shorter whose next samples are near as well.
    """
    w = order()
    values = [F.col("value") if k == 0 else F.lead("value", k).over(w) for k in range(m + 1)]
    # A template of m samples is one of the n - m only if a sample follows it; the longer needs one more.
    names = [f"v{k}" for k in range(m + 1)]
    templates = series.select("series_id", *(v.alias(k) for v, k in zip(values, names, strict=True)), F.lead("idx", m + 1).over(w).isNotNull().alias("longer")).filter(F.col(names[-1]).isNotNull())
    same = templates.groupBy("series_id", *names, "longer").agg(F.count("*").alias("c"))
    side = float(r) if r > 0 else 1.0
    cells = [f"cell{k}" for k in range(min(m, 2))]
    placed = same.select("*", *(F.floor(F.col(n) / side).alias(c) for n, c in zip(names, cells, strict=False)))
    # Of two cells side by side only one looks for the other, and what it finds counts twice.
    steps = [(0,), (1,)] if len(cells) == 1 else [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    moved = F.array(*(F.struct(F.lit(2 if any(step) else 1).alias("times"), *((F.col(c) + d).alias(c) for c, d in zip(cells, step, strict=True))) for step in steps))
    near = placed.select("series_id", F.explode(moved).alias("to"), *(F.col(n).alias(f"o_{n}") for n in names), F.col("longer").alias("o_longer"), F.col("c").alias("o_c"))
    other = near.select("series_id", "to.*", *(f"o_{n}" for n in names), "o_longer", "o_c")
    close = [F.abs(F.col(n) - F.col(f"o_{n}")) <= r for n in names]
    pairs = other.join(placed, ["series_id", *cells])
    for x in close[:-1]:
        pairs = pairs.filter(x)
    ways = F.col("c") * F.col("o_c") * F.col("times")
    met = pairs.groupBy("series_id").agg(F.sum(ways).alias("p"), F.sum(F.when(F.col("longer") & F.col("o_longer") & close[-1], ways)).alias("q"))
    n = series.groupBy("series_id").agg(F.count("*").alias("n"))
    # Each template has met itself, too.
    own = 1 if r >= 0 else 0
    shares = n.join(met, "series_id", "left").select("series_id", "n", *(F.try_divide(F.coalesce(x, F.lit(0)) - own * k, (k * (k - 1)).cast("double")).alias(x) for x, k in (("p", F.col("n") - m), ("q", F.col("n") - m - 1))))
    return shares.select("series_id", F.when((F.col("n") <= m + 1) | (F.coalesce("p", F.lit(0)) <= 0) | (F.coalesce("q", F.lit(0)) <= 0), 0.0).otherwise(-F.log(F.try_divide(F.col("q"), F.col("p")))).alias("sample_entropy"))


def hurst_exponent(series: DataFrame) -> DataFrame:
    """series_id, hurst: ln(R/S) / ln(n) of the whole series; 0.5 where n < 10 or there is no spread."""
    whole = Window.partitionBy("series_id")
    spread = series.withColumn("d", F.col("value") - F.avg("value").over(whole)).withColumn("c", F.sum("d").over(order()))
    found = spread.groupBy("series_id").agg(F.count("*").alias("n"), (F.max("c") - F.min("c")).alias("range"), F.stddev_pop("value").alias("s"))
    ratio = F.try_divide(F.col("range"), F.col("s"))
    return found.select("series_id", F.when((F.col("n") < 10) | ratio.isNull() | (ratio <= 0), 0.5).otherwise(F.try_divide(F.log(ratio), F.log(F.col("n").cast("double")))).alias("hurst"))
