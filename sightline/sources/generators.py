"""Synthetic series, computed on the executors.

Each is a column of the sample's number i (and the series' length n), so it can be made on the samples of
given series as well as on new ones: ``on(series, lambda i, n: sine(i, n, 3, 2))``. Sequential recurrences are folded (the logistic
map, all series of a batch at once) or have a closed form (the generator of pseudorandom numbers).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# The 64-bit linear congruential generator's multiplier and increment.
MULTIPLIER = 1664525
INCREMENT = 1013904223


def on(series: DataFrame, value: Callable[[Column, Column], Column]) -> DataFrame:
    """``series`` (series_id, idx, t) with values made of each sample's number and its series' length."""
    n = series.groupBy("series_id").agg(F.count("*").alias("_n"))
    return series.join(n, "series_id").select("series_id", "idx", "t", value(F.col("idx"), F.col("_n")).cast("double").alias("value"))


def _series(spark: SparkSession, n: int, value: Column, series_id: str) -> DataFrame:
    return spark.range(n).select(F.lit(series_id).alias("series_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("t"), value.cast("double").alias("value"))


def sine(i: Column, n: Column, frequency: float, amplitude: float) -> Column:
    return amplitude * F.sin(2 * math.pi * frequency * i / n)


def frequencies(i: Column, n: Column, of: Sequence[float]) -> Column:
    return sum((F.sin(2 * math.pi * f * i / n) for f in of), F.lit(0.0))


def saw(i: Column, period: int) -> Column:
    return (i % period) / period


def square(i: Column, period: int) -> Column:
    if period < 2:
        raise ValueError("period is 2 at least")
    return F.when(F.floor(i / (period // 2)) % 2 == 0, 1.0).otherwise(-1.0)


def steps(i: Column, n: Column, levels: Sequence[float]) -> Column:
    """Equal stretches at each level; the last takes what is over."""
    regime = F.greatest(F.floor(n / len(levels)), F.lit(1))
    at = F.least(F.floor(i / regime), F.lit(len(levels) - 1)).cast("int")
    return F.element_at(F.array(*map(F.lit, map(float, levels))), at + 1)


def walk(i: Column, seed: int) -> Column:
    """Steps of one up or down by the lowest bit of the generator.

    Multiplier and increment are odd, so that bit alternates: the walk goes one
    step and comes back, which is its closed form.
    """
    return F.when(i % 2 == 0, 1.0 if (seed + INCREMENT) % 2 == 0 else -1.0).otherwise(0.0)


def sine_wave(spark: SparkSession, n: int, frequency: float, amplitude: float, series_id: str = "sine") -> DataFrame:
    return _series(spark, n, sine(F.col("id"), F.lit(n), frequency, amplitude), series_id)


def multi_frequency(spark: SparkSession, n: int, of: Sequence[float], series_id: str = "multi") -> DataFrame:
    return _series(spark, n, frequencies(F.col("id"), F.lit(n), of), series_id)


def sawtooth(spark: SparkSession, n: int, period: int, series_id: str = "sawtooth") -> DataFrame:
    return _series(spark, n, saw(F.col("id"), period), series_id)


def square_wave(spark: SparkSession, n: int, period: int, series_id: str = "square") -> DataFrame:
    return _series(spark, n, square(F.col("id"), period), series_id)


def step_function(spark: SparkSession, n: int, levels: Sequence[float], series_id: str = "steps") -> DataFrame:
    return _series(spark, n, steps(F.col("id"), F.lit(n), levels), series_id)


def random_walk(spark: SparkSession, n: int, seed: int, series_id: str = "walk") -> DataFrame:
    return _series(spark, n, walk(F.col("id"), seed), series_id)


def logistic_on(lengths: DataFrame, r: float, x0: float) -> DataFrame:
    """series_id, idx, t, value: x0, r x (1 - x), ... for each row of ``lengths`` (series_id, n); a series is an array on the way."""

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def states(n: pa.Array) -> pa.Array:
        x, count, out = float(x0), n.to_numpy(), []
        for _ in range(int(count.max()) if len(count) else 0):
            out.append(x)
            x = r * x * (1 - x)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(np.concatenate([np.zeros(0), *(out[:k] for k in count)])))

    rows = lengths.select("series_id", F.posexplode(states("n")).alias("idx", "value"))
    return rows.select("series_id", F.col("idx").cast("long").alias("idx"), F.col("idx").cast("double").alias("t"), "value")


def logistic_map(spark: SparkSession, n: int, r: float, x0: float, series_id: str = "logistic") -> DataFrame:
    return logistic_on(spark.range(1).select(F.lit(series_id).alias("series_id"), F.lit(n).cast("long").alias("n")), r, x0)


def noisy_trend(series: DataFrame, trend: float, noise_amplitude: float, seed: int, most: int = 1 << 20) -> DataFrame:
    """series_id, idx, t, value: trend * i plus noise uniform in +-amplitude/2, on the samples of ``series``, ``most`` for each at most.

    The generator's k-th state is an affine map of the seed, so every row finds its own from a power of the multiplier.
    """
    modulus = 1 << 64
    # states after 2**b steps as affine maps; a row combines those of its bits
    maps, a, c = [], MULTIPLIER % modulus, INCREMENT % modulus
    for _ in range(max(1, most.bit_length())):
        maps.append((a, c))
        a, c = a * a % modulus, (a * c + c) % modulus

    def times(k: int, x: Column) -> Column:
        """k * x mod 2**64 in decimals: 32 bits of k at a time keep products below 10**38."""
        m = F.lit(str(modulus)).cast("decimal(38,0)")
        hi, lo = k >> 32, k & 0xFFFFFFFF
        high = (F.lit(hi).cast("decimal(11,0)") * x).cast("decimal(38,0)") % m
        high = (F.lit(1 << 32).cast("decimal(11,0)") * high.cast("decimal(20,0)")).cast("decimal(38,0)") % m
        low = (F.lit(lo).cast("decimal(11,0)") * x).cast("decimal(38,0)") % m
        return ((high + low).cast("decimal(38,0)") % m).cast("decimal(20,0)")

    state = F.lit(str(seed % modulus)).cast("decimal(20,0)")
    number = F.when(F.col("idx") < most, F.col("idx") + 1).otherwise(F.raise_error(F.lit(f"more than {most} samples")).cast("long"))
    df = series.select("series_id", "idx", "t", number.alias("steps"), state.alias("x"))
    for b, (a, c) in enumerate(maps):
        moved = (times(a, F.col("x")).cast("decimal(38,0)") + F.lit(str(c)).cast("decimal(38,0)")) % F.lit(str(modulus)).cast("decimal(38,0)")
        df = df.withColumn("x", F.when(F.shiftright("steps", b).bitwiseAND(F.lit(1)) == 1, moved.cast("decimal(20,0)")).otherwise(F.col("x")))
    noise = (F.col("x").cast("double") / float(modulus) - 0.5) * noise_amplitude
    return df.select("series_id", "idx", "t", (trend * F.col("idx") + noise).alias("value"))


def trend_with_noise(spark: SparkSession, n: int, trend: float, noise_amplitude: float, seed: int, series_id: str = "trend") -> DataFrame:
    return noisy_trend(_series(spark, n, F.lit(0.0), series_id), trend, noise_amplitude, seed, n)
