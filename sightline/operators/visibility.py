"""Visibility edges of series.

Samples j < i of a series see each other when every sample between lies below
the line between them (natural), or below both of them (horizontal). x is the
sample number. Both conditions are running maxima over the samples after j, so
no triple of samples is ever formed.

Two ways compute the same edges. The kernel takes a whole series as an array and
forms the slopes from blocks of its samples in numpy, with memory bounded by ``CELLS`` and the
series; only edges leave it, and one shuffle by series is all that moves. The relational one pairs the samples of a
series on its key and keeps the pairs that pass a windowed maximum, all in SQL: n^2/2 rows a
series are sorted, in tasks of about ``PAIRS``, so ``natural`` and ``horizontal`` take it only where it is asked for. ``strategy="long"`` cuts
each series into spans and joins what these show of themselves (``long_series``): for series that are too long for one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GraphError
from . import long_series

#: Slopes that are formed together, and edges that are handed on together.
CELLS, EDGES = 1 << 18, 100_000
#: Pairs of samples that a task of the relational way sorts, and sources of a series that stay together there.
PAIRS, SOURCES = 1 << 19, 1024
WEIGHTS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "unit": lambda i, j, a, b: F.lit(1.0),
    "absdiff": lambda i, j, a, b: F.abs(b - a),
    "distance": lambda i, j, a, b: (j - i).cast("double"),
    "geomean": lambda i, j, a, b: F.sqrt(F.abs(a * b)),
    "normdiff": lambda i, j, a, b: F.abs(b - a) / (F.abs(a) + F.abs(b) + 1e-10),
}


def _checked(series: DataFrame) -> DataFrame:
    wrong = F.concat(F.lit("missing value in series "), F.col("series_id").cast("string"), F.lit(" at "), F.col("idx").cast("string"), F.lit("; impute first"))
    return series.select("series_id", "idx", F.when(F.col("value").isNull(), F.raise_error(wrong).cast("double")).otherwise(F.col("value")).alias("v"))


def _pairs(s: DataFrame) -> DataFrame:
    """Pairs of a series' samples, src before dst, with ``block`` for the window over a source's pairs.

    Sources go by blocks of a series, and there are as many tasks as keep each near ``PAIRS`` pairs; so lengths are counted when this is called.
    """
    n = s.groupBy("series_id").count().agg(F.sum(F.col("count") * F.col("count").cast("double") / 2)).first()[0]
    tasks = max(1, math.ceil((n or 0) / PAIRS))
    block = lambda x: F.floor(F.col(x) / SOURCES).cast("int")
    a = s.select("series_id", block("idx").alias("block"), F.col("idx").alias("src"), F.col("v").alias("va"))
    b = s.select("series_id", F.explode(F.sequence(F.lit(0), block("idx"))).alias("block"), F.col("idx").alias("dst"), F.col("v").alias("vb"))
    return a.repartition(tasks, "series_id", "block").join(b.repartition(tasks, "series_id", "block"), ["series_id", "block"]).filter(F.col("src") < F.col("dst"))


def _between():
    return Window.partitionBy("series_id", "block", "src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)


def natural_pairs(s: DataFrame) -> DataFrame:
    pairs = _pairs(s).withColumn("slope", (F.col("vb") - F.col("va")) / (F.col("dst") - F.col("src")))
    seen = pairs.withColumn("most", F.max("slope").over(_between()))
    return seen.filter(F.col("most").isNull() | (F.col("slope") > F.col("most"))).select("series_id", "src", "dst", "va", "vb")


def horizontal_pairs(s: DataFrame) -> DataFrame:
    seen = _pairs(s).withColumn("most", F.max("vb").over(_between()))
    return seen.filter(F.col("most").isNull() | (F.col("most") < F.least("va", "vb"))).select("series_id", "src", "dst", "va", "vb")


def run_pairs(s: DataFrame) -> DataFrame:
    """The narrower horizontal rule: adjacent samples, and those with strictly
    falling samples from src up to the one before dst, all below dst after src.

    Within a falling run every sample after the next is lower than that one, so
    the only far partner of a sample is the one that ends its run: no samples are paired.
    """
    w = Window.partitionBy("series_id").orderBy("idx")
    s = s.withColumns({"next": F.lead("v").over(w), "next_idx": F.lead("idx").over(w)})
    breaks = F.sum(F.when(F.col("v") > F.col("next"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("run", F.coalesce(breaks, F.lit(0)))
    run = Window.partitionBy("series_id", "run").orderBy("idx").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumns({"end": F.last("next").over(run), "end_idx": F.last("next_idx").over(run)})
    far = (F.col("end_idx") > F.col("next_idx")) & (F.col("next") < F.col("end"))
    ends = F.array_compact(F.array(F.when(F.col("next").isNotNull(), F.struct(F.col("next_idx").alias("dst"), F.col("next").alias("vb"))), F.when(far, F.struct(F.col("end_idx").alias("dst"), F.col("end").alias("vb")))))
    return s.select("series_id", F.col("idx").alias("src"), F.col("v").alias("va"), F.explode(ends).alias("e")).select("series_id", "src", "e.dst", "va", "e.vb")


def natural_blocks(v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """src and dst of one series, some sources at a time: places where the slope from src reaches a new maximum."""
    n, at = len(v), 0
    x = np.arange(n, dtype=float)
    while at < n - 1:
        to = min(n - 1, at + max(1, CELLS // (n - at)))
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (v[at + 1 :] - v[at:to, None]) / (x[at + 1 :] - x[at:to, None])
        slope[x[at + 1 :] <= x[at:to, None]] = -np.inf
        most = np.maximum.accumulate(slope, axis=1)
        new = np.empty(slope.shape, bool)
        new[:, 0], new[:, 1:] = slope[:, 0] > -np.inf, slope[:, 1:] > most[:, :-1]
        src, dst = np.nonzero(new)
        yield src + at, dst + at + 1
        at = to


def natural_of(v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(src, dsts) of one series."""
    for src, dst in natural_blocks(v):
        yield from zip(np.unique(src).tolist(), np.split(dst, np.flatnonzero(np.diff(src)) + 1), strict=True)


def horizontal_of(v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(src, dsts) of one series, by a stack of what a later sample can still see."""
    after: list[list[int]] = [[] for _ in v]
    stack: list[int] = []
    for i, x in enumerate(v.tolist()):
        while stack and v[stack[-1]] < x:
            after[stack.pop()].append(i)
        if stack:
            after[stack[-1]].append(i)
            if v[stack[-1]] == x:
                stack.pop()
        stack.append(i)
    for i, dsts in enumerate(after):
        if dsts:
            yield i, np.array(dsts)


def horizontal_blocks(v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    found = list(horizontal_of(v))
    if found:
        yield np.repeat([i for i, _ in found], [len(d) for _, d in found]), np.concatenate([d for _, d in found])


def reaching(v: np.ndarray) -> np.ndarray:
    """The place of the next sample that is as high or higher, n where there is none."""
    out, stack, values = np.full(len(v), len(v)), [], v.tolist()
    for i, x in enumerate(values):
        while stack and values[stack[-1]] <= x:
            out[stack.pop()] = i
        stack.append(i)
    return out


def flagged_blocks(v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Natural edges, and whether each is a horizontal one as well: all horizontal edges are natural."""
    after, before = reaching(v), len(v) - 1 - reaching(v[::-1])[::-1]
    for src, dst in natural_blocks(v):
        yield src, dst, (after[src] == dst) | (before[dst] == src)


def _kernel(s: DataFrame, of: Callable[[np.ndarray], Iterator[tuple[np.ndarray, ...]]], flag: str | None = None) -> DataFrame:
    schema = T.StructType([s.schema["series_id"], T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("va", T.DoubleType()), T.StructField("vb", T.DoubleType()), *([T.StructField(flag, T.BooleanType())] if flag else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = batch.column(0), [], 0

            def out() -> pa.RecordBatch:
                k, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
                return pa.RecordBatch.from_arrays([ids.take(pa.array(k)), *map(pa.array, columns)], names=schema.names)

            for k in range(batch.num_rows):
                v = batch.column(1)[k].values.to_numpy(zero_copy_only=False)
                for src, dst, *flags in of(v):
                    held.append((np.full(len(src), k), src, dst, v[src], v[dst], *flags))
                    size += len(src)
                    if size > EDGES:
                        yield out()
                        held, size = [], 0
            if size:
                yield out()

    arrays = s.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("a")).select("series_id", F.col("a.v").alias("values"))
    return arrays.mapInArrow(run, schema)


def natural_and_horizontal(series: DataFrame) -> DataFrame:
    """series_id, src, dst, is_horizontal of the natural graphs; the horizontal graphs are the edges with the flag."""
    return _kernel(_checked(series), flagged_blocks, "is_horizontal").select("series_id", "src", "dst", "is_horizontal")


def _either(series: DataFrame, short: Callable[[DataFrame], DataFrame], of, long: Callable[[DataFrame], DataFrame], strategy: str) -> DataFrame:
    s = _checked(series)
    if strategy not in ("auto", "sql", "kernel", "long"):
        raise GraphError(f"no strategy {strategy!r}; there are auto, sql, kernel and long")
    return short(s) if strategy == "sql" else long(s) if strategy == "long" else _kernel(s, of)


def _weighted(pairs: DataFrame, weight: str | Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    if isinstance(weight, str):
        if weight not in WEIGHTS:
            raise GraphError(f"no weight {weight!r}; there are {', '.join(WEIGHTS)}")
        weight = WEIGHTS[weight]
    return pairs.select("series_id", "src", "dst", weight(F.col("src"), F.col("dst"), F.col("va"), F.col("vb")).cast("double").alias("weight"))


def natural(series: DataFrame, weight="unit", strategy: str = "auto") -> DataFrame:
    """series_id, src, dst, weight of the natural visibility graphs. ``weight`` is a
    name of WEIGHTS or a function of the columns (src, dst, value at src, value at dst)."""
    return _weighted(_either(series, natural_pairs, natural_blocks, long_series.natural_pairs, strategy), weight)


def horizontal(series: DataFrame, weight="unit", strategy: str = "auto", mode: str = "standard") -> DataFrame:
    """The same of the horizontal graphs; ``mode`` reference takes the narrower rule."""
    if mode == "reference":
        return _weighted(run_pairs(_checked(series)), weight)
    if mode != "standard":
        raise GraphError(f"no mode {mode!r}; there are standard and reference")
    return _weighted(_either(series, horizontal_pairs, horizontal_blocks, long_series.horizontal_pairs, strategy), weight)
