"""Series from tables, files and Python values.

A series table has series_id, idx (0-based sample number), t (double) and value
(double, null where missing). Rows of a table have no order of their own, so
an order key is always asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SeriesError
from ..operators.running import numbered

POINTS = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("t", T.DoubleType()), T.StructField("value", T.DoubleType()),
])


def points(df: DataFrame, series: str | None, order: str | Sequence[str], value: str, time: str | None = None, long: bool = False) -> DataFrame:
    """Number the rows of each series by the order key. One shuffle, on the series.

    A table that is one series (``series`` None), and one with series too ``long`` for a task, goes to
    ranges of the order key instead, and each range is numbered on its own.
    """
    order = [order] if isinstance(order, str) else list(order)
    missing = [c for c in [*([series] if series else []), *order, value, *([time] if time else [])] if c not in df.columns]
    if missing:
        raise SeriesError(f"no such column: {', '.join(missing)}")
    for c in (value, time):
        if c and not isinstance(df.schema[c].dataType, (T.NumericType, T.TimestampType, T.DateType)):
            raise SeriesError(f"{c} is no number")
    key, idx = F.col(series) if series else F.lit("0"), F.col("_idx")
    if long or not series:
        kept = df.select(*dict.fromkeys([*([series] if series else []), *order, value, *([time] if time else [])]))
        df = numbered(kept, order, "_idx", series)
    else:
        idx = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long")
    t = F.unix_micros(F.col(time).cast("timestamp")) / 1e6 if time and isinstance(df.schema[time].dataType, (T.TimestampType, T.DateType)) else F.col(time).cast("double") if time else idx.cast("double")
    return df.select(key.alias("series_id"), idx.alias("idx"), t.alias("t"), F.col(value).cast("double").alias("value"))


def from_values(spark: SparkSession, values: Iterable[float | None], series_id: str = "0", times: Sequence[float] | None = None) -> DataFrame:
    """One series of given values, at 0..n-1 or at ``times``."""
    values = [None if v is None else float(v) for v in values]
    if not values:
        raise SeriesError("empty series")
    if times is not None and len(times) != len(values):
        raise SeriesError(f"{len(times)} times for {len(values)} values")
    return spark.createDataFrame([(series_id, i, float(i if times is None else times[i]), v) for i, v in enumerate(values)], POINTS)


def from_array(spark: SparkSession, array: np.ndarray, series_id: str = "0") -> DataFrame:
    """One series of a numpy vector; NaN is missing."""
    return from_values(spark, (None if np.isnan(x) else float(x) for x in np.asarray(array, float)), series_id)


def from_arrays(df: DataFrame, series: str, values: str) -> DataFrame:
    """A series for each row, of its array column."""
    return df.select(F.col(series).alias("series_id"), F.posexplode(values).alias("idx", "value")).select("series_id", F.col("idx").cast("long").alias("idx"), F.col("idx").cast("double").alias("t"), F.col("value").cast("double").alias("value"))


@dataclass(frozen=True)
class CsvOptions:
    """How a CSV file holds a series: which columns by place, and what stands for a missing value."""

    has_header: bool = True
    timestamp_column: int | None = 0
    value_column: int = 1
    delimiter: str = ","
    missing_value: str = ""


def _lines_to_points(lines: DataFrame, options: CsvOptions, series_id: str) -> DataFrame:
    """``lines``: line, and the columns that order lines."""
    order = [c for c in lines.columns if c != "line"]
    if options.has_header:
        place = F.struct(*order)
        lines = lines.filter(place > lines.agg(F.min(place).alias("first")).scalar())
    cells = F.split(F.col("line"), r"\Q" + options.delimiter + r"\E", -1)

    def number(k: int) -> Column:
        cell = F.trim(F.get(cells, F.lit(k)))
        return F.when((cell == options.missing_value) | (cell == ""), None).otherwise(cell.cast("double"))

    rows = lines.filter(F.trim("line") != "").select(*order, (number(options.timestamp_column) if options.timestamp_column is not None else F.lit(None).cast("double")).alias("t"), number(options.value_column).alias("value"))
    return numbered(rows, order, "idx").select(F.lit(series_id).alias("series_id"), "idx", F.coalesce("t", F.col("idx").cast("double")).alias("t"), "value")


def from_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions(), series_id: str = "0") -> DataFrame:
    """The single series of a CSV file, or of the files of a folder in the order of their names. Cells that are no numbers fail the query.

    Lines are ordered by file, by the start of the block of the file that a task reads, and by their place in it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    return _lines_to_points(lines, options, series_id)


def from_csv_string(spark: SparkSession, data: str, options: CsvOptions = CsvOptions(), series_id: str = "0") -> DataFrame:
    if not data.strip():
        raise SeriesError("empty series")
    return _lines_to_points(spark.createDataFrame(list(enumerate(data.splitlines())), "n long, line string"), options, series_id)


def lengths(series: DataFrame) -> DataFrame:
    """series_id, n, n_valid."""
    return series.groupBy("series_id").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"))


def to_arrays(series: DataFrame, keep_missing: bool = True) -> DataFrame:
    """series_id, values: one array for each series, in order; with or without the missing."""
    kept = series if keep_missing else series.filter("value is not null")
    return kept.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("a")).select("series_id", F.col("a.value").alias("values"))


def to_numpy(series: DataFrame) -> np.ndarray:
    """A single small series as a vector, NaN where missing."""
    return np.array([np.nan if r["value"] is None else r["value"] for r in series.orderBy("idx").select("value").collect()])


def require_complete(series: DataFrame) -> DataFrame:
    """Fails, when it runs, on a series with missing values."""
    message = F.concat(F.lit("missing value in series "), F.col("series_id").cast("string"), F.lit(" at "), F.col("idx").cast("string"), F.lit("; impute first"))
    return series.withColumn("value", F.when(F.col("value").isNull(), F.raise_error(message).cast("double")).otherwise(F.col("value")))
