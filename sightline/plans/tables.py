"""Series and graphs of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import VisibilityGraph
from ..sources.series import points


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each user: values in the order of time."""
    return points(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], "value")


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every value missing whose event_id is divisible by 7."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return points(df.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value"))), "user_id", ["ts", "event_id"], "value")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by day, a series for each order priority."""
    daily = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return points(daily, "o_orderpriority", "day", "revenue")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by day as one series."""
    daily = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return points(daily, None, "day", "revenue")


#: Graphs of the last tables that were asked for; those of others are let go.
_kept: dict[tuple, VisibilityGraph] = {}


def _graph(spark: SparkSession, sf_dir: str, kind: str) -> VisibilityGraph:
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _kept:
        if any(k[:2] != key[:2] for k in _kept):
            clear()
        builder = VisibilityGraph.from_series(events(spark, sf_dir))
        _kept[key] = (builder.natural_visibility() if kind == "natural" else builder.horizontal_visibility()).persist()
    return _kept[key]


def clear() -> None:
    """Let go of all graphs."""
    for (app, *_), g in list(_kept.items()):
        if g.edges.sparkSession.sparkContext._jsc and g.edges.sparkSession.sparkContext.applicationId == app:
            g.edges.unpersist()
    _kept.clear()


def natural(spark: SparkSession, sf_dir: str) -> VisibilityGraph:
    """Natural graphs of ``events``; their edges are kept for the queries that follow in the session."""
    return _graph(spark, sf_dir, "natural")


def horizontal(spark: SparkSession, sf_dir: str) -> VisibilityGraph:
    return _graph(spark, sf_dir, "horizontal")
