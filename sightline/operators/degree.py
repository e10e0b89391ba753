"""Statistics of degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import VisibilityGraph


def degree_stats(g: VisibilityGraph) -> DataFrame:
    """series_id, node_count, average_degree, min_degree, max_degree, degree_variance, degree_std_dev (population)."""
    d = F.col("degree")
    return g.degrees().groupBy("series_id").agg(F.count("*").alias("node_count"), F.avg(d).alias("average_degree"), F.min(d).alias("min_degree"), F.max(d).alias("max_degree"), F.var_pop(d).alias("degree_variance"), F.stddev_pop(d).alias("degree_std_dev"))


def degree_distribution(g: VisibilityGraph) -> DataFrame:
    return g.degrees().groupBy("series_id", "degree").agg(F.count("*").alias("nodes"))


def degree_histogram(g: VisibilityGraph) -> DataFrame:
    """series_id, degree, nodes for every degree from 0 to the greatest, those without nodes too."""
    found = degree_distribution(g)
    span = found.groupBy("series_id").agg(F.max("degree").alias("most")).select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"))).alias("degree"))
    return span.join(found, ["series_id", "degree"], "left").select("series_id", "degree", F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"))


def degree_entropy(g: VisibilityGraph) -> DataFrame:
    """In bits, from one pass: log2(n) - sum(c log2 c) / n over the degrees' counts c."""
    counts = degree_distribution(g).groupBy("series_id").agg(F.sum("nodes").alias("n"), F.sum(F.col("nodes") * F.log2("nodes")).alias("s"))
    return counts.select("series_id", (F.log2("n") - F.col("s") / F.col("n")).alias("degree_entropy"))


def degree_centrality(g: VisibilityGraph) -> DataFrame:
    n = g.nodes.groupBy("series_id").agg(F.count("*").alias("n"))
    return g.degrees().join(n, "series_id").select("series_id", "node", F.when(F.col("n") > 1, F.try_divide(F.col("degree"), F.col("n") - 1)).otherwise(0.0).alias("degree_centrality"))


def density_of(n: Column, m: Column) -> Column:
    return F.when(n < 2, 0.0).otherwise(F.try_divide(m, n * (n - 1) / 2))


def density(g: VisibilityGraph) -> DataFrame:
    return g.counts().select("series_id", density_of(F.col("node_count"), F.col("edge_count")).alias("density"))


def assortativity(g: VisibilityGraph) -> DataFrame:
    """Correlation of the degrees at edges' ends; 0 where there is no spread or no edge."""
    d = g.degrees()
    ends = g.edges.join(d.select("series_id", F.col("node").alias("src"), F.col("degree").alias("a")), ["series_id", "src"]).join(d.select("series_id", F.col("node").alias("dst"), F.col("degree").alias("b")), ["series_id", "dst"])
    a, b = F.col("a"), F.col("b")
    sums = ends.groupBy("series_id").agg(F.avg(a * b).alias("ab"), F.avg((a + b) / 2).alias("h"), F.avg((a * a + b * b) / 2).alias("q"))
    num, den = F.col("ab") - F.col("h") * F.col("h"), F.col("q") - F.col("h") * F.col("h")
    found = sums.select("series_id", F.when(F.abs(den) < 1e-10, 0.0).otherwise(F.try_divide(num, den)).alias("assortativity"))
    return g.nodes.select("series_id").distinct().join(found, "series_id", "left").select("series_id", F.coalesce("assortativity", F.lit(0.0)).alias("assortativity"))
