"""All statistics of a graph in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import clustering
from .degree import assortativity, degree_stats, density_of
from .graph import VisibilityGraph
from .paths import component_stats, node_paths, path_stats


def graph_statistics(g: VisibilityGraph) -> DataFrame:
    """The 19 statistics of each series' graph. The edges are used several times: persist the graph first where that pays."""
    counts, nodes = g.counts(), node_paths(g, betweenness=False)
    # The searches know components as well, where edges go both ways.
    parts = nodes.groupBy("series_id", "first").agg(F.count("*").alias("k")).groupBy("series_id").agg(F.count("*").alias("num_components"), F.max("k").alias("largest_component_size"))
    components = component_stats(g) if g.directed else parts
    names = g.feature_names()
    features = F.lit(len(names)).cast("long")
    joined = counts.join(degree_stats(g).drop("node_count"), "series_id").join(clustering(g), "series_id").join(path_stats(nodes), "series_id").join(components, "series_id").join(assortativity(g), "series_id")
    return joined.select(
        "series_id", "node_count", "edge_count", F.lit(g.directed).alias("is_directed"), "average_degree", "min_degree", "max_degree", "degree_std_dev", "degree_variance",
        "average_clustering", "global_clustering", "average_path_length", "diameter", "radius", density_of(F.col("node_count"), F.col("edge_count")).alias("density"),
        "is_connected", "num_components", "largest_component_size", "assortativity", features.alias("feature_count"),
    )


def summary(statistics: DataFrame) -> DataFrame:
    """series_id, line: the statistics as text."""
    names = [c for c in statistics.columns if c != "series_id"]
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce((F.round(c, 4) if statistics.schema[c].dataType.typeName() == "double" else F.col(c)).cast("string"), F.lit("-"))) for c in names]
    return statistics.select("series_id", F.concat_ws("\n", *parts).alias("line"))
