"""Visibility graphs of many series, as lazy frames of nodes and edges."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..functions.features import FeatureSet
from . import visibility


@dataclass(frozen=True)
class VisibilityGraph:
    """nodes (series_id, node, value, then features), edges (series_id, src, dst, weight; src < dst)."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    @staticmethod
    def from_series(series: DataFrame) -> GraphBuilder:
        return GraphBuilder(series)

    def links(self) -> DataFrame:
        """series_id, node, neighbor, weight: each edge from both ends, or forward only if directed."""
        forward = self.edges.select("series_id", F.col("src").alias("node"), F.col("dst").alias("neighbor"), "weight")
        return forward if self.directed else forward.union(self.edges.select("series_id", "dst", "src", "weight"))

    def neighbors(self, node: int) -> DataFrame:
        return self.links().filter(F.col("node") == node)

    def has_edge(self, a: int, b: int) -> DataFrame:
        """series_id, has_edge of every series."""
        lo, hi = (a, b) if self.directed else (min(a, b), max(a, b))
        hit = self.edges.filter((F.col("src") == lo) & (F.col("dst") == hi)).select("series_id", F.lit(True).alias("hit"))
        return self.nodes.select("series_id").distinct().join(hit, "series_id", "left").select("series_id", F.coalesce("hit", F.lit(False)).alias("has_edge"))

    def degrees(self) -> DataFrame:
        """series_id, node, degree; out-degree if directed."""
        counts = self.links().groupBy("series_id", "node").agg(F.count("*").alias("degree"))
        return self.nodes.select("series_id", "node").join(counts, ["series_id", "node"], "left").select("series_id", "node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def counts(self) -> DataFrame:
        """series_id, node_count, edge_count."""
        n = self.nodes.groupBy("series_id").agg(F.count("*").alias("node_count"))
        m = self.edges.groupBy("series_id").agg(F.count("*").alias("edge_count"))
        return n.join(m, "series_id", "left").select("series_id", "node_count", F.coalesce("edge_count", F.lit(0)).cast("long").alias("edge_count"))

    def node_features(self) -> DataFrame:
        return self.nodes.drop("value")

    def feature_names(self) -> list[str]:
        return [c for c in self.nodes.columns if c not in ("series_id", "node", "value")]

    def adjacency(self, symmetric: bool = False) -> DataFrame:
        """series_id, row, col, weight of the entries that are not zero."""
        upper = self.edges.select("series_id", F.col("src").alias("row"), F.col("dst").alias("col"), "weight")
        return upper.union(self.edges.select("series_id", "dst", "src", "weight")) if symmetric and not self.directed else upper

    def adjacency_rows(self, symmetric: bool = False) -> DataFrame:
        """series_id, row, entries: dense rows, for short series."""
        n = self.nodes.groupBy("series_id").agg(F.count("*").alias("n"))
        filled = self.adjacency(symmetric).groupBy("series_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "weight"))).alias("m"))
        rows = self.nodes.select("series_id", F.col("node").alias("row")).join(n, "series_id").join(filled, ["series_id", "row"], "left")
        entry = lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0.0))
        return rows.select("series_id", "row", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), entry).alias("entries"))

    def persist(self) -> VisibilityGraph:
        """Keep edges for queries that use them more than once."""
        return replace(self, edges=self.edges.persist())


@dataclass(frozen=True)
class GraphBuilder:
    series: DataFrame
    features: FeatureSet | None = None
    directed: bool = False
    weight: object = "unit"
    strategy: str = "auto"

    def with_features(self, features: FeatureSet) -> GraphBuilder:
        return replace(self, features=features)

    def with_direction(self, directed: bool) -> GraphBuilder:
        return replace(self, directed=directed)

    def with_weight(self, weight) -> GraphBuilder:
        return replace(self, weight=weight)

    def with_strategy(self, strategy: str) -> GraphBuilder:
        return replace(self, strategy=strategy)

    def _nodes(self) -> DataFrame:
        nodes = self.series.select("series_id", F.col("idx").alias("node"), "value")
        return nodes.join(self.features.compute(self.series), ["series_id", "node"]) if self.features and len(self.features) else nodes

    def natural_visibility(self) -> VisibilityGraph:
        return VisibilityGraph(self._nodes(), visibility.natural(self.series, self.weight, self.strategy), self.directed)

    def horizontal_visibility(self, mode: str = "standard") -> VisibilityGraph:
        return VisibilityGraph(self._nodes(), visibility.horizontal(self.series, self.weight, self.strategy, mode), self.directed)


def natural_visibility(series: DataFrame, **options) -> DataFrame:
    return visibility.natural(series, **options)


def horizontal_visibility(series: DataFrame, **options) -> DataFrame:
    return visibility.horizontal(series, **options)


def of_edges(edges: DataFrame, directed: bool = False) -> VisibilityGraph:
    """A graph of given edges, its nodes being their ends (every sample but that of a series of one is one)."""
    if not {"series_id", "src", "dst"} <= set(edges.columns):
        raise GraphError("edges have series_id, src and dst")
    weight: Column = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    edges = edges.select("series_id", "src", "dst", weight.alias("weight"))
    ends = edges.select("series_id", F.col("src").alias("node")).union(edges.select("series_id", "dst")).distinct()
    return VisibilityGraph(ends.withColumn("value", F.lit(None).cast("double")), edges, directed)
