"""Triangles and clustering coefficients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import local
from .graph import VisibilityGraph


def triangles(g: VisibilityGraph) -> DataFrame:
    """series_id, a, b, c with a < b < c: each triangle once.

    The two edges that start at a are paired and then looked up; visibility
    graphs have a few edges for each sample, so pairs stay few. Edges are never broadcast: what
    is known of their size before they are made is far too low.
    """
    e = g.edges.select("series_id", "src", "dst")
    ab = e.select("series_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    bc = e.select("series_id", F.col("src").alias("b"), F.col("dst").alias("c"))
    ac = e.select("series_id", F.col("src").alias("a"), F.col("dst").alias("c"))
    return ab.join(bc.hint("merge"), ["series_id", "b"]).join(ac.hint("merge"), ["series_id", "a", "c"], "left_semi").select("series_id", "a", "b", "c")


def _closed(g: VisibilityGraph) -> DataFrame:
    """series_id, node, links: edges among a node's neighbours (its successors, if directed)."""
    if g.directed:
        return _closed_by_joins(g)
    few, large = local.divided(g.edges)
    if large is None:
        return _closed_in_tasks(g.edges)
    big = VisibilityGraph(g.nodes, g.edges.join(large, "series_id", "left_semi"))
    return _closed_in_tasks(g.edges.join(few, "series_id", "left_semi")).union(_closed_by_joins(big))


def _closed_by_joins(g: VisibilityGraph) -> DataFrame:
    corners = F.array("a") if g.directed else F.array("a", "b", "c")
    return triangles(g).select("series_id", F.explode(corners).alias("node")).groupBy("series_id", "node").agg(F.count("*").alias("links"))


def _closed_in_tasks(edges: DataFrame) -> DataFrame:
    """One task for each graph; many share a batch."""
    schema = T.StructType([edges.schema["series_id"], T.StructField("node", T.LongType()), T.StructField("links", T.LongType())])

    def run(group, src, dst):
        graph, base, of = local.united(group, src, dst)
        links = np.zeros(graph.n, np.int64)
        for e, f, _ in graph.triangles():
            for corner in (graph.lo[e], graph.hi[e], graph.hi[f]):
                links += np.bincount(corner, minlength=graph.n)
        node = graph.node[links > 0]
        yield of[node], node - base[of[node]], links[links > 0]

    return local.mapped(local.arrays(edges, "src", "dst"), schema, run)


def node_clustering(g: VisibilityGraph) -> DataFrame:
    """series_id, node, clustering, with links and triples that it is made of; 0 for a degree below 2."""
    both = g.degrees().join(_closed(g), ["series_id", "node"], "left").withColumn("links", F.coalesce("links", F.lit(0)))
    triples = F.col("degree") * (F.col("degree") - 1) / 2
    return both.select("series_id", "node", F.when(F.col("degree") < 2, 0.0).otherwise(F.try_divide(F.col("links"), triples)).alias("clustering"), "links", triples.alias("triples"))


def clustering(g: VisibilityGraph) -> DataFrame:
    """series_id, average_clustering, global_clustering."""
    sums = node_clustering(g).groupBy("series_id").agg(F.avg("clustering").alias("average_clustering"), F.sum("links").alias("links"), F.sum("triples").alias("triples"))
    return sums.select("series_id", "average_clustering", F.when(F.col("triples") > 0, F.try_divide(F.col("links"), F.col("triples"))).otherwise(0.0).alias("global_clustering"))
