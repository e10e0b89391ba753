"""Comparison of graphs, and averages over batches of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored
from . import local
from .clustering import clustering
from .degree import density
from .graph import VisibilityGraph
from .visibility import natural_and_horizontal


def compare(a: VisibilityGraph, b: VisibilityGraph) -> DataFrame:
    """series_id, edge_overlap (Jaccard), degree_correlation (null where the numbers of nodes differ,
    1 without spread), clustering_diff, density_diff of the graphs with the same key."""
    x = a.edges.select("series_id", "src", "dst", F.lit(1).alias("x"))
    y = b.edges.select("series_id", "src", "dst", F.lit(1).alias("y"))
    overlap = x.join(y, ["series_id", "src", "dst"], "full").groupBy("series_id").agg((F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)) / F.count("*")).alias("edge_overlap"))
    da, db = a.degrees().withColumnRenamed("degree", "x"), b.degrees().withColumnRenamed("degree", "y")
    both = da.join(db, ["series_id", "node"], "full").groupBy("series_id").agg(F.count("x").alias("nx"), F.count("y").alias("ny"), F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    flat = (F.col("sx") == 0) | (F.col("sy") == 0)
    corr = both.select("series_id", F.when((F.col("nx") == F.col("n")) & (F.col("ny") == F.col("n")), F.when(flat, 1.0).otherwise(F.try_divide(F.col("c"), F.col("sx") * F.col("sy")))).alias("degree_correlation"))
    cc = clustering(a).select("series_id", F.col("average_clustering").alias("ca")).join(clustering(b).select("series_id", F.col("average_clustering").alias("cb")), "series_id").select("series_id", F.abs(F.col("ca") - F.col("cb")).alias("clustering_diff"))
    dd = density(a).withColumnRenamed("density", "da").join(density(b).withColumnRenamed("density", "db"), "series_id").select("series_id", F.abs(F.col("da") - F.col("db")).alias("density_diff"))
    return corr.join(overlap, "series_id", "left").join(cc, "series_id").join(dd, "series_id").select("series_id", F.coalesce("edge_overlap", F.lit(0.0)).alias("edge_overlap"), "degree_correlation", "clustering_diff", "density_diff")


def _nodes_by_joins(e: DataFrame) -> DataFrame:
    """series_id, x, y, tx, ty of each node: degrees and triangles in all edges and in horizontal ones; for graphs that are too large for a task."""
    h = F.col("is_horizontal").cast("long")
    ends = e.select("series_id", F.explode(F.array("src", "dst")).alias("node"), "is_horizontal").groupBy("series_id", "node").agg(F.count("*").alias("x"), F.sum(h).alias("y"))
    ab, bc, ac = (e.select("series_id", F.col("src").alias(i), F.col("dst").alias(j), F.col("is_horizontal").alias(f"h{i}{j}")) for i, j in ("ab", "bc", "ac"))
    t = ab.join(bc, ["series_id", "b"]).join(ac, ["series_id", "a", "c"]).select("series_id", F.explode(F.array("a", "b", "c")).alias("node"), (F.col("hab") & F.col("hbc") & F.col("hac")).cast("long").alias("both"))
    t = t.groupBy("series_id", "node").agg(F.count("*").alias("tx"), F.sum("both").alias("ty"))
    return ends.join(t, ["series_id", "node"], "left").select("series_id", "x", "y", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tx", "ty")))


def _nodes(e: DataFrame) -> DataFrame:
    """The same in one task for each graph, many of which share a batch."""
    schema = T.StructType([e.schema["series_id"], *(T.StructField(c, T.LongType()) for c in ("x", "y", "tx", "ty"))])

    def run(group, src, dst, flat):
        graph, base, of = local.united(group, src, dst)
        y = np.bincount(np.concatenate([src, dst]) + np.tile(base[group], 2), weights=np.tile(flat, 2), minlength=graph.n).astype(np.int64)
        tx, ty, flat = np.zeros(graph.n, np.int64), np.zeros(graph.n, np.int64), flat[graph.at]
        for e, f, g in graph.triangles():
            both = flat[e] & flat[f] & flat[g]
            for corner in (graph.lo[e], graph.hi[e], graph.hi[f]):
                tx += np.bincount(corner, minlength=graph.n)
                ty += np.bincount(corner[both], minlength=graph.n)
        kept = graph.degree[graph.node] > 0
        yield of[graph.node][kept], graph.degree[graph.node][kept], y[graph.node][kept], tx[kept], ty[kept]

    return local.mapped(local.arrays(e, "src", "dst", "is_horizontal"), schema, run)


def compare_kinds(series: DataFrame) -> DataFrame:
    """``compare`` of the natural and the horizontal graph of each series, in one pass.

    Horizontal edges are natural ones with a flag, so degrees, triangles and edges of both graphs are counted together,
    over one table of edges.
    """
    e = stored(natural_and_horizontal(series), "kinds")
    few, large = local.divided(e)
    found = _nodes(e) if large is None else _nodes(e.join(few, "series_id", "left_semi")).union(_nodes_by_joins(e.join(large, "series_id", "left_semi")))
    share = lambda t, d: F.when(F.col(d) < 2, 0.0).otherwise(F.try_divide(F.coalesce(t, F.lit(0)), F.col(d) * (F.col(d) - 1) / 2))
    nodes = found.select("series_id", "x", "y", share("tx", "x").alias("cx"), share("ty", "y").alias("cy"))
    sums = nodes.groupBy("series_id").agg(
        F.count("*").alias("k"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("dx"), F.stddev_pop("y").alias("dy"),
        F.avg("cx").alias("cx"), F.avg("cy").alias("cy"),
    )
    flat = (F.col("dx") == 0) | (F.col("dy") == 0)
    rows = sums.select("series_id", F.try_divide("sy", "sx").alias("edge_overlap"), F.when(flat, 1.0).otherwise(F.try_divide(F.col("c"), F.col("dx") * F.col("dy"))).alias("degree_correlation"), F.abs(F.col("cx") - F.col("cy")).alias("clustering_diff"), F.try_divide(F.col("sx") - F.col("sy"), F.col("k") * (F.col("k") - 1)).alias("density_diff"))
    single = series.groupBy("series_id").agg(F.count("*").alias("n")).filter("n = 1")
    return rows.union(single.select("series_id", F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)))


def batch_statistics(statistics: DataFrame) -> DataFrame:
    """One row of averages over the series of ``graph_statistics``."""
    return statistics.agg(F.count("*").alias("num_graphs"), F.avg("edge_count").alias("avg_edges"), F.avg("average_clustering").alias("avg_clustering"), F.avg("average_path_length").alias("avg_path_length"), F.avg("density").alias("avg_density"))


def batch_summary(statistics: DataFrame) -> DataFrame:
    """text: the one row of ``batch_statistics`` as lines."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce((F.round(c, 2) if c != "num_graphs" else F.col(c)).cast("string"), F.lit("-"))) for c in statistics.columns]
    return statistics.select(F.concat_ws("\n", *parts).alias("text"))


def batch(series: dict[str, DataFrame]) -> DataFrame:
    """Labelled series as one frame: label and series_id become the key."""
    out = None
    for label, df in series.items():
        part = df.withColumn("series_id", F.concat(F.lit(f"{label}/"), F.col("series_id").cast("string")))
        out = part if out is None else out.unionByName(part)
    return out
