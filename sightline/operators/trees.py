"""Spanning trees and orders of directed graphs.

Minimum spanning trees grow by rounds. In a round every component takes its lightest edge outwards (by weight, then
ends), and components that are joined by these become one, their number that of a root that all reach by doubling pointers.
Rounds are few, as each halves the components. Graphs of many short series grow in a kernel, many in a batch of arrays; a
graph that is too large for a task (``strategy="long"``) by joins, a table for each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored
from .graph import VisibilityGraph


def lightest_edges(g: VisibilityGraph) -> DataFrame:
    """The n - 1 lightest edges of each series (by weight, then ends): the reference variant, which may hold cycles."""
    n = g.nodes.groupBy("series_id").agg(F.count("*").alias("n"))
    ranked = g.edges.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy("weight", "src", "dst")))
    return ranked.join(n, "series_id").filter(F.col("rank") <= F.col("n") - 1).select("series_id", "src", "dst", "weight")


def spanning(n: int, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the edges of the minimum spanning forest of nodes 0..n-1; ``order`` ranks edges, lightest first."""
    home, taken = np.arange(n), np.zeros(len(a), bool)
    by_rank = np.argsort(order)
    while True:
        x, y = home[a], home[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            return np.flatnonzero(taken)
        best = np.full(n, len(a))
        np.minimum.at(best, x[open_], order[open_])
        np.minimum.at(best, y[open_], order[open_])
        own = np.flatnonzero(best < len(a))
        edge = by_rank[best[own]]
        taken[edge] = True
        to = np.arange(n)
        to[own] = np.where(x[edge] == own, y[edge], x[edge])
        # Of two components that took the same edge, one is the root.
        root = (to[to] == np.arange(n)) & (np.arange(n) < to)
        to[root] = np.flatnonzero(root)
        while (to[to] != to).any():
            to = to[to]
        home = to[home]


def _by_kernel(edges: DataFrame) -> DataFrame:
    names = edges.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(1).value_lengths().to_numpy()
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(np.cumsum(counts[begin:]), 1 << 18, "right")) + begin)
                part, group = batch.slice(begin, end - begin), np.repeat(np.arange(end - begin), counts[begin:end])
                src, dst, weight = (part.column(c).flatten().to_numpy() for c in (1, 2, 3))
                nodes = np.concatenate([group, group]), np.concatenate([src, dst])
                key = np.unique(nodes[0] * (int(dst.max()) + 1) + nodes[1], return_inverse=True)[1]
                order = np.empty(len(src), np.int64)
                order[np.lexsort((dst, src, weight))] = np.arange(len(src))
                keep = spanning(int(key.max()) + 1, key[: len(src)], key[len(src) :], order)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(group[keep])), *(pa.array(x[keep]) for x in (src, dst, weight))], names=names)
                begin = end

    arrays = edges.groupBy("series_id").agg(*(F.collect_list(c).alias(c) for c in ("src", "dst", "weight")))
    return arrays.mapInArrow(run, edges.schema)


def _by_joins(edges: DataFrame) -> DataFrame:
    rest = stored(edges.select("*", F.col("src").alias("a"), F.col("dst").alias("b")), "tree")
    tree = rest.limit(0).select(*edges.columns)
    while not rest.isEmpty():
        ends = rest.select("series_id", F.col("a").alias("at"), F.col("b").alias("to"), "weight", "src", "dst").union(rest.select("series_id", "b", "a", "weight", "src", "dst"))
        best = ends.groupBy("series_id", "at").agg(F.min(F.struct("weight", "src", "dst", "to")).alias("e")).select("series_id", "at", "e.*")
        best = stored(best, "tree")
        tree = tree.union(best.select("series_id", "src", "dst", "weight").distinct())
        mutual = best.alias("m").join(best.select("series_id", F.col("at").alias("to"), F.col("to").alias("back")).alias("n"), ["series_id", "to"])
        up = stored(mutual.select("series_id", "at", F.when((F.col("back") == F.col("at")) & (F.col("at") < F.col("to")), F.col("at")).otherwise(F.col("to")).alias("to")), "tree")
        while True:
            next_ = up.join(up.select("series_id", F.col("at").alias("to"), F.col("to").alias("root")), ["series_id", "to"]).select("series_id", "at", F.col("root").alias("to"), (F.col("root") != F.col("to")).alias("moved"))
            next_ = stored(next_, "tree")
            up = next_.select("series_id", "at", "to")
            if next_.filter("moved").isEmpty():
                break
        rest = rest.join(up.select("series_id", F.col("at").alias("a"), F.col("to").alias("x")), ["series_id", "a"]).join(up.select("series_id", F.col("at").alias("b"), F.col("to").alias("y")), ["series_id", "b"])
        rest = stored(rest.filter("x <> y").select(*edges.columns, F.col("x").alias("a"), F.col("y").alias("b")), "tree")
    return tree


def minimum_spanning_tree(g: VisibilityGraph, strategy: str = "auto") -> DataFrame:
    """series_id, src, dst, weight: the minimum spanning tree (or forest) of each series; of equal weights by src, then dst."""
    edges = g.edges.select("series_id", "src", "dst", "weight")
    return _by_joins(edges) if strategy == "long" else _by_kernel(edges)


def strongly_connected_components(g: VisibilityGraph) -> DataFrame:
    """series_id, node, component. Edges point forward in time, so every node is its own component."""
    return g.nodes.select("series_id", "node", F.col("node").alias("component"))


def topological_sort(g: VisibilityGraph) -> DataFrame:
    """series_id, node, position: edges point forward in time, so the order of samples is one."""
    return g.nodes.select("series_id", "node", F.col("node").alias("position"))
