"""Matrices of graphs, as coordinates, and spectral quantities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import VisibilityGraph


def adjacency(g: VisibilityGraph) -> DataFrame:
    """series_id, row, col, weight, symmetric."""
    return g.adjacency(symmetric=True)


def laplacian(g: VisibilityGraph) -> DataFrame:
    """series_id, row, col, value of D - A, without zeros."""
    a = adjacency(g)
    diagonal = a.groupBy("series_id", "row").agg(F.sum("weight").alias("value")).select("series_id", "row", F.col("row").alias("col"), "value")
    return diagonal.union(a.select("series_id", "row", "col", (-F.col("weight")).alias("value")))


def features(g: VisibilityGraph) -> DataFrame:
    """series_id, node, row: the features in the order of their names, 0 where missing."""
    names = sorted(g.feature_names())
    return g.nodes.select("series_id", "node", F.array(*(F.coalesce(c, F.lit(0.0)) for c in names)).alias("row"))


def graph_energy(g: VisibilityGraph) -> DataFrame:
    """Square root of the trace of the squared adjacency matrix."""
    found = g.edges.groupBy("series_id").agg(F.sqrt(2 * F.sum(F.col("weight") * F.col("weight"))).alias("graph_energy"))
    return g.nodes.select("series_id").distinct().join(found, "series_id", "left").select("series_id", F.coalesce("graph_energy", F.lit(0.0)).alias("graph_energy"))


def _iterated(g: VisibilityGraph, schema: T.StructType, finish: Callable[[np.ndarray, np.ndarray, np.ndarray, int], dict]) -> DataFrame:
    """Runs ``finish`` (tail, head, weight, n) on the symmetric sparse matrix of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.concatenate([pdf["src"], pdf["dst"]])
        b = np.concatenate([pdf["dst"], pdf["src"]])
        w = np.concatenate([pdf["weight"], pdf["weight"]])
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0]} | finish(a, b, w, int(a.max()) + 1), index=None if len(schema) > 2 else [0])

    return g.edges.groupBy("series_id").applyInPandas(lambda pdf: run(pdf), schema)


def dominant_eigenvalue(g: VisibilityGraph, iterations: int = 100) -> DataFrame:
    """series_id, eigenvalue by power iteration from equal entries, and the Rayleigh quotient."""
    schema = T.StructType([g.edges.schema["series_id"], T.StructField("eigenvalue", T.DoubleType())])

    def finish(a, b, w, n):
        x = np.full(n, n**-0.5)
        for _ in range(iterations):
            y = np.bincount(a, w * x[b], n)
            norm = np.linalg.norm(y)
            if norm < 1e-10:
                break
            x = y / norm
        return {"eigenvalue": float(x @ np.bincount(a, w * x[b], n))}

    return _iterated(g, schema, finish)


def random_walk_stationary(g: VisibilityGraph, iterations: int = 100) -> DataFrame:
    """series_id, node, probability after so many steps of the walk from a uniform start."""
    schema = T.StructType([g.edges.schema["series_id"], T.StructField("node", T.LongType()), T.StructField("probability", T.DoubleType())])

    def finish(a, b, w, n):
        out = np.bincount(a, w, n)
        p = np.full(n, 1 / n)
        for _ in range(iterations):
            p = np.bincount(b, w * (p / np.where(out > 0, out, 1))[a], n)
        return {"node": np.arange(n), "probability": p}

    return _iterated(g, schema, finish)
