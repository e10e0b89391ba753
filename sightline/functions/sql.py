"""The engine from SQL: views and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, udtf

from ..operators.graph import VisibilityGraph
from ..operators.visibility import horizontal_blocks, horizontal_of, natural_blocks, natural_of


@udtf(returnType="src bigint, dst bigint, weight double")
class VisibilityEdges:
    """visibility_edges(values array<double>, kind string): edges of one series."""

    def eval(self, values: list[float], kind: str) -> Iterator[tuple[int, int, float]]:
        if values is None or any(v is None for v in values):
            raise ValueError("missing value; impute first")
        of = {"natural": natural_of, "horizontal": horizontal_of}.get(kind)
        if of is None:
            raise ValueError(f"no kind {kind!r}; there are natural and horizontal")
        for i, dsts in of(np.asarray(values, float)):
            for j in dsts.tolist():
                yield i, j, 1.0


_BLOCKS = {"natural": natural_blocks, "horizontal": horizontal_blocks}


@arrow_udf(T.ArrayType(T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])))
def visibility_pairs(values: pa.Array, kind: pa.Array) -> pa.Array:
    """visibility_pairs(values array<double>, kind string): the edges of each row's series, for ``inline``.

    A batch of series at once, by Arrow; the table function takes a row at a time, and Spark joins no other to a table.
    """
    src, dst, offsets = [], [], [0]
    for k in range(len(values)):
        v, of = values[k], _BLOCKS.get(kind[k].as_py())
        if of is None:
            raise ValueError(f"no kind {kind[k].as_py()!r}; there are natural and horizontal")
        if not v.is_valid or v.values.null_count:
            raise ValueError("missing value; impute first")
        found = list(of(v.values.to_numpy()))
        src += [a for a, _ in found]
        dst += [b for _, b in found]
        offsets.append(offsets[-1] + sum(len(a) for a, _ in found))
    ends = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (src, dst)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(ends, names=["src", "dst"]))


def register(spark: SparkSession) -> None:
    spark.udtf.register("visibility_edges", VisibilityEdges)
    spark.udf.register("visibility_pairs", visibility_pairs)


def create_views(g: VisibilityGraph, prefix: str = "graph") -> tuple[DataFrame, DataFrame, DataFrame]:
    """<prefix>_nodes, <prefix>_edges and <prefix>_degrees, for spark.sql."""
    frames = g.nodes, g.edges, g.degrees()
    for name, df in zip(("nodes", "edges", "degrees"), frames, strict=True):
        df.createOrReplaceTempView(f"{prefix}_{name}")
    return frames
