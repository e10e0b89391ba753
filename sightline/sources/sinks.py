"""Graphs to text, files and matrices.

Text forms give one row for each series and are built on the executors. What
holds a whole graph in one string or matrix is for graphs of modest size; tables of edges
and nodes have no such limit.
"""

from __future__ import annotations

import io
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import VisibilityGraph

#: Bytes of numpy files that are handed on together.
FILES = 8 << 20


@dataclass(frozen=True)
class JsonOptions:
    include_weights: bool = True
    include_features: bool = False


def _number(x: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def _features(g: VisibilityGraph) -> Column:
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in sorted(g.feature_names())]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())) if pairs else F.create_map().cast("map<string,double>")


def to_json(g: VisibilityGraph, options: JsonOptions = JsonOptions()) -> DataFrame:
    """series_id, json: {"nodes", "edges", "features"}, edges and nodes in order."""
    parts = [F.col("src").alias("source"), F.col("dst").alias("target"), *([F.col("weight")] if options.include_weights else [])]
    edges = g.edges.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("edges"))
    out = g.nodes.groupBy("series_id").agg(F.count("*").alias("nodes")).join(edges, "series_id", "left")
    fields = [F.col("nodes"), F.coalesce("edges", F.array().cast(edges.schema["edges"].dataType)).alias("edges")]
    if options.include_features:
        own = g.nodes.select("series_id", "node", _features(g).alias("values")).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("node", "values")), lambda a, b: (a["node"] - b["node"]).cast("int")).alias("features"))
        out = out.join(own, "series_id", "left")
        fields.append(F.col("features"))
    return out.select("series_id", F.to_json(F.struct(*fields)).alias("json"))


def _lines(df: DataFrame, order: list[str], line: Column, header: Column | None = None, name: str = "text") -> DataFrame:
    rows = df.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return rows.select("series_id", (body if header is None else F.concat(header, F.lit("\n"), body)).alias(name))


def edge_list(g: VisibilityGraph, include_weights: bool = True) -> DataFrame:
    """series_id, source, target and weight as columns, for ``write.csv``."""
    return g.edges.select("series_id", F.col("src").alias("source"), F.col("dst").alias("target"), *(["weight"] if include_weights else []))


def to_edge_list_csv(g: VisibilityGraph, include_weights: bool = True) -> DataFrame:
    line = F.concat_ws(",", "src", "dst", *([_number(F.col("weight"))] if include_weights else []))
    return _lines(g.edges, ["src", "dst"], line, F.lit("source,target" + (",weight" if include_weights else "")))


def to_adjacency_csv(g: VisibilityGraph, symmetric: bool = False) -> DataFrame:
    rows = g.adjacency_rows(symmetric)
    header = F.concat(F.lit("node,"), F.array_join(F.transform(F.sequence(F.lit(0), F.size("rows") - 1), lambda k: k.cast("string")), ","))
    return _lines(rows, ["row"], F.concat_ws(",", F.col("row").cast("string"), F.array_join(F.transform("entries", _number), ",")), header)


def features_to_csv(g: VisibilityGraph) -> DataFrame:
    names = sorted(g.feature_names())
    line = F.concat_ws(",", F.col("node").cast("string"), *(F.coalesce(_number(F.col(c)), F.lit("")) for c in names))
    return _lines(g.nodes, ["node"], line, F.lit(",".join(["node", *names])))


def to_dot(g: VisibilityGraph, label: Column | None = None) -> DataFrame:
    """series_id, text: Graphviz, nodes with features as tooltips or with ``label``, a column over the nodes."""
    kind, arrow = ("digraph", "->") if g.directed else ("graph", "--")
    tip = F.array_join(F.transform(F.map_entries(_features(g)), lambda x: F.format_string("%s=%.2f", x["key"], x["value"])), "\\n")
    name = F.coalesce(label.cast("string"), F.col("node").cast("string")) if label is not None else F.col("node").cast("string")
    node = F.concat(F.lit("  "), F.col("node").cast("string"), F.lit(' [label="'), F.regexp_replace(name, '"', '\\\\"'), F.lit('"'), F.when(tip != "", F.concat(F.lit(', tooltip="'), tip, F.lit('"'))).otherwise(""), F.lit("];"))
    edge = F.concat(F.format_string(f"  %d {arrow} %d", "src", "dst"), F.when(F.col("weight") != 1, F.format_string(' [label="%.2f"]', "weight")).otherwise(""), F.lit(";"))
    lines = g.nodes.select("series_id", F.lit(0).alias("part"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), node.alias("line")).union(g.edges.select("series_id", F.lit(1), "src", "dst", edge))
    text = _lines(lines, ["part", "a", "b"], F.col("line"))
    return text.select("series_id", F.concat(F.lit(f"{kind} visibility_graph {{\n  rankdir=LR;\n"), F.col("text"), F.lit("\n}\n")).alias("text"))


def to_graphml(g: VisibilityGraph) -> DataFrame:
    """series_id, text: GraphML with nodes n0.., edges e0.. in order, weights and features as data."""
    names = sorted(g.feature_names())
    data = F.concat(*(F.coalesce(F.concat(F.lit(f'<data key="{c}">'), F.col(c).cast("string"), F.lit("</data>")), F.lit("")) for c in names)) if names else F.lit("")
    node = F.concat(F.format_string('    <node id="n%d">', "node"), data, F.lit("</node>"))
    number = F.row_number().over(Window.partitionBy("series_id").orderBy("src", "dst")) - 1
    edge = F.concat(F.format_string('    <edge id="e%d" source="n%d" target="n%d"><data key="weight">', number, "src", "dst"), F.col("weight").cast("string"), F.lit("</data></edge>"))
    lines = g.nodes.select("series_id", F.lit(0).alias("part"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), node.alias("line")).union(g.edges.select("series_id", F.lit(1), "src", "dst", edge))
    keys = "".join(f'  <key id="{c}" for="node" attr.name="{c}" attr.type="double"/>\n' for c in names)
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n  <key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n{keys}  <graph id="G" edgedefault="{"directed" if g.directed else "undirected"}">\n'
    return _lines(lines, ["part", "a", "b"], F.col("line")).select("series_id", F.concat(F.lit(head), F.col("text"), F.lit("\n  </graph>\n</graphml>\n")).alias("text"))


def to_npy(g: VisibilityGraph) -> DataFrame:
    """series_id, edges, adjacency, degrees: numpy files as binary, one graph for each row.

    Matrices are made from edges, one at a time, and handed on by ``FILES`` bytes.
    """
    edges = g.edges.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "weight"))).alias("e"))
    nodes = g.nodes.groupBy("series_id").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    joined = nodes.join(edges, "series_id", "left").select("series_id", "nodes", "e.src", "e.dst", "e.weight")
    schema = T.StructType([joined.schema["series_id"], *(T.StructField(c, T.BinaryType()) for c in ("edges", "adjacency", "degrees"))])
    directed = g.directed

    def packed(x: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.save(out, x.astype(float, copy=False))
        return out.getvalue()

    def files(nodes, src, dst, weight) -> tuple[bytes, bytes, bytes]:
        n = len(nodes)
        matrix, degree = np.zeros((n, n)), np.bincount(np.searchsorted(nodes, src if directed else np.concatenate([src, dst])), minlength=n)
        kept = dst < n
        matrix[np.searchsorted(nodes, src[kept]), dst[kept]] = weight[kept]
        return packed(np.column_stack([src, dst, weight])), packed(matrix), packed(degree)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            held, size, first = [], 0, 0
            for k in range(batch.num_rows):
                held.append(files(*(np.zeros(0, np.int64) if not x.is_valid else x.values.to_numpy(zero_copy_only=False) for x in (batch.column(c)[k] for c in range(1, 5)))))
                size += sum(map(len, held[-1]))
                if size > FILES or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), *(pa.array(c, pa.binary()) for c in zip(*held, strict=True))], names=schema.names)
                    held, size, first = [], 0, k + 1

    return joined.mapInArrow(run, schema)


def npy_values(column: str) -> Column:
    """The numbers of a numpy file in a binary column, row after row."""

    @F.pandas_udf("array<double>")
    def values(files: pd.Series) -> pd.Series:
        return files.map(lambda x: np.load(io.BytesIO(x)).ravel())

    return values(column)


def _ranges(df: DataFrame, *order: str) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _of_series(df: DataFrame, series: Iterable | None) -> DataFrame:
    return df if series is None else df.filter(F.col("series_id").isin(list(series)))


def write_parquet(g: VisibilityGraph, path: str) -> None:
    """series_id, source, target, weight, in ranges."""
    _ranges(edge_list(g), "series_id", "source", "target").write.parquet(path)


def read_parquet(spark: SparkSession, path: str, series: Iterable | None = None) -> DataFrame:
    """Edges that ``write_parquet`` wrote, of all series or of some."""
    return _of_series(spark.read.parquet(path), series)


def write_edges_csv(g: VisibilityGraph, path: str, include_weights: bool = True) -> None:
    _ranges(edge_list(g, include_weights), "series_id", "source", "target").write.option("header", True).csv(path)


def features_table(g: VisibilityGraph) -> DataFrame:
    """series_id, node and the features, in the order of their names."""
    return g.nodes.select("series_id", "node", *sorted(g.feature_names()))


def write_features_csv(g: VisibilityGraph, path: str) -> None:
    """The table of features with a header; a missing value is an empty cell."""
    _ranges(features_table(g), "series_id", "node").write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, like: DataFrame, series: Iterable | None = None) -> DataFrame:
    """A table that was written as CSV, with the columns of ``like``; a cell that doesn't fit fails the query."""
    return _of_series(spark.read.schema(like.schema).option("mode", "FAILFAST").csv(path, header=True), series)


def write_text(text: DataFrame, path: str) -> None:
    """Texts from ``to_dot``, ``to_graphml`` and the like in ranges of series: a line is a JSON object of series_id and text."""
    column = next(c for c in text.columns if c != "series_id")
    _ranges(text.select("series_id", F.col(column).alias("text")), "series_id").write.json(path)


def read_text(spark: SparkSession, path: str, like: DataFrame, series: Iterable | None = None) -> DataFrame:
    schema = T.StructType([like.schema["series_id"], T.StructField("text", T.StringType())])
    return _of_series(spark.read.schema(schema).option("mode", "FAILFAST").json(path), series)


def write_hdf5(g: VisibilityGraph, path: str) -> None:
    """A file of one graph, where h5py is installed: edges, adjacency, degrees and counts. The driver gathers it."""
    import h5py

    edges = g.edges.orderBy("series_id", "src", "dst").toPandas()
    degrees = g.degrees().orderBy("series_id", "node").toPandas()
    if edges["series_id"].nunique() > 1:
        raise ValueError("a file holds one graph")
    with h5py.File(path, "w") as f:
        for c in ("src", "dst", "weight"):
            f[f"edges/{c}"] = edges[c].to_numpy()
        f["graph/degrees"] = degrees["degree"].to_numpy()
        f["metadata"] = [len(degrees), len(edges), int(g.directed)]


EXPORTS = {"json": to_json, "edge_list_csv": to_edge_list_csv, "adjacency_csv": to_adjacency_csv, "features_csv": features_to_csv, "dot": to_dot, "graphml": to_graphml, "npy": to_npy}


def export(g: VisibilityGraph, form: str, **options) -> DataFrame:
    if form not in EXPORTS:
        raise ValueError(f"no form {form!r}; there are {', '.join(EXPORTS)}")
    return EXPORTS[form](g, **options)
