"""Graphs of many series in one task: the graphs of a batch are one graph in numpy, whose parts are not linked.

Edges are directed from the end of lower degree to the other, so a node has few successors even where hubs
have many neighbours; memory is the edges of a part and blocks of ``CELLS`` paths of two edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Edges of series that are worked on together; paths of two edges that are formed together; edges up to which a series' graph is left to one task.
TOGETHER, CELLS, LARGE = 1 << 18, 1 << 20, 1 << 20


def _spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers first, first + 1, .. (``counts`` of them), with the rows they belong to."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]


def _blocks(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of rows whose sizes add up to ``CELLS``, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        yield slice(at, to)
        at = to


class Graph:
    """An undirected graph; ``lo`` and ``hi`` are its edges by the rank of their ends, ``at`` their places among those given."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray):
        self.n, self.degree = n, np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        self.node = np.argsort(self.degree, kind="stable")
        rank = np.empty(n, np.int64)
        rank[self.node] = np.arange(n)
        x, y = rank[a], rank[b]
        code = np.minimum(x, y) * n + np.maximum(x, y)
        self.at = np.argsort(code)
        self.code = code[self.at]
        self.lo, self.hi = self.code // n, self.code % n
        self.first = np.searchsorted(self.lo, np.arange(n + 1))
        self.out = np.diff(self.first)

    def edge(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each edge, and whether it is there."""
        code = lo * self.n + hi
        k = np.minimum(np.searchsorted(self.code, code), max(len(self.code) - 1, 0))
        return k, self.code[k] == code

    def triangles(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each triangle once, as places of its edges: lowest to middle, middle to highest, lowest to highest corner."""
        counts = self.out[self.hi]
        for part in _blocks(counts):
            e, f = _spread(self.first[self.hi[part]], counts[part])
            e += part.start
            g, there = self.edge(self.lo[e], self.hi[f])
            yield e[there], f[there], g[there]

    def cliques(self) -> Iterator[np.ndarray]:
        """The lowest corner of each set of four nodes that are all linked."""
        for e, f, _ in self.triangles():
            x, y, z = self.lo[e], self.lo[f], self.hi[f]
            counts = self.out[z]
            for part in _blocks(counts):
                row, k = _spread(self.first[z[part]], counts[part])
                w, row = self.hi[k], row + part.start
                yield x[row[self.edge(x[row], w)[1] & self.edge(y[row], w)[1]]]

    def cycles(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes with k common neighbours below the higher one, as (that node, k): k (k - 1) / 2 rings of four each."""
        a, b = np.concatenate([self.lo, self.hi]), np.concatenate([self.hi, self.lo])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.searchsorted(a, np.arange(self.n + 1))
        down = a > b  # from a node to those below it, by node
        u, v = a[down], b[down]
        per_node = np.bincount(u, weights=np.diff(first)[v], minlength=self.n).astype(np.int64)
        begin = np.searchsorted(u, np.arange(self.n + 1))
        for nodes in _blocks(per_node):
            own = slice(begin[nodes.start], begin[nodes.stop])
            row, k = _spread(first[v[own]], np.diff(first)[v[own]])
            top, w = u[own][row], b[k]
            pair, times = np.unique((top * self.n + w)[w < top], return_counts=True)
            yield (pair // self.n)[times > 1], times[times > 1]


def arrays(df: DataFrame, *columns: str) -> DataFrame:
    """series_id and an array of each of ``columns``, in one order."""
    return df.groupBy("series_id").agg(*(F.collect_list(c).alias(c) for c in columns))


def mapped(rows: DataFrame, schema: T.StructType, function: Callable[..., Iterator[tuple[np.ndarray, ...]]], plain: int = 0) -> DataFrame:
    """``function`` makes pieces of (row, columns of ``schema`` but the series_id) of the arrays of some rows.

    It gets the row of each element, then ``plain`` columns with a value for each row, then the elements of arrays. Arrays of a row have one length.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(1 + plain).value_lengths().to_numpy()
            ends, begin = np.cumsum(counts), 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TOGETHER, "right")))
                part = batch.slice(begin, end - begin)
                values = [part.column(c).to_numpy() if c <= plain else part.column(c).flatten().to_numpy(zero_copy_only=False) for c in range(1, batch.num_columns)]
                for k, *out in function(np.repeat(np.arange(end - begin), counts[begin:end]), *values):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(k)), *(pa.array(c, f.type) for c, f in zip(out, list(arrow)[1:], strict=True))], schema=arrow)
                begin = end

    return rows.mapInArrow(run, schema)


def united(group: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graphs of ``group`` (ascending) as one, with the first node of each, and the group of each node."""
    sizes = np.zeros(int(group[-1]) + 1, np.int64)
    np.maximum.at(sizes, group, np.maximum(src, dst) + 1)
    base = np.cumsum(sizes) - sizes
    return Graph(int(sizes.sum()), src + base[group], dst + base[group]), base, np.repeat(np.arange(len(sizes)), sizes)


def divided(edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """series_id of the graphs of up to ``LARGE`` edges, each small enough for a task, and of those above; None where there are none above, and no list is needed."""
    sizes = edges.groupBy("series_id").agg(F.count("*").alias("edges"))
    large = sizes.filter(F.col("edges") > LARGE).select("series_id")
    if large.isEmpty():
        return None, None
    return sizes.filter(F.col("edges") <= LARGE).select("series_id"), large
