"""Shortest paths, components and centralities.

Each graph of many is searched in one task, as blocks of sources times sorted edges (or a matrix, of a small
graph) in numpy; memory is a block of sources times the edges, whatever the number of pairs, and results leave by blocks.

A graph that is too large for a task is searched from given sources by joins (``searches``): each node has a set of
sources that have reached it, 64 to a number, and a round sends what is new to the neighbours. All sources move together, and a
table holds each round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..scratch import stored
from . import far
from .graph import VisibilityGraph
from .running import numbered

#: Sources searched together; nodes of a graph that is held as a matrix; numbers that are worked on together; rows handed on together; sources whose hops to a target stand side by side.
BLOCK, DENSE, CELLS, ROWS, TOGETHER = 128, 512, 1 << 21, 100_000, 256


class Search:
    """Breadth-first searches of one graph from blocks of sources."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, directed: bool):
        a, b = (src, dst) if directed else (np.concatenate([src, dst]), np.concatenate([dst, src]))
        order = np.argsort(b, kind="stable")
        self.n, self.tail, head = n, a[order], b[order]
        self.into, self.first = np.unique(head, return_index=True)
        order = np.argsort(a, kind="stable")
        self.head, tail = b[order], a[order]
        self.out_of, self.first_out = np.unique(tail, return_index=True)
        self.matrix = None
        if n <= DENSE:
            self.matrix = np.zeros((n, n))
            np.add.at(self.matrix, (a, b), 1.0)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Sums of x over the predecessors of each node."""
        if self.matrix is not None:
            return x @ self.matrix
        out = np.zeros_like(x)
        if len(self.tail):
            out[:, self.into] = np.add.reduceat(x[:, self.tail], self.first, axis=1)
        return out

    def backward(self, x: np.ndarray) -> np.ndarray:
        """Sums of x over the successors of each node."""
        if self.matrix is not None:
            return x @ self.matrix.T
        out = np.zeros_like(x)
        if len(self.head):
            out[:, self.out_of] = np.add.reduceat(x[:, self.head], self.first_out, axis=1)
        return out

    def distances(self, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hops (-1: not reached) and numbers of shortest paths, for each source and node."""
        dist = np.full((len(sources), self.n), -1, np.int32)
        paths = np.zeros((len(sources), self.n))
        row = np.arange(len(sources))
        dist[row, sources], paths[row, sources] = 0, 1
        d, edge = 0, paths.copy()
        while edge.any():
            d += 1
            edge = self.forward(edge)
            edge[dist >= 0] = 0
            dist[edge > 0] = d
            paths += edge
        return dist, paths

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, self.n, BLOCK):
            sources = np.arange(at, min(self.n, at + BLOCK))
            yield sources, *self.distances(sources)

    def dependencies(self, dist: np.ndarray, paths: np.ndarray) -> np.ndarray:
        """Share of each source's shortest paths that pass a node (Brandes)."""
        delta = np.zeros_like(paths)
        safe = np.where(paths > 0, paths, 1)
        for d in range(int(dist.max()), 0, -1):
            part = np.where(dist == d, (1 + delta) / safe, 0)
            delta += np.where(dist == d - 1, self.backward(part) * paths, 0)
        return delta

    def half_dependencies(self, dist: np.ndarray, paths: np.ndarray) -> np.ndarray:
        """For each source s and node v, the sum over targets t past v of paths(s, v) / paths(s, t).

        The paths from v to t are not counted in; the pair (v, t) counts once wherever a shortest path from s to t passes v. What lies past
        a node is the set of its successors one step further from the source, and of what lies past these: sets of bits, level by level.
        """
        out, words = np.zeros_like(paths), -(-self.n // 64)
        own = np.zeros((self.n, words), np.uint64)
        own[np.arange(self.n), np.arange(self.n) >> 6] = np.uint64(1) << (np.arange(self.n) & 63).astype(np.uint64)
        step = max(1, CELLS // max(self.n * self.n, len(self.head) * words))
        for at in range(0, len(dist), step):
            far, ways = dist[at : at + step], paths[at : at + step]
            past = np.zeros((len(far), self.n, words), np.uint64)
            for d in range(int(far.max()), 0, -1):
                x = np.where((far == d)[:, :, None], past | own, 0)
                met = np.zeros_like(past)
                met[:, self.out_of] = np.bitwise_or.reduceat(x[:, self.head], self.first_out, axis=1)
                past = np.where((far == d - 1)[:, :, None], met, past)
            bits = np.unpackbits(past.view(np.uint8), axis=2, bitorder="little")[:, :, : self.n]
            share = np.where(ways > 0, 1 / np.where(ways > 0, ways, 1), 0)
            out[at : at + step] = ways * (bits.astype(float) @ share[:, :, None])[:, :, 0]
        return out


def _search(src: np.ndarray, dst: np.ndarray, directed: bool) -> Search:
    return Search(int(max(src.max(), dst.max())) + 1, src, dst, directed)


def _with_key(g: VisibilityGraph, *fields: T.StructField) -> T.StructType:
    return T.StructType([g.edges.schema["series_id"], *fields])


def _by_series(g: VisibilityGraph, schema: T.StructType, function, weighted: bool = False) -> DataFrame:
    """``function`` makes pieces of columns (without the series_id) of a series' src, dst (and weight); many series share a batch."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0

            def out() -> pa.RecordBatch:
                k, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), *(pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

            for k in range(batch.num_rows):
                for piece in function(*(batch.column(c)[k].values.to_numpy() for c in range(1, batch.num_columns))):
                    held.append((np.full(len(piece[0]), k), *piece))
                    size += len(piece[0])
                    if size > ROWS:
                        yield out()
                        held, size = [], 0
            if size:
                yield out()

    arrays = g.edges.groupBy("series_id").agg(*(F.collect_list(c).alias(c) for c in ("src", "dst", *(["weight"] if weighted else []))))
    return arrays.mapInArrow(run, schema)


def distances(g: VisibilityGraph) -> DataFrame:
    """series_id, source, target, hops of every pair that is connected, a node and itself included."""
    schema = _with_key(g, T.StructField("source", T.LongType()), T.StructField("target", T.LongType()), T.StructField("hops", T.IntegerType()))
    directed = g.directed

    def run(src, dst):
        for sources, dist, _ in _search(src, dst, directed).blocks():
            s, t = np.nonzero(dist >= 0)
            for at in range(0, len(s), ROWS):
                i, j = s[at : at + ROWS], t[at : at + ROWS]
                yield sources[i], j, dist[i, j]

    single = g.nodes.filter("node = 0").join(g.edges.select("series_id").distinct(), "series_id", "left_anti").select("series_id", F.col("node").alias("source"), F.col("node").alias("target"), F.lit(0).alias("hops"))
    return _by_series(g, schema, run).union(single)


def shortest_path_length(g: VisibilityGraph, source: int, target: int) -> DataFrame:
    """series_id, hops; null where there is no path or no such node. One search for each series."""
    schema = _with_key(g, T.StructField("hops", T.IntegerType()))
    directed = g.directed

    def run(src, dst):
        s = _search(src, dst, directed)
        hops = None
        if source < s.n and target < s.n:
            found = int(s.distances(np.array([source]))[0][0, target])
            hops = found if found >= 0 else None
        yield (np.array([hops], object),)

    return _by_series(g, schema, run)


NODE_FIELDS = [
    ("eccentricity", T.LongType()), ("reached", T.LongType()), ("hops", T.LongType()),
    ("later", T.LongType()), ("later_hops", T.LongType()), ("later_most", T.LongType()), ("first", T.LongType()),
    ("betweenness", T.DoubleType()), ("betweenness_reference", T.DoubleType()),
]


def node_paths(g: VisibilityGraph, betweenness: bool = True, reference: bool = False) -> DataFrame:
    """One row for each node of what its searches add up to: eccentricity, nodes reached and
    hops to them; the same over later nodes only; the first node it reaches; betweenness, over (n-1)(n-2)."""
    schema = _with_key(g, T.StructField("node", T.LongType()), *(T.StructField(k, t) for k, t in NODE_FIELDS))
    directed = g.directed

    def run(src, dst):
        s = _search(src, dst, directed)
        n, parts, through, half = s.n, [], np.zeros(s.n), np.zeros(s.n)
        for sources, dist, paths in s.blocks():
            far = np.where(dist > 0, dist, 0)
            later = far * (np.arange(n)[None, :] > sources[:, None])
            parts.append(np.column_stack([sources, far.max(1), (far > 0).sum(1), far.sum(1), (later > 0).sum(1), later.sum(1), later.max(1), (dist >= 0).argmax(1)]))
            if betweenness:
                delta = s.dependencies(dist, paths)
                delta[np.arange(len(sources)), sources] = 0
                through += delta.sum(0)
            if reference:
                delta = s.half_dependencies(dist, paths)
                delta[np.arange(len(sources)), sources] = 0
                half += delta.sum(0)
        over = max(1, (n - 1) * (n - 2))
        yield (*np.concatenate(parts).astype(np.int64).T, through / over, half / over)

    names = [k for k, _ in NODE_FIELDS]
    found = _by_series(g, schema, run)
    zero = g.nodes.filter("node = 0").join(g.edges.select("series_id").distinct(), "series_id", "left_anti").select("series_id", "node", *(F.lit(0).cast(t).alias(k) for k, t in NODE_FIELDS))
    return found.select("series_id", "node", *names).union(zero)


def path_stats(nodes: DataFrame) -> DataFrame:
    """From ``node_paths``: series_id, average_path_length (over connected i < j), diameter, radius, is_connected."""
    first = F.max(F.when(F.col("node") == 0, F.col("reached")))
    sums = nodes.groupBy("series_id").agg(F.sum("later").alias("pairs"), F.sum("later_hops").alias("hops"), F.max("later_most").alias("diameter"), F.min("eccentricity").alias("radius"), first.alias("first"), F.count("*").alias("n"))
    return sums.select("series_id", F.when(F.col("pairs") > 0, F.try_divide(F.col("hops"), F.col("pairs"))).otherwise(0.0).alias("average_path_length"), "diameter", "radius", (F.col("first") == F.col("n") - 1).alias("is_connected"))


def closeness(nodes: DataFrame) -> DataFrame:
    return nodes.select("series_id", "node", F.when(F.col("hops") > 0, F.try_divide(F.col("reached"), F.col("hops"))).otherwise(0.0).alias("closeness"))


def betweenness(g: VisibilityGraph, variant: str = "brandes") -> DataFrame:
    """series_id, node, betweenness; ``reference`` leaves the paths behind a node uncounted."""
    reference = variant == "reference"
    column = "betweenness_reference" if reference else "betweenness"
    return node_paths(g, not reference, reference).select("series_id", "node", F.col(column).alias("betweenness"))


def connected_components(g: VisibilityGraph) -> DataFrame:
    """series_id, node, component, numbered by smallest node; of a directed graph by what each start still reaches."""
    schema = _with_key(g, T.StructField("node", T.LongType()), T.StructField("component", T.LongType()))
    directed = g.directed

    def run(src, dst):
        n = int(max(src.max(), dst.max())) + 1
        out: list[list[int]] = [[] for _ in range(n)]
        for a, b in zip(src.tolist(), dst.tolist(), strict=True):
            out[a].append(b)
            if not directed:
                out[b].append(a)
        label, found = [-1] * n, 0
        for start in range(n):
            if label[start] >= 0:
                continue
            label[start], todo = found, [start]
            while todo:
                for b in out[todo.pop()]:
                    if label[b] < 0:
                        label[b] = found
                        todo.append(b)
            found += 1
        yield np.arange(n), np.array(label)

    single = g.nodes.filter("node = 0").join(g.edges.select("series_id").distinct(), "series_id", "left_anti").select("series_id", "node", F.lit(0).cast("long").alias("component"))
    return _by_series(g, schema, run).union(single)


def component_stats(g: VisibilityGraph) -> DataFrame:
    """series_id, num_components, largest_component_size."""
    sizes = connected_components(g).groupBy("series_id", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("series_id").agg(F.count("*").alias("num_components"), F.max("n").alias("largest_component_size"))


def dijkstra(g: VisibilityGraph, start: int = 0) -> DataFrame:
    """series_id, node, distance by edge weights from ``start``, of what it reaches."""
    schema = _with_key(g, T.StructField("node", T.LongType()), T.StructField("distance", T.DoubleType()))
    directed = g.directed

    def run(src, dst, weight):
        out: dict[int, list[tuple[int, float]]] = {}
        for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
            out.setdefault(a, []).append((b, w))
            if not directed:
                out.setdefault(b, []).append((a, w))
        done: dict[int, float] = {}
        heap = [(0.0, start)]
        while heap:
            d, k = heapq.heappop(heap)
            if k in done:
                continue
            done[k] = d
            for b, w in out.get(k, ()):
                if b not in done:
                    heapq.heappush(heap, (d + w, b))
        yield np.array(list(done)), np.array(list(done.values()))

    return _by_series(g, schema, run, weighted=True)


def searches(g: VisibilityGraph, sources: DataFrame) -> DataFrame:
    """series_id, block, hops, node, bits: where each search of ``sources`` (series_id, source) arrives, over all tasks.

    Sources are numbered within their series; number 64 block + k is bit k. Each search arrives at a node once. A
    row stands for up to 64 searches, so all nodes are held for as many rows as there are blocks of sources.
    """
    own = stored(numbered(sources.select("series_id", "source").distinct(), ["source"], "no", "series_id"), "sources")
    links = stored(g.links().select("series_id", "node", F.col("neighbor").alias("to")), "links")
    bit = F.expr("shiftleft(1L, cast(no % 64 as int))")
    now = own.groupBy("series_id", F.expr("no div 64").alias("block"), F.col("source").alias("node")).agg(F.bit_or(bit).alias("bits"))
    now = stored(now.select("series_id", "block", F.lit(0).alias("hops"), "node", "bits"), "arrivals")
    out, seen, hops = now, now.drop("hops"), 0
    while not now.isEmpty():
        hops += 1
        sent = now.join(links, ["series_id", "node"]).groupBy("series_id", "block", F.col("to").alias("node")).agg(F.bit_or("bits").alias("bits"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        now = sent.join(seen.withColumnRenamed("bits", "old"), ["series_id", "block", "node"], "left").select("series_id", "block", F.lit(hops).alias("hops"), "node", new.alias("bits"))
        now = stored(now.filter("bits <> 0"), "arrivals")
        out = out.union(now)
        seen = stored(seen.union(now.drop("hops")).groupBy("series_id", "block", "node").agg(F.bit_or("bits").alias("bits")), "seen")
    numbers = own.select("series_id", "source", F.expr("no div 64").alias("block"), (F.col("no") % 64).cast("int").alias("bit"))
    return out.join(numbers.groupBy("series_id", "block").agg(F.sort_array(F.collect_list(F.struct("bit", "source"))).alias("own")), ["series_id", "block"])


def _arrived() -> Column:
    """Whether the search of ``bit`` is among ``bits``."""
    return F.expr("shiftright(bits, bit) & 1L = 1L")


def distances_from(g: VisibilityGraph, sources: DataFrame) -> DataFrame:
    """series_id, source, target, hops of what the given sources reach: ``distances`` of a graph that is too large for a task."""
    def pairs(who, at, targets, d):
        # Target by target, so that files stay small: of like sources side by side hops are the same, and the same sources recur.
        for i in range(0, len(who), TOGETHER):
            s, row = who[i : i + TOGETHER], at[i : i + TOGETHER]
            step = max(1, far.ROWS // len(s))
            for j in range(0, len(targets), step):
                t, hops = targets[j : j + step], d[:, j : j + step].T[:, row]
                near = hops < far.NEVER
                if near.all():
                    yield np.tile(s, len(t)), np.repeat(t, len(s)), hops.ravel()
                else:
                    j_, i_ = np.nonzero(near)
                    yield s[i_], t[j_], hops[near]

    sources = stored(sources.select("series_id", "source").distinct(), "asked")
    found = far.from_sources(g, sources, "source bigint, target bigint, hops int", pairs)
    if found is not None:
        alone = sources.join(g.links().select("series_id", F.col("node").alias("source")), ["series_id", "source"], "left_anti")
        return found.union(alone.select("series_id", "source", "source", F.lit(0)))
    each = searches(g, sources).select("series_id", "node", "hops", "bits", F.inline("own"))
    return each.filter(_arrived()).select("series_id", "source", F.col("node").alias("target"), "hops")


def _sums_by_rounds(g: VisibilityGraph, sources: DataFrame) -> DataFrame:
    counts = [F.sum(F.expr(f"shiftright(bits, {k}) & 1L")).alias(f"n{k}") for k in range(64)]
    rounds = searches(g, sources).groupBy("series_id", "block", "own", "hops").agg(*counts)
    each = rounds.select("series_id", "hops", F.array(*(f"n{k}" for k in range(64))).alias("n"), F.inline("own"))
    each = each.select("series_id", "source", "hops", F.get("n", F.col("bit")).alias("k")).filter("k > 0 and hops > 0")
    return each.groupBy("series_id", "source").agg(F.max("hops").cast("long").alias("eccentricity"), F.sum("k").alias("reached"), F.sum(F.col("k") * F.col("hops")).alias("hops"))


def sums_from(g: VisibilityGraph, sources: DataFrame) -> DataFrame:
    """series_id, node, eccentricity, reached, hops of the given sources, as ``node_paths`` has them (so ``closeness`` takes them)."""
    def sums(who, at, targets, d):
        d = np.where(d < far.NEVER, d, 0)
        yield who, d.max(axis=1)[at], (d > 0).sum(axis=1)[at], d.sum(axis=1, dtype=np.int64)[at]

    sources = stored(sources.select("series_id", "source").distinct(), "asked")
    found = far.from_sources(g, sources, "source bigint, eccentricity bigint, reached bigint, hops bigint", sums, 4 * sources.sparkSession.sparkContext.defaultParallelism)
    if found is not None:
        found = found.groupBy("series_id", "source").agg(F.max("eccentricity").alias("eccentricity"), F.sum("reached").alias("reached"), F.sum("hops").alias("hops"))
    else:
        found = _sums_by_rounds(g, sources)
    every = sources.select("series_id", "source").distinct().join(found, ["series_id", "source"], "left")
    return every.select("series_id", F.col("source").alias("node"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("eccentricity", "reached", "hops")))
