"""Communities and modularity.

Communities come by synchronous local moving. Nodes are coloured by their number modulo COLOURS; in each round the nodes of one
colour go at once to the neighbouring community of greatest gain, where that is more than staying gains. With
m edges, t ties to a community of total degree D and a node of degree d the gain is 2m t - d D (D without the node), a whole
number, so every order of summing gives the same communities. Of equal gains the community with the smallest
number is taken. After ROUNDS[0] rounds communities become nodes, numbered in the order of their first
samples and linked by the edges between them, and move on for ROUNDS[1] rounds.

Graphs of many short series are moved by a kernel, many series in one batch of arrays. A graph
that is too large for a task (``strategy="long"``) is moved by joins on (series, node) and (series, community), a table for each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GraphError
from ..scratch import stored
from .graph import VisibilityGraph
from .running import numbered

COLOURS, ROUNDS = 3, (12, 6)
#: Passes of the sequential rule, and edges that are worked on together.
PASSES, EDGES = 100, 1 << 18


def _joined_series(g: VisibilityGraph) -> DataFrame:
    """The nodes that are alone in their series."""
    return g.nodes.filter("node = 0").join(g.edges.select("series_id").distinct(), "series_id", "left_anti").select("series_id", "node", F.lit(0).cast("long").alias("community"))


def local_moving(group: np.ndarray, number: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, d: np.ndarray, rounds: int) -> np.ndarray:
    """Community (a node's place) of nodes 0..n-1, of several graphs (``group``) at once.

    ``number`` is a node's number in its graph; a, b, w are links from both ends; d the nodes' degrees.
    """
    n, home = len(d), np.arange(len(d))
    twice = np.bincount(group, d).astype(np.int64)[group]
    for k in range(rounds):
        out = number[a] % COLOURS == k % COLOURS
        movers = np.flatnonzero(number % COLOURS == k % COLOURS)
        key, at = np.unique(np.concatenate([a[out] * n + home[b[out]], movers * n + home[movers]]), return_inverse=True)
        ties = np.bincount(at, np.concatenate([w[out], np.zeros(len(movers), np.int64)])).astype(np.int64)
        node, to = key // n, key % n
        total = np.bincount(home, d, minlength=n).astype(np.int64)
        own = to == home[node]
        gain = twice[node] * ties - d[node] * (total[to] - own * d[node])
        order = np.lexsort((-to, own, gain, node))
        last = order[np.append(node[order][1:] != node[order][:-1], True)] if len(order) else order
        home[node[last]] = to[last]
    return home


def _ranks(home: np.ndarray) -> np.ndarray:
    """Numbers of communities in the order of their first nodes."""
    _, first, at = np.unique(home, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[at]


def _number_in_group(group: np.ndarray) -> np.ndarray:
    return np.arange(len(group)) - np.searchsorted(group, group)


def _of_batch(sizes: np.ndarray, src: np.ndarray, dst: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Community in its series of each node of several graphs, laid end to end."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    shift = np.repeat(np.cumsum(sizes) - sizes, edges)
    a, b = np.concatenate([src + shift, dst + shift]), np.concatenate([dst + shift, src + shift])
    w, d = np.ones(len(a), np.int64), np.bincount(a, minlength=len(group))
    rank = _ranks(local_moving(group, _number_in_group(group), a, b, w, d, ROUNDS[0]))
    n = int(rank.max()) + 1
    of_rank = np.zeros(n, np.int64)
    of_rank[rank] = group
    apart = rank[a] != rank[b]
    key, w = np.unique(rank[a][apart] * n + rank[b][apart], return_counts=True)
    home = local_moving(of_rank, _number_in_group(of_rank), key // n, key % n, w, np.bincount(rank, d, minlength=n).astype(np.int64), ROUNDS[1])
    final = _ranks(home)
    first = np.full(len(sizes), n)
    np.minimum.at(first, of_rank, final)
    return (final - first[of_rank])[rank]


def _by_kernel(g: VisibilityGraph, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = batch.column(1).value_lengths().to_numpy()
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(np.cumsum(edges[begin:]), EDGES, "right")) + begin)
                part = batch.slice(begin, end - begin)
                src, dst = (part.column(c).flatten().to_numpy() for c in (1, 2))
                n, counts = part.column(3).to_numpy(), edges[begin:end]
                found = _of_batch(n, src, dst, counts)
                at = np.repeat(np.arange(len(n)), n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(_number_in_group(at)), pa.array(found)], names=schema.names)
                begin = end

    arrays = g.edges.groupBy("series_id").agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"), (F.max(F.greatest("src", "dst")) + 1).alias("n"))
    return arrays.mapInArrow(run, schema)


def _moves(state: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """series_id, node, c after so many rounds; of state (series_id, node, c, d, number) and links (series_id, node, nb, w, number)."""
    twice = state.groupBy("series_id").agg(F.sum("d").alias("twice"))
    for k in range(rounds):
        turn = F.col("number") % COLOURS == k % COLOURS
        total = state.groupBy("series_id", "c").agg(F.sum("d").alias("total"))
        movers = state.filter(turn)
        near = links.filter(turn).select("series_id", "node", "nb", "w").join(state.select("series_id", F.col("node").alias("nb"), "c"), ["series_id", "nb"]).select("series_id", "node", "c", "w")
        ties = near.union(movers.select("series_id", "node", "c", F.lit(0).cast("long"))).groupBy("series_id", "node", "c").agg(F.sum("w").alias("t"))
        known = ties.join(total, ["series_id", "c"]).join(movers.select("series_id", "node", F.col("c").alias("own"), "d"), ["series_id", "node"]).join(twice, "series_id")
        stays = F.col("c") == F.col("own")
        gain = F.col("twice") * F.col("t") - F.col("d") * (F.col("total") - F.when(stays, F.col("d")).otherwise(0))
        best = known.groupBy("series_id", "node").agg(F.max(F.struct(gain.alias("gain"), stays.alias("stays"), (-F.col("c")).alias("to"))).alias("best")).select("series_id", "node", (-F.col("best.to")).alias("to"))
        state = stored(state.join(best, ["series_id", "node"], "left").select("series_id", "node", F.coalesce("to", "c").alias("c"), "d", "number"), "moves")
    return state


def _by_joins(g: VisibilityGraph) -> DataFrame:
    links = stored(VisibilityGraph(g.nodes, g.edges).links().select("series_id", "node", F.col("neighbor").alias("nb"), F.lit(1).cast("long").alias("w"), F.col("node").alias("number")), "links")
    state = stored(links.groupBy("series_id", "node").agg(F.count("*").alias("d")).select("series_id", "node", F.col("node").alias("c"), "d", F.col("node").alias("number")), "moves")
    state = _moves(state, links, ROUNDS[0])
    # Communities as nodes, in the order of their first samples.
    ranks = numbered(state.groupBy("series_id", "c").agg(F.min("node").alias("first"), F.sum("d").alias("d")), ["first"], "rank", "series_id")
    of_node = stored(state.select("series_id", "node", "c").join(ranks.select("series_id", "c", "rank"), ["series_id", "c"]).select("series_id", "node", "rank"), "ranks")
    ends = links.select("series_id", "node", "nb").join(of_node.withColumnRenamed("rank", "a"), ["series_id", "node"]).join(of_node.withColumnsRenamed({"rank": "b", "node": "nb"}), ["series_id", "nb"])
    folded = stored(ends.filter("a <> b").groupBy("series_id", "a", "b").agg(F.count("*").alias("w")).select("series_id", F.col("a").alias("node"), F.col("b").alias("nb"), "w", F.col("a").alias("number")), "links")
    state = _moves(stored(ranks.select("series_id", F.col("rank").alias("node"), F.col("rank").alias("c"), "d", F.col("rank").alias("number")), "moves"), folded, ROUNDS[1])
    final = numbered(state.groupBy("series_id", "c").agg(F.min("node").alias("first")), ["first"], "community", "series_id").join(state.select("series_id", "c", F.col("node").alias("rank")), ["series_id", "c"])
    return of_node.join(final.select("series_id", "rank", "community"), ["series_id", "rank"]).select("series_id", "node", "community")


def detect_communities(g: VisibilityGraph, method: str = "synchronous", strategy: str = "auto") -> DataFrame:
    """series_id, node, community, numbered from 0 in the order of their first samples.

    ``method`` sequential is the one-level rule instead: nodes are visited in order, up to PASSES times, and go to the
    neighbouring community of greatest gain where that is above zero; of equals to the one with the largest number. It
    runs in a task for each series, and numbers communities in the order of these numbers.
    """
    schema = T.StructType([g.edges.schema["series_id"], T.StructField("node", T.LongType()), T.StructField("community", T.LongType())])
    if method not in ("synchronous", "sequential"):
        raise GraphError(f"no method {method!r}; there are synchronous and sequential")
    if method == "synchronous":
        return (_by_joins(g) if strategy == "long" else _by_kernel(g, schema)).union(_joined_series(g))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m = int(max(pdf["src"].max(), pdf["dst"].max())) + 1, len(pdf)
        near: list[list[int]] = [[] for _ in range(n)]
        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
            near[a].append(b)
            near[b].append(a)
        home = list(range(n))
        for _ in range(PASSES):
            moved = False
            for k in range(n):
                ties: dict[int, int] = {}
                for b in near[k]:
                    ties[home[b]] = ties.get(home[b], 0) + 1
                own = ties.get(home[k], 0)
                cost = len(near[k]) ** 2 / (4 * m * m)
                best = max(((t - own) / (2 * m) - cost, c) for c, t in ties.items() if c != home[k]) if any(c != home[k] for c in ties) else (0.0, home[k])
                if best[0] > 0:
                    home[k], moved = best[1], True
            if not moved:
                break
        number = {c: i for i, c in enumerate(sorted(set(home)))}
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "node": range(n), "community": [number[c] for c in home]})

    return g.edges.groupBy("series_id").applyInPandas(lambda pdf: run(pdf), schema).union(_joined_series(g))


def modularity(g: VisibilityGraph, communities: DataFrame, variant: str = "reference") -> DataFrame:
    """series_id, modularity of ``communities`` (series_id, node, community).

    ``standard`` is inside/m - (degrees/2m)^2 summed over communities; ``reference``
    takes half of the first term.
    """
    c = communities.select("series_id", "node", "community")
    ends = g.edges.join(c.withColumnsRenamed({"node": "src", "community": "x"}), ["series_id", "src"]).join(c.withColumnsRenamed({"node": "dst", "community": "y"}), ["series_id", "dst"])
    inside = ends.filter("x = y").groupBy("series_id", F.col("x").alias("community")).agg(F.count("*").alias("inside"))
    degrees = g.degrees().join(c, ["series_id", "node"]).groupBy("series_id", "community").agg(F.sum("degree").alias("d"))
    m = g.counts().select("series_id", F.col("edge_count").alias("m"))
    both = degrees.join(inside, ["series_id", "community"], "left").join(m, "series_id").withColumn("inside", F.coalesce("inside", F.lit(0)))
    # Whole numbers up to the one division, so the order of the sum makes no difference.
    part = (2 if variant == "reference" else 4) * F.col("m") * F.col("inside") - F.col("d") * F.col("d")
    total = F.try_divide(F.sum(part).cast("double"), (4 * F.max("m") * F.max("m")).cast("double"))
    return both.groupBy("series_id").agg(F.coalesce(total, F.lit(0.0)).alias("modularity"))


def community_nodes(communities: DataFrame, community: int) -> DataFrame:
    return communities.filter(F.col("community") == community)


def community_sizes(communities: DataFrame) -> DataFrame:
    return communities.groupBy("series_id", "community").agg(F.count("*").alias("size"))
