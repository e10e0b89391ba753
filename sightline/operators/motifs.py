"""Motifs of three and four nodes.

Sets of four nodes are counted by their edges without listing any. For each r the number of ways to choose r edges that lie within four
nodes comes in closed form from degrees, triangles at nodes and on edges, cycles of four and cliques of four;
inclusion and exclusion over r then gives the sets with exactly k edges. Cycles are counted at their
node of highest degree, so that hubs pair few of their neighbours.

Significance compares triples with graphs of the same degrees. Those come by rounds of double-edge swaps: in a round a hash of
(seed, replica, round, edge) orders a graph's edges and decides how neighbours in that order trade ends; a pair trades where the new edges join
four different nodes, are not there yet, and are wanted by no other pair. All pairs trade at once, so the result
depends on nothing but the graph. A series and replica is a row of its own, and many share a batch.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import local
from .clustering import triangles
from .graph import VisibilityGraph

#: Rounds of swaps, and the prime and factors of the hash that orders edges.
SWAPS, PRIME, FACTORS = 20, 2147483647, (7919, 104729, 1299709, 15485863, 32452843)
#: Names by number of edges among the nodes.
THREE = ("empty", "fork", "four_edges", "complete_triangle")
FOUR = ("empty", "two_edges", "four_edges", "6_edges", "8_edges", "10_edges", "12_edges")


def motifs3(g: VisibilityGraph) -> DataFrame:
    """series_id, motif, n_edges, count, total of the triples of an undirected graph, in closed form.

    From edges, pairs of edges at a node, and triangles: no triple is listed.
    """
    wedges = g.degrees().groupBy("series_id").agg(F.count("*").alias("n"), (F.sum("degree") / 2).cast("long").alias("e"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).cast("long").alias("w"))
    if g.directed:
        raise ValueError("motifs are counted in undirected graphs")
    t = triangles(g).groupBy("series_id").agg(F.count("*").alias("t"))
    s = wedges.join(t, "series_id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    s = s.withColumn("total", (F.col("n") * (F.col("n") - 1) * (F.col("n") - 2) / 6).cast("long")).withColumn("two", F.col("w") - 3 * F.col("t"))
    s = s.withColumn("one", F.col("e") * (F.col("n") - 2) - 2 * F.col("two") - 3 * F.col("t"))
    counts = [F.col("total") - F.col("one") - F.col("two") - F.col("t"), F.col("one"), F.col("two"), F.col("t")]
    rows = F.array(*(F.struct(F.lit(name).alias("motif"), F.lit(k).alias("n_edges"), c.cast("long").alias("count")) for k, (name, c) in enumerate(zip(THREE, counts, strict=True))))
    return s.select("series_id", F.explode(rows).alias("x"), "total").select("series_id", "x.*", "total")


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _choose(n: Column, k: int) -> Column:
    """Binomial coefficient of a whole number, exactly."""
    out = _whole(n)
    for j in range(1, k):
        out = _whole((out * _whole(n - j)) / _whole(F.lit(j + 1)))
    return out


def cliques4(g: VisibilityGraph, t: DataFrame) -> DataFrame:
    """series_id, a, b, c, d with a < b < c < d: pairs of triangles (of ``t``) on a first edge whose other corners are linked."""
    c, d = t, t.withColumnRenamed("c", "d")
    pairs = c.join(d, ["series_id", "a", "b"]).filter("c < d")
    return pairs.join(g.edges.select("series_id", F.col("src").alias("c"), F.col("dst").alias("d")), ["series_id", "c", "d"], "left_semi").select("series_id", "a", "b", "c", "d")


def cycles4(g: VisibilityGraph) -> DataFrame:
    """series_id, cycles: rings of four nodes, with or without chords."""
    ranked = g.degrees().select("series_id", "node", F.struct("degree", "node").alias("rank"))
    links = VisibilityGraph(g.nodes, g.edges).links().select("series_id", F.col("node").alias("v"), F.col("neighbor").alias("u"))
    links = links.join(ranked.select("series_id", F.col("node").alias("u"), F.col("rank").alias("u_rank")), ["series_id", "u"]).join(ranked.select("series_id", F.col("node").alias("v"), F.col("rank").alias("v_rank")), ["series_id", "v"])
    up = links.filter("u_rank > v_rank").select("series_id", "v", "u", "u_rank")
    wedges = up.join(links.select("series_id", "v", F.col("u").alias("w"), F.col("u_rank").alias("w_rank")), ["series_id", "v"]).filter("w_rank < u_rank")
    ways = wedges.groupBy("series_id", "u", "w").agg(F.count("*").alias("k")).filter("k > 1")
    return ways.groupBy("series_id").agg(F.sum(_choose(F.col("k"), 2)).alias("cycles"))


PARTS = ("e", "wedges", "stars", "triangles", "paws", "chains", "diamonds", "cycles", "cliques")


def _parts_by_joins(g: VisibilityGraph) -> DataFrame:
    """series_id, n and the counts ``PARTS`` of each graph with edges, for graphs that are too large for a task."""
    t = triangles(g)
    corners = t.select("series_id", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("series_id", "node").agg(F.count("*").alias("t"))
    nodes = g.degrees().join(corners, ["series_id", "node"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    d = F.col("degree")
    sums = nodes.groupBy("series_id").agg(
        F.count("*").alias("n"), _whole(F.sum(d) / 2).alias("e"), F.sum(_choose(d, 2)).alias("wedges"), F.sum(_choose(d, 3)).alias("stars"),
        _whole(F.sum("t") / 3).alias("triangles"), F.sum(_whole(F.col("t")) * _whole(d - 2)).alias("paws"),
    )
    ends = g.edges.select("series_id", "src", "dst").join(g.degrees().select("series_id", F.col("node").alias("src"), F.col("degree").alias("x")), ["series_id", "src"]).join(g.degrees().select("series_id", F.col("node").alias("dst"), F.col("degree").alias("y")), ["series_id", "dst"])
    chains = ends.groupBy("series_id").agg(F.sum(_whole(F.col("x") - 1) * _whole(F.col("y") - 1)).alias("chains"))
    sides = F.array(*(F.struct(F.col(i).alias("i"), F.col(j).alias("j")) for i, j in ("ab", "ac", "bc")))
    on_edge = t.select("series_id", F.explode(sides).alias("x")).groupBy("series_id", "x").agg(F.count("*").alias("k"))
    diamonds = on_edge.groupBy("series_id").agg(F.sum(_choose(F.col("k"), 2)).alias("diamonds"))
    cliques = cliques4(g, t).groupBy("series_id").agg(_whole(F.count("*")).alias("cliques"))
    s = sums.filter("e > 0")
    for part in (chains, diamonds, cycles4(g), cliques):
        s = s.join(part, "series_id", "left")
    return s.na.fill(0, ["chains", "diamonds", "cycles", "cliques"]).select("series_id", "n", *(_whole(F.col(k)).alias(k) for k in PARTS))


def _parts(g: VisibilityGraph) -> DataFrame:
    """The same in one task for each graph, many of which share a batch. Up to ``local.LARGE`` edges no count is beyond 2^63."""
    schema = T.StructType([g.edges.schema["series_id"], *(T.StructField(k, T.LongType()) for k in PARTS)])

    def run(group, src, dst):
        graph, _, of = local.united(group, src, dst)
        groups = int(group[-1]) + 1
        out = {k: np.zeros(groups, np.int64) for k in PARTS}
        by_rank, d = of[graph.node], graph.degree[graph.node]

        def add(k: str, where: np.ndarray, what: np.ndarray | None = None) -> None:
            np.add.at(out[k], where, 1 if what is None else what)

        corners, on_edge = np.zeros(graph.n, np.int64), np.zeros(len(src), np.int64)
        for e, f, h in graph.triangles():
            for x in (graph.lo[e], graph.hi[e], graph.hi[f]):
                corners += np.bincount(x, minlength=graph.n)
            for x in (e, f, h):
                on_edge += np.bincount(x, minlength=len(src))
            add("triangles", by_rank[graph.lo[e]])
        add("e", group)
        add("wedges", by_rank, d * (d - 1) // 2)
        add("stars", by_rank, d * (d - 1) // 2 * (d - 2) // 3)
        add("paws", by_rank, corners * (d - 2))
        add("chains", by_rank[graph.lo], (d[graph.lo] - 1) * (d[graph.hi] - 1))
        add("diamonds", by_rank[graph.lo], on_edge * (on_edge - 1) // 2)
        for x, k in graph.cycles():
            add("cycles", by_rank[x], k * (k - 1) // 2)
        for x in graph.cliques():
            add("cliques", by_rank[x])
        yield np.arange(groups), *out.values()

    found = local.mapped(local.arrays(g.edges, "src", "dst"), schema, run)
    n = g.nodes.groupBy("series_id").agg(F.count("*").alias("n"))
    return found.join(n.hint("merge"), "series_id").select("series_id", "n", *(_whole(F.col(k)).alias(k) for k in PARTS))


def motifs4(g: VisibilityGraph) -> DataFrame:
    """series_id, motif, n_edges, count, total of the sets of four nodes of an undirected graph with edges; null where a count is beyond 2^63.

    Graphs of up to ``local.LARGE`` edges are counted in a task each, larger ones by joins.
    """
    if g.directed:
        raise ValueError("motifs are counted in undirected graphs")
    few, large = local.divided(g.edges)
    if large is None:
        s = _parts(g)
    else:
        some = lambda ids: VisibilityGraph(g.nodes.join(ids, "series_id", "left_semi"), g.edges.join(ids, "series_id", "left_semi"))
        s = _parts(some(few)).union(_parts_by_joins(some(large)))
    n, c = F.col("n"), lambda k: _whole(F.col(k))
    ways = [
        _choose(n, 4), c("e") * _choose(n - 2, 2), c("wedges") * _whole(n - 3) + _choose(c("e"), 2) - c("wedges"),
        c("triangles") * _whole(n - 3) + c("stars") + c("chains") - 3 * c("triangles"), c("cycles") + c("paws"), c("diamonds"), c("cliques"),
    ]
    s = s.select("series_id", *(_whole(w).alias(f"w{k}") for k, w in enumerate(ways)))
    exact = [sum((_whole(F.lit((-1) ** (r - k) * comb(r, k)) * F.col(f"w{r}")) for r in range(k + 1, 7)), F.col(f"w{k}")) for k in range(7)]
    rows = F.array(*(F.struct(F.lit(name).alias("motif"), F.lit(k).alias("n_edges"), _whole(x).try_cast("long").alias("count")) for k, (name, x) in enumerate(zip(FOUR, exact, strict=True))))
    return s.select("series_id", F.explode(rows).alias("x"), F.col("w0").try_cast("long").alias("total")).select("series_id", "x.*", "total")


def edge_hash(src, dst, k: int, replica, seed: int):
    """A whole number below PRIME that orders the edges of a round; for arrays and single numbers."""
    x = (src * FACTORS[0] + dst * FACTORS[1] + k * FACTORS[2] + replica * FACTORS[3] + seed * FACTORS[4]) % PRIME
    y = x * x % PRIME
    return y * y % PRIME * x % PRIME


def swapped(group: np.ndarray, replica: np.ndarray, src: np.ndarray, dst: np.ndarray, rounds: int = SWAPS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Graphs of the same degrees; src < dst are the edges of several graphs (``group``, ascending) at once."""
    n = int(dst.max()) + 1
    place = np.arange(len(group)) - np.searchsorted(group, group)
    for k in range(rounds):
        h = edge_hash(src, dst, k, replica, seed)
        order = np.lexsort((dst, src, h, group))
        src, dst, h = src[order], dst[order], h[order]
        first = np.flatnonzero(place[:-1] % 2 == 0)
        first = first[group[first] == group[first + 1]]
        a, b, c, d = src[first], dst[first], src[first + 1], dst[first + 1]
        flip = h[first] % 2 == 1
        c, d = np.where(flip, d, c), np.where(flip, c, d)
        code = lambda g, x, y: (g * n + np.minimum(x, y)) * n + np.maximum(x, y)
        x, y = code(group[first], a, d), code(group[first], c, b)
        there = code(group, src, dst)
        fit = (a != c) & (a != d) & (b != c) & (b != d) & ~np.isin(x, there) & ~np.isin(y, there)
        first, x, y = first[fit], x[fit], y[fit]
        wanted, times = np.unique(np.concatenate([x, y]), return_counts=True)
        once = wanted[times == 1]
        alone = np.isin(x, once) & np.isin(y, once)
        first, x, y = first[alone], x[alone], y[alone]
        src[first], dst[first] = x % (n * n) // n, x % n
        src[first + 1], dst[first + 1] = y % (n * n) // n, y % n
    return src, dst


def _copies(g: VisibilityGraph, num_random: int) -> DataFrame:
    """series_id, replica, src, dst: the edges of each graph as arrays, a row for each replica."""
    rows = local.arrays(g.edges, "src", "dst")
    return rows.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(num_random - 1).cast("long"))).alias("replica"), "src", "dst")


def replicas(g: VisibilityGraph, num_random: int, seed: int = 0) -> DataFrame:
    """series_id, replica, src, dst: graphs of the same degrees as ``g``."""
    schema = T.StructType([g.edges.schema["series_id"], T.StructField("replica", T.LongType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])

    def run(group, replica, src, dst):
        yield group, replica[group], *swapped(group, replica[group], src, dst, seed=seed)

    return local.mapped(_copies(g, num_random), schema, run, 1)


def _replica_triangles(g: VisibilityGraph, num_random: int, seed: int) -> DataFrame:
    """series_id, replica, t: triangles of each of ``replicas``, counted where the swaps are made."""
    schema = T.StructType([g.edges.schema["series_id"], T.StructField("replica", T.LongType()), T.StructField("t", T.LongType())])

    def run(group, replica, src, dst):
        graph, _, of = local.united(group, *swapped(group, replica[group], src, dst, seed=seed))
        t = np.zeros(len(replica), np.int64)
        for e, _, _ in graph.triangles():
            t += np.bincount(of[graph.node[graph.lo[e]]], minlength=len(t))
        yield np.arange(len(replica)), replica, t

    return local.mapped(_copies(g, num_random), schema, run, 1)


def motif_significance(g: VisibilityGraph, num_random: int, seed: int = 0) -> DataFrame:
    """series_id, motif, z_score of three-node motifs against graphs of the same degrees; 0 where these do not vary.

    The triples of such graphs differ by their triangles alone.
    """
    found = _replica_triangles(g, num_random, seed)
    sums = found.groupBy("series_id").agg(F.sum("t").alias("t"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    own = triangles(g).groupBy("series_id").agg(F.count("*").alias("own"))
    all_ = g.edges.select("series_id").distinct().join(own.hint("merge"), "series_id", "left").join(sums.hint("merge"), "series_id", "left").na.fill(0, ["own", "t", "tt"])
    mean = F.col("t") / num_random
    # Whole numbers up to the root, so that no variation is exactly 0.
    varied = (num_random * F.col("tt") - F.col("t") * F.col("t")).cast("long")
    z = F.when(varied > 0, F.try_divide(F.col("own") - mean, F.sqrt(varied.cast("double")) / num_random)).otherwise(0.0)
    rows = F.array(*(F.struct(F.lit(name).alias("motif"), (sign * F.col("z")).alias("z_score")) for name, sign in zip(THREE, (-1, 1, -1, 1), strict=True)))
    return all_.withColumn("z", z).select("series_id", F.explode(rows).alias("x")).select("series_id", "x.*")


def most_frequent(motifs: DataFrame) -> DataFrame:
    return motifs.groupBy("series_id").agg(F.max_by("motif", F.struct("count", "n_edges")).alias("motif"), F.max("count").alias("count"))


def frequencies(motifs: DataFrame) -> DataFrame:
    """In percent of all subgraphs."""
    return motifs.select("series_id", "motif", F.when(F.col("total") > 0, F.try_divide(F.col("count") * 100.0, F.col("total"))).otherwise(0.0).alias("percent"))


def summary(motifs: DataFrame) -> DataFrame:
    """series_id, text: a line for each motif, the most frequent first, with its share (cut to hundredths of a percent)."""
    share = F.expr("(cast(count as decimal(25,0)) * 10000) div greatest(total, 1)")
    line = F.concat(F.col("motif"), F.lit(": "), F.col("count").cast("string"), F.lit(" ("), F.expr("share div 100").cast("string"), F.lit("."), F.lpad((F.col("share") % 100).cast("string"), 2, "0"), F.lit("%)"))
    lines = motifs.withColumn("share", share).select("series_id", F.struct((-F.col("count")).alias("order"), "n_edges", line.alias("line")).alias("x"))
    return lines.groupBy("series_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select("series_id", F.array_join(F.col("x.line"), "\n").alias("text"))
