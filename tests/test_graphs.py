"""Graphs against brute force, hand-made values and properties."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.errors import GraphError
from sightline.operators import clustering, community, compare, degree, far, local, matrix, motifs, paths, trees, visibility
from sightline.operators.graph import VisibilityGraph, of_edges
from sightline.operators.statistics import graph_statistics, summary
from sightline.sources.series import points

from . import oracle

FIXED = {
    "S4": [1, 3, 2, 4], "S5": [1, 3, 2, 4, 1], "S6": [1, 3, 2, 4, 1, 3], "S7": [1, 3, 2, 4, 1, 3, 2], "INC": [1, 2, 3, 4], "FLAT": [2, 2, 2, 2], "DBG": [1, 2, 1.5, 3, 2.5],
    "ADV": [1, 4, 2, 5, 3, 6], "GRP-B": [2, 1, 3, 2, 4], "GRP-C": [3, 2, 1, 2, 3], "HVX": [5, 1, 2, 5], "BETW": [1, 1, 2, 3, 1], "ONE": [7],
    "REG": [0, 7.45519227399028, 0, 3.0858230846813965, 0],
}
NATURAL = {"S5": "01 12 13 23 34", "ADV": "01 12 13 23 34 35 45", "GRP-B": "01 02 12 23 24 34", "GRP-C": "01 03 04 12 13 14 23 34", "HVX": "01 02 03 12 13 23", "INC": "01 12 23", "FLAT": "01 12 23"}
HORIZONTAL = {"GRP-C": "01 04 12 13 23 34", "HVX": "01 02 03 12 23"}
REFERENCE = {"GRP-C": "01 12 13 23 34", "HVX": "01 02 12 23"}


def pairs(text):
    return {(int(p[0]), int(p[1])) for p in text.split()}


def random_series(seed, count=60):
    rng = random.Random(seed)
    return {f"r{k}": [rng.choice([rng.uniform(-10, 10), float(rng.randint(0, 3))]) for _ in range(rng.randint(2, 40))] for k in range(count)}


@pytest.fixture(scope="module")
def series(spark):
    every = FIXED | random_series(3)
    rows = [(s, i, float(i), float(v)) for s, vs in every.items() for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "series_id string, idx long, t double, value double").persist()
    return every, df


@pytest.fixture(scope="module")
def graph(series):
    return VisibilityGraph.from_series(series[1]).natural_visibility().persist()


def by_series(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.series_id, set()).add(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


@pytest.mark.parametrize(("build", "brute"), [
    (lambda s: visibility.natural(s, strategy="sql"), None), (lambda s: visibility.natural(s, strategy="kernel"), None),
    (lambda s: visibility.horizontal(s, strategy="sql"), oracle.horizontal), (lambda s: visibility.horizontal(s, strategy="kernel"), oracle.horizontal),
    (lambda s: visibility.horizontal(s, mode="reference"), oracle.horizontal_reference),
])
def test_edges_against_brute_force(series, build, brute):
    every, df = series
    got = by_series(build(df), "src", "dst")
    for name, v in every.items():
        if brute is None:  # by slopes, as the operator compares them
            want = {(j, i) for j in range(len(v)) for i in range(j + 1, len(v)) if all((v[k] - v[j]) / (k - j) < (v[i] - v[j]) / (i - j) for k in range(j + 1, i))}
        else:
            want = brute(v)
        assert got.get(name, set()) == want, name


def test_fixed_edge_lists(series):
    _, df = series
    for build, want in ((visibility.natural, NATURAL), (visibility.horizontal, HORIZONTAL), (lambda s: visibility.horizontal(s, mode="reference"), REFERENCE)):
        got = by_series(build(df), "src", "dst")
        assert {k: got[k] for k in want} == {k: pairs(v) for k, v in want.items()}


@given(st.lists(st.floats(-100, 100, width=32), min_size=2, max_size=60))
@settings(max_examples=150, deadline=None)
def test_kernels_and_properties(values):
    v = np.array(values, float)
    n = len(v)
    nvg = {(i, int(j)) for i, js in visibility.natural_of(v) for j in js}
    hvg = {(i, int(j)) for i, js in visibility.horizontal_of(v) for j in js}
    assert hvg == oracle.horizontal(values)
    assert {(i, i + 1) for i in range(n - 1)} <= oracle.horizontal_reference(values) <= hvg
    assert len(nvg) <= n * (n - 1) / 2 and all(a < b for a, b in nvg)
    assert {(n - 1 - b, n - 1 - a) for a, b in ((i, int(j)) for i, js in visibility.horizontal_of(v[::-1]) for j in js)} == hvg


@given(st.lists(st.integers(-50, 50), min_size=2, max_size=40), st.integers(-5, 5), st.sampled_from([1, 2, 4]))
@settings(max_examples=100, deadline=None)
def test_natural_edges_stay_under_shift_and_scale(values, shift, scale):
    edges = lambda x: {(i, int(j)) for i, js in visibility.natural_of(np.array(x, float)) for j in js}
    assert edges(values) == edges([scale * x + shift for x in values])


def test_weights(series):
    _, df = series
    for name, f in {"absdiff": lambda i, j, a, b: abs(b - a), "distance": lambda i, j, a, b: j - i, "geomean": lambda i, j, a, b: abs(a * b) ** 0.5}.items():
        rows = visibility.natural(df.filter("series_id = 'S5'"), name).collect()
        v = FIXED["S5"]
        assert all(r.weight == pytest.approx(f(r.src, r.dst, v[r.src], v[r.dst])) for r in rows)
    rows = visibility.natural(df.filter("series_id = 'S4'"), lambda i, j, a, b: (i + j) * 1.0).collect()
    assert all(r.weight == r.src + r.dst for r in rows)
    for bad in ({"weight": "no"}, {"strategy": "no"}):
        with pytest.raises(GraphError):
            visibility.natural(df, **bad)
    with pytest.raises(GraphError):
        visibility.horizontal(df, mode="no")


def test_missing_values_fail(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 1.0, None), ("a", 2, 2.0, 1.0)], "series_id string, idx long, t double, value double")
    for strategy in ("sql", "kernel"):
        with pytest.raises(Exception, match="impute first"):
            visibility.natural(df, strategy=strategy).collect()


def test_accessors(graph):
    def one(df):
        return df.filter("series_id = 'S5'")

    assert {r.neighbor for r in one(graph.neighbors(1)).collect()} == {0, 2, 3}
    assert [r.has_edge for r in one(graph.has_edge(3, 1)).collect()] == [True]
    assert [r.has_edge for r in one(graph.has_edge(0, 4)).collect()] == [False]
    assert {r.node: r.degree for r in one(graph.degrees()).collect()} == {0: 1, 1: 3, 2: 2, 3: 3, 4: 1}
    assert {(r.node_count, r.edge_count) for r in one(graph.counts()).collect()} == {(5, 5)}
    rows = {r.row: r.entries for r in one(graph.adjacency_rows()).collect()}
    assert rows[1] == [0, 0, 1, 1, 0] and rows[4] == [0] * 5
    directed = VisibilityGraph(graph.nodes, graph.edges, True)
    assert {r.node: r.degree for r in one(directed.degrees()).collect()} == {0: 1, 1: 2, 2: 1, 3: 1, 4: 0}
    assert not {r.has_edge for r in one(directed.has_edge(3, 1)).collect()} - {False}
    assert of_edges(graph.edges).degrees().count() == graph.degrees().filter("series_id <> 'ONE'").count()


METRICS = {
    "S5": (0.5, 0.8, 1.521928, 0.333333, 0.428571, 1.6, 3, 2, -0.5625), "S6": (0.466667, 0.888889, 1.792481, 0.611111, 0.5, 1.666667, 3, 2, -0.4),
    "GRP-C": (0.8, 0.56, 1.521928, 0.866667, 0.789474, 1.2, 2, 1, -0.548387), "S7": (0.380952, 1.061224, 1.950212, 0.428571, 0.428571, 1.904762, 4, 2, -0.333333),
}


def test_statistics(graph):
    stats = graph_statistics(graph)
    rows = {r.series_id: r for r in stats.collect()}
    entropy = {r.series_id: r.degree_entropy for r in degree.degree_entropy(graph).collect()}
    for name, want in METRICS.items():
        r = rows[name]
        got = (r.density, r.degree_variance, entropy[name], r.average_clustering, r.global_clustering, r.average_path_length, r.diameter, r.radius, r.assortativity)
        assert got == pytest.approx(want, abs=1e-6), name
    assert all(r.is_connected and r.num_components == 1 and 0 <= r.density <= 1 for r in rows.values())
    assert len(rows) == len(FIXED) + 60 and rows["ONE"].edge_count == 0
    assert "node_count: 5" in {r.series_id: r.line for r in summary(stats).collect()}["S5"]
    b = compare.batch_statistics(stats).first()
    assert b.num_graphs == len(rows) and b.avg_edges == pytest.approx(sum(r.edge_count for r in rows.values()) / len(rows))


def test_degree_tables(graph):
    hist = {(r.degree, r.nodes) for r in degree.degree_histogram(graph).filter("series_id = 'S5'").collect()}
    assert hist == {(0, 0), (1, 2), (2, 1), (3, 2)}
    assert {(r.degree, r.nodes) for r in degree.degree_distribution(graph).filter("series_id = 'S5'").collect()} == hist - {(0, 0)}
    assert {r.node: r.degree_centrality for r in degree.degree_centrality(graph).filter("series_id = 'S5'").collect()}[1] == 0.75


def test_clustering_nodes(graph):
    got = {r.node: r.clustering for r in clustering.node_clustering(graph).filter("series_id = 'GRP-C'").collect()}
    assert [got[k] for k in range(5)] == pytest.approx([1, 2 / 3, 1, 2 / 3, 1])


def test_distances_against_brute_force(series, graph):
    every, _ = series
    got = {}
    for r in paths.distances(graph).collect():
        got.setdefault(r.series_id, {})[r.source, r.target] = r.hops
    edges = by_series(graph.edges, "src", "dst")
    for name, v in every.items():
        assert got[name] == {(s, t): d for s, ds in oracle.distances(len(v), edges.get(name, set())).items() for t, d in ds.items()}
    assert {r.series_id: r.hops for r in paths.shortest_path_length(graph, 0, 4).collect()}["S5"] == 3
    assert {r.series_id: r.hops for r in paths.shortest_path_length(graph, 0, 400).collect()}["S5"] is None


CENTRAL = {"S5": [0, 0.5, 0, 0.5, 0], "S6": [0, 0.4, 0, 0.6, 0, 0], "S7": [0, 0.333333, 0, 0.6, 0, 0.333333, 0], "GRP-C": [0, 0.166667, 0, 0.166667, 0]}
CLOSE = {"S5": [0.5, 0.8, 0.666667, 0.8, 0.5], "GRP-C": [0.8, 1, 0.666667, 1, 0.8]}


def test_centralities(graph):
    for variant in ("brandes", "reference"):
        got = {(r.series_id, r.node): r.betweenness for r in paths.betweenness(graph, variant).collect()}
        for name, want in (CENTRAL | {"BETW": [1 / 6, 0, 1 / 6, 0.5 if variant == "brandes" else 0.458333, 0]}).items():
            assert [got[name, k] for k in range(len(want))] == pytest.approx(want, abs=1e-6), (variant, name)
    close = {(r.series_id, r.node): r.closeness for r in paths.closeness(paths.node_paths(graph, False)).collect()}
    for name, want in CLOSE.items():
        assert [close[name, k] for k in range(len(want))] == pytest.approx(want, abs=1e-6)
    assert close["ONE", 0] == 0


def test_components_of_two_parts(spark):
    edges = spark.createDataFrame([("x", 0, 1), ("x", 2, 3), ("x", 3, 4)], "series_id string, src long, dst long")
    g = of_edges(edges)
    assert {r.node: r.component for r in paths.connected_components(g).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}
    assert tuple(paths.component_stats(g).first())[1:] == (2, 3)
    assert not paths.path_stats(paths.node_paths(g)).first().is_connected


def test_communities_and_modularity(graph):
    found = community.detect_communities(graph, method="sequential")
    got = {(r.series_id, r.node): r.community for r in found.collect()}
    assert [got["S6", k] for k in range(6)] == [0, 0, 0, 0, 1, 1] and [got["S7", k] for k in range(7)] == [0, 0, 0, 0, 1, 1, 1]
    for variant, want in (("reference", {"S5": -0.5, "S6": -0.234694, "S7": -0.15625}), ("standard", {"S5": 0, "S6": 0.122449, "S7": 0.21875})):
        q = {r.series_id: r.modularity for r in community.modularity(graph, found, variant).collect()}
        assert {k: q[k] for k in want} == pytest.approx(want, abs=1e-6)
        assert all(-1 <= x <= 1 for x in q.values())
    sizes = {(r.community, r["size"]) for r in community.community_sizes(found).filter("series_id = 'S6'").collect()}
    assert sizes == {(0, 4), (1, 2)}
    assert {r.node for r in community.community_nodes(found, 1).filter("series_id = 'S6'").collect()} == {4, 5}


def test_searches_by_joins(series):
    """From all nodes of some graphs, more than 64 of one, directed and in pieces, as within a task."""
    few = series[1].filter("series_id in ('S7', 'r1', 'ONE')").union(series[1].filter("series_id in ('r2', 'r3', 'r4')").select(F.lit("both"), (F.row_number().over(Window.orderBy("series_id", "idx")) - 1).cast("long"), "t", "value"))
    g = VisibilityGraph.from_series(few).natural_visibility().persist()
    pieces = of_edges(g.edges.filter("src div 5 = dst div 5"))
    for own in (g, VisibilityGraph(g.nodes, g.edges, directed=True), pieces):
        sources = own.nodes.select("series_id", F.col("node").alias("source"))
        want = by_series(paths.distances(own), "source", "target", "hops")
        ends = {(r.series_id, r.node) for r in own.nodes.collect()}
        want = {k: {x for x in v if (k, x[0]) in ends} for k, v in want.items()}
        assert by_series(paths.distances_from(own, sources), "source", "target", "hops") == want
        sums = by_series(paths.node_paths(own, betweenness=False), "node", "eccentricity", "reached", "hops")
        assert by_series(paths.sums_from(own, sources), "node", "eccentricity", "reached", "hops") == {k: {x for x in v if (k, x[0]) in ends} for k, v in sums.items()}


def moved_by_definition(n, edges):
    """Rounds of local moving, node by node, with two levels."""
    def moves(nodes, links, degree, rounds):
        home, twice = {k: k for k in nodes}, sum(degree.values())
        for k in range(rounds):
            to = {}
            for x in nodes:
                if x % 3 != k % 3:
                    continue
                gains = []
                for c in {home[x], *(home[y] for y in links[x])}:
                    total = sum(degree[y] for y in nodes if home[y] == c and y != x)
                    gains.append((twice * sum(w for y, w in links[x].items() if home[y] == c) - degree[x] * total, c == home[x], -c))
                to[x] = -max(gains)[2]
            home |= to
        order = sorted(set(home.values()), key=lambda c: min(x for x in nodes if home[x] == c))
        return {x: order.index(home[x]) for x in nodes}

    links = {k: {} for k in range(n)}
    for a, b in edges:
        links[a][b] = links[b][a] = 1
    degree = {k: len(links[k]) for k in links}
    first = moves(list(range(n)), links, degree, 12)
    folded = {c: {} for c in set(first.values())}
    for a in links:
        for b in links[a]:
            if first[a] != first[b]:
                folded[first[a]][first[b]] = folded[first[a]].get(first[b], 0) + 1
    second = moves(sorted(folded), folded, {c: sum(degree[x] for x in first if first[x] == c) for c in folded}, 6)
    return {x: second[first[x]] for x in first}


def test_communities_by_rounds(series, graph):
    every, _ = series
    found = community.detect_communities(graph).persist()
    got = by_series(found, "node", "community")
    for k, vs in every.items():
        assert dict(got[k]) == moved_by_definition(len(vs), oracle.natural(vs)), k
    before = community.modularity(graph, community.detect_communities(graph, method="sequential"), "standard").agg(F.avg("modularity")).first()[0]
    assert community.modularity(graph, found, "standard").agg(F.avg("modularity")).first()[0] >= before


def test_communities_by_joins(series):
    few = series[1].filter("series_id in ('S6', 'ADV', 'ONE', 'r1', 'r2', 'r3')")
    g = VisibilityGraph.from_series(few).natural_visibility().persist()
    assert by_series(community.detect_communities(g, strategy="long"), "node", "community") == by_series(community.detect_communities(g), "node", "community")


def test_motifs(series, graph):
    every, _ = series
    three = {}
    for r in motifs.motifs3(graph).collect():
        three.setdefault(r.series_id, []).append((r.n_edges, r["count"]))
    want = {"S5": [1, 4, 4, 1], "S6": [2, 10, 6, 2], "GRP-C": [0, 1, 4, 5], "S7": [7, 18, 8, 2]}
    assert {k: [c for _, c in sorted(three[k])] for k in want} == want
    edges = by_series(graph.edges, "src", "dst")
    four = {}
    for r in motifs.motifs4(graph).collect():
        four.setdefault(r.series_id, {})[r.n_edges] = r["count"]
    from itertools import combinations

    for name in ("S5", "S7", "r1", "r2"):
        n, counts = len(every[name]), [0] * 7
        for nodes in combinations(range(n), 4):
            counts[sum(p in edges[name] for p in combinations(nodes, 2))] += 1
        assert [four[name][k] for k in range(7)] == counts
    share = {(r.series_id, r.motif): r.percent for r in motifs.frequencies(motifs.motifs3(graph)).collect()}
    assert share["S5", "fork"] == pytest.approx(40)
    assert {r.series_id: r["count"] for r in motifs.most_frequent(motifs.motifs3(graph)).collect()}["S7"] == 18
    text = {r.series_id: r.text.split("\n") for r in motifs.summary(motifs.motifs3(graph)).collect()}
    assert text["S7"] == ["fork: 18 (51.42%)", "four_edges: 8 (22.85%)", "empty: 7 (20.00%)", "complete_triangle: 2 (5.71%)"] and text["ONE"][0] == "empty: 0 (0.00%)"
    z = motifs.motif_significance(graph, 3).filter("series_id = 'r1'").collect()
    assert len(z) == 4 and all(np.isfinite(r.z_score) for r in z)


def test_swaps_keep_degrees():
    graphs = [sorted((i, int(j)) for i, js in visibility.natural_of(np.array(v)) for j in js) for v in random_series(5, 12).values()]
    group = np.repeat(np.arange(12), [len(e) for e in graphs])
    src, dst = np.array([e for es in graphs for e in es]).T
    out = motifs.swapped(group, group % 3, src, dst)
    assert (out[0] < out[1]).all()
    changed = 0
    for k, edges in enumerate(graphs):
        own = list(zip(*(x[group == k].tolist() for x in out), strict=True))
        assert np.bincount(np.array(own).ravel()).tolist() == np.bincount(np.array(edges).ravel()).tolist() and len(set(own)) == len(edges)
        alone = motifs.swapped(np.zeros(len(edges), int), np.full(len(edges), k % 3), *np.array(edges).T)
        assert sorted(own) == sorted(zip(*(x.tolist() for x in alone), strict=True))
        changed += set(own) != set(edges)
    assert changed > 6


def test_four_nodes_of_a_long_series(spark):
    """A series of 10,000 samples, whose sets of four are far too many to list; pairs of hubs and small graphs are in the query's oracle."""
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(rng.normal(size=10_000))], "series_id string, idx long, value double")
    got = {r.n_edges: (r["count"], r.total) for r in motifs.motifs4(VisibilityGraph.from_series(df).natural_visibility().persist()).collect()}
    assert sum(c for c, _ in got.values()) == got[0][1] == 10_000 * 9_999 * 9_998 * 9_997 // 24 and all(c > 0 for c, _ in got.values())


def test_compare(graph, series):
    other = VisibilityGraph.from_series(series[1]).horizontal_visibility()
    got = {r.series_id: r for r in compare.compare(graph, other).collect()}
    assert got["S5"].edge_overlap == 1 and got["S5"].density_diff == 0
    assert got["GRP-C"].edge_overlap == pytest.approx(6 / 8)
    assert compare.batch({"a": series[1], "b": series[1]}).select("series_id").distinct().count() == 2 * len(series[0])


def test_matrices(graph, series):
    every, _ = series
    edges = by_series(graph.edges, "src", "dst")
    lap, eig = {}, {r.series_id: r.eigenvalue for r in matrix.dominant_eigenvalue(graph, 500).collect()}
    for r in matrix.laplacian(graph).collect():
        lap.setdefault(r.series_id, {})[r.row, r.col] = r.value
    energy = {r.series_id: r.graph_energy for r in matrix.graph_energy(graph).collect()}
    walk = {(r.series_id, r.node): r.probability for r in matrix.random_walk_stationary(graph, 3).collect()}
    for name in ("S5", "GRP-C", "r3", "r4"):
        n = len(every[name])
        a = np.zeros((n, n))
        for x, y in edges[name]:
            a[x, y] = a[y, x] = 1
        assert np.array([[lap[name].get((i, j), 0) for j in range(n)] for i in range(n)]) == pytest.approx(np.diag(a.sum(1)) - a)
        assert eig[name] == pytest.approx(np.linalg.eigvalsh(a)[-1], abs=1e-4)
        assert energy[name] == pytest.approx(np.trace(a @ a) ** 0.5)
        p = np.full(n, 1 / n)
        for _ in range(3):
            p = p @ (a / a.sum(1, keepdims=True))
        assert [walk[name, k] for k in range(n)] == pytest.approx(p)


def test_trees(series, graph):
    every, df = series
    g = VisibilityGraph.from_series(df).with_weight("absdiff").natural_visibility()
    mst = by_series(trees.minimum_spanning_tree(g), "src", "dst")
    some = VisibilityGraph(g.nodes, g.edges.filter("series_id in ('S5', 'S7', 'r1', 'r2', 'FLAT')"))
    assert by_series(trees.minimum_spanning_tree(some, strategy="long"), "src", "dst") == {k: mst[k] for k in ("S5", "S7", "r1", "r2", "FLAT")}
    for name, v in every.items():
        home = list(range(len(v)))
        kruskal = set()
        for a, b in sorted(oracle.natural(v), key=lambda e: (abs(v[e[1]] - v[e[0]]), e)):
            if home[a] != home[b]:
                kruskal.add((a, b))
                home = [home[a] if h == home[b] else h for h in home]
        assert mst.get(name, set()) == kruskal
    assert all(len(mst[name]) == len(v) - 1 for name, v in every.items() if len(v) > 1)
    assert all(len(oracle.distances(len(v), mst[name])[0]) == len(v) for name, v in every.items() if len(v) > 1)
    assert trees.lightest_edges(g).filter("series_id = 'S5'").count() == 4
    hops = {(r.series_id, r.target): r.hops for r in paths.distances(graph).filter("source = 0").collect()}
    assert {(r.series_id, r.node): r.distance for r in paths.dijkstra(graph).collect()} == {k: v for k, v in hops.items() if k[0] != "ONE"}
    order = by_series(trees.topological_sort(graph), "node", "position")["S5"]
    assert order == {(k, k) for k in range(5)} and trees.strongly_connected_components(graph).select(F.countDistinct("series_id", "component")).first()[0] == graph.nodes.count()


def test_batch_summary(graph):
    text = compare.batch_summary(compare.batch_statistics(graph_statistics(graph))).first().text.split("\n")
    assert text[0] == f"num_graphs: {graph.nodes.select('series_id').distinct().count()}" and len(text) == 5 and text[1].startswith("avg_edges: ")


def test_both_kinds_in_one_pass(series):
    every, df = series
    found = visibility.natural_and_horizontal(df).collect()
    for name, v in every.items():
        own = {(r.src, r.dst): r.is_horizontal for r in found if r.series_id == name}
        assert set(own) == oracle.natural(v) and {e for e, h in own.items() if h} == oracle.horizontal(v)
    builder = VisibilityGraph.from_series(df)
    want = {r[0]: tuple(r[1:]) for r in compare.compare(builder.natural_visibility(), builder.horizontal_visibility()).collect()}
    got = {r[0]: tuple(r[1:]) for r in compare.compare_kinds(df).collect()}
    assert got.keys() == want.keys()
    for name in want:
        assert got[name] == pytest.approx(want[name])


def test_significance_sends_no_edges_to_the_driver(graph):
    """Triangles of the swapped graphs are counted where these are made, and no table of edges is broadcast."""
    want = {}
    for r in motifs.replicas(graph, 2, 3).collect():
        want.setdefault((r.series_id, r.replica), set()).add((r.src, r.dst))
    got = {(r.series_id, r.replica): r.t for r in motifs._replica_triangles(graph, 2, 3).collect()}
    assert got == {k: sum((a, c) in e for a, b in e for x, c in e if x == b) for k, e in want.items()} and sum(got.values()) > 20
    for df in (motifs.motif_significance(graph, 2), clustering.triangles(graph)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_searches_by_spans(spark, series, monkeypatch):
    """A graph of many spans takes no rounds, however far its nodes are apart; where there are too many gates, rounds find the same."""
    rng = np.random.default_rng(3)
    rows = [("chain", i, i + 1) for i in range(90)] + [("any", *sorted(rng.choice(60, 2, False).tolist())) for _ in range(70)] + [("star", 40, i) for i in range(41, 80)]
    made = of_edges(spark.createDataFrame(rows, "series_id string, src long, dst long").distinct())
    few = VisibilityGraph.from_series(series[1].filter("series_id in ('S7', 'r1', 'r2', 'ONE')")).natural_visibility().persist()
    rounds = paths.searches
    monkeypatch.setattr(far, "SPAN", 7)
    for own in (made, few):
        sources = own.nodes.filter("node % 3 <> 1").select("series_id", F.col("node").alias("source"))
        want = by_series(paths.distances(own).filter("source % 3 <> 1").join(own.nodes.select("series_id", F.col("node").alias("source")), ["series_id", "source"], "left_semi").join(own.nodes.select("series_id", F.col("node").alias("target")), ["series_id", "target"], "left_semi"), "source", "target", "hops")
        sums = {k: {(s, max(d for x, _, d in v if x == s), sum(x == s for x, _, _ in v) - 1, sum(d for x, _, d in v if x == s)) for s in {x for x, _, _ in v}} for k, v in want.items()}
        monkeypatch.setattr(paths, "searches", None)
        monkeypatch.setattr(far, "GATES", 1 << 20)
        assert by_series(paths.distances_from(own, sources), "source", "target", "hops") == want
        assert by_series(paths.sums_from(own, sources), "node", "eccentricity", "reached", "hops") == sums
    monkeypatch.setattr(paths, "searches", rounds)
    monkeypatch.setattr(far, "GATES", 1)
    assert by_series(paths.sums_from(few, sources), "node", "eccentricity", "reached", "hops") == sums


def test_searches_leave_tables_that_follow_the_input(spark, tmp_path, monkeypatch):
    """Four times the nodes and sources leave about four times the bytes of hops in tables; those of sources may go in parts, and like hops lie side by side in files."""
    monkeypatch.setattr(far, "SPAN", 16)
    real, left = far.stored, []
    for n, part in ((200, 1 << 23), (800, 1 << 23), (60, 40)):
        monkeypatch.setattr(far, "PART", part, raising=False)
        g = of_edges(spark.range(n - 1).selectExpr("'s' series_id", "id src", "id + 1 dst"))
        sources = spark.range(0, n, 2).selectExpr("'s' series_id", "id source")
        left.append(0)

        def stored(df, name="table"):
            out = real(df, name)
            hops = [F.sum(F.octet_length(c)) for c, kind in out.dtypes if kind == "binary"]
            left[-1] += sum(out.agg(*hops).first()) if hops else 0
            return out

        monkeypatch.setattr(far, "stored", stored)
        found = paths.distances_from(g, sources)
        bad = found.agg(F.count("*"), F.count_distinct("source", "target"), F.sum(F.expr("int(hops <> abs(source - target))"))).first()
        assert tuple(bad) == (n * n // 2, n * n // 2, 0)
        if n < 200:
            sums = {(r.node, r.eccentricity, r.reached) for r in paths.sums_from(g, sources).collect()}
            assert sums == {(s, max(s, n - 1 - s), n - 1) for s in range(0, n, 2)}
    assert left[1] < 6 * left[0]
    monkeypatch.undo()
    v = np.random.default_rng(5).random(12_000)
    one = VisibilityGraph.from_series(points(spark.createDataFrame(list(enumerate(v.tolist())), "t long, v double"), None, "t", "v")).natural_visibility()
    sources = one.nodes.filter("node % 10 = 0").select("series_id", F.col("node").alias("source"))
    paths.distances_from(one, sources).drop("series_id").write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 14_400_000 > 2 * sum(f.stat().st_size for f in (tmp_path / "pairs").iterdir())


def test_four_nodes_in_a_task_and_by_joins(graph, monkeypatch):
    """Series share batches of a kernel without a join of edges; those above the limit have the same counts by joins."""
    found = motifs.motifs4(graph)
    assert found._jdf.queryExecution().analyzed().toString().count("Join") == 1
    want = by_series(found, "motif", "count", "total")
    for limit in (0, 12):
        monkeypatch.setattr(local, "LARGE", limit)
        assert by_series(motifs.motifs4(graph), "motif", "count", "total") == want


def test_kinds_in_a_task_and_by_joins(spark, series, monkeypatch):
    """Triangles of both kinds are counted without a join of edges; graphs above the limit have the same figures by joins."""
    found = compare.compare_kinds(series[1])
    assert "Join" not in found._jdf.queryExecution().analyzed().toString()
    rows = lambda df: {r[0]: tuple(None if x is None else round(x, 9) for x in r[1:]) for r in df.collect()}
    want = rows(found)
    for limit in (0, 12):
        monkeypatch.setattr(local, "LARGE", limit)
        assert rows(compare.compare_kinds(series[1])) == want


def test_clustering_in_a_task_and_by_joins(graph, monkeypatch):
    """Triangles at nodes are counted without a join of edges; graphs above the limit have the same by joins."""
    found = clustering._closed(graph)
    assert "Join" not in found._jdf.queryExecution().analyzed().toString()
    want = by_series(found, "node", "links")
    for limit in (0, 12):
        monkeypatch.setattr(local, "LARGE", limit)
        assert by_series(clustering._closed(graph), "node", "links") == want


def _tasks_of_pairs(spark, monkeypatch, of):
    """Same edges as the kernel's, and the most pairs of a task, with series of 300 and of few samples."""
    monkeypatch.setattr(visibility, "PAIRS", 2000)
    monkeypatch.setattr(visibility, "SOURCES", 16)
    rng = np.random.default_rng(2)
    rows = [(f"s{k}", i, float(x)) for k, n in enumerate([300, *[20] * 60, 1]) for i, x in enumerate(rng.integers(0, 9, n))]
    series = spark.createDataFrame(rows, "series_id string, idx long, value double")
    assert {tuple(r) for r in of(series, strategy="sql").collect()} == {tuple(r) for r in of(series, strategy="kernel").collect()}
    pairs = visibility._pairs(series.select("series_id", "idx", F.col("value").alias("v")))
    return pairs.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()


def test_horizontal_pairs_of_a_task_are_bounded(spark, monkeypatch):
    total, most = _tasks_of_pairs(spark, monkeypatch, visibility.horizontal)
    assert total == 300 * 299 // 2 + 60 * 190 and most < 12_000


def test_natural_pairs_of_a_task_are_bounded(spark, monkeypatch):
    total, most = _tasks_of_pairs(spark, monkeypatch, visibility.natural)
    assert total == 300 * 299 // 2 + 60 * 190 and most < 12_000
