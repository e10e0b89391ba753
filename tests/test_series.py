"""Sources, imputation, features, windows, signals, sinks and streams."""

import io
import json
import xml.dom.minidom

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.errors import ImputationError, SeriesError
from sightline.functions import features, impute, signal, vector
from sightline.functions import sql as sqlfns
from sightline.operators import visibility, windows
from sightline.operators.graph import VisibilityGraph
from sightline.sources import generators, series, sinks
from sightline.streaming import visibility as streaming

GAP5 = [1, None, 3, None, 2]
S5 = [1, 3, 2, 4, 1]


def values(df, column="value"):
    return [r[column] for r in df.orderBy("idx").collect()]


def test_points_and_errors(spark):
    df = spark.createDataFrame([(2.0, 5.0, "A"), (1.0, 4.0, "A"), (1.0, None, "B")], "time double, reading double, sensor string")
    got = {(r.series_id, r.idx): (r.t, r.value) for r in series.points(df, "sensor", "time", "reading", "time").collect()}
    assert got == {("A", 0): (1.0, 4.0), ("A", 1): (2.0, 5.0), ("B", 0): (1.0, None)}
    assert {(r.series_id, r.n, r.n_valid) for r in series.lengths(series.points(df, "sensor", "time", "reading")).collect()} == {("A", 2, 2), ("B", 1, 0)}
    for bad in (lambda: series.points(df, "sensor", "time", "none"), lambda: series.points(df, None, "time", "sensor"), lambda: series.from_values(spark, []), lambda: series.from_values(spark, [1], times=[1, 2]), lambda: series.from_csv_string(spark, "")):
        with pytest.raises(SeriesError):
            bad()


def test_arrays(spark):
    df = series.from_values(spark, GAP5)
    assert series.to_arrays(df).first()["values"] == GAP5 and series.to_arrays(df, False).first()["values"] == [1, 3, 2]
    back = series.to_numpy(series.from_array(spark, np.array([1, np.nan, 2])))
    assert back[[0, 2]].tolist() == [1, 2] and np.isnan(back[1])
    many = series.from_arrays(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0])], "k string, v array<double>"), "k", "v")
    assert {(r.series_id, r.idx, r.value) for r in many.collect()} == {("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)}


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("timestamp,value\n0.5,1\n1.5,\n2.5, 3 \n")
    df = series.from_csv(spark, str(tmp_path / "x.csv"))
    assert values(df) == [1, None, 3] and values(df, "t") == [0.5, 1.5, 2.5]
    df = series.from_csv_string(spark, "1;NA\n2;7\n", series.CsvOptions(False, None, 1, ";", "NA"))
    assert values(df) == [None, 7] and values(df, "t") == [0, 1]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        series.from_csv_string(spark, "t,v\n1,abc\n").collect()


def test_generators(spark):
    assert values(generators.random_walk(spark, 4, 42)) == [-1, 0, -1, 0] and values(generators.random_walk(spark, 3, 7)) == [1, 0, 1]
    x, want = 0.3, []
    for _ in range(6):
        want.append(x)
        x = 3.7 * x * (1 - x)
    assert values(generators.logistic_map(spark, 6, 3.7, 0.3)) == pytest.approx(want) and values(generators.logistic_map(spark, 1, 3.7, 0.3)) == [0.3]
    state, want = 99, []
    for i in range(40):
        state = (state * generators.MULTIPLIER + generators.INCREMENT) % 2**64
        want.append(0.1 * i + (state / 2**64 - 0.5) * 2)
    assert values(generators.trend_with_noise(spark, 40, 0.1, 2.0, 99)) == pytest.approx(want)
    assert values(generators.step_function(spark, 7, [1, 2, 3])) == [1, 1, 2, 2, 3, 3, 3]
    assert values(generators.sawtooth(spark, 4, 3)) == pytest.approx([0, 1 / 3, 2 / 3, 0]) and values(generators.square_wave(spark, 5, 4)) == [1, 1, -1, -1, 1]
    assert values(generators.sine_wave(spark, 8, 2, 3)) == pytest.approx([3 * np.sin(2 * np.pi * 2 * i / 8) for i in range(8)], abs=1e-12)
    assert values(generators.multi_frequency(spark, 8, [1, 2])) == pytest.approx([np.sin(2 * np.pi * i / 8) + np.sin(4 * np.pi * i / 8) for i in range(8)], abs=1e-12)


@pytest.mark.parametrize(("strategy", "want"), [
    ("linear", [1, 2, 3, 2.5, 2]), ("ffill", [1, 1, 3, 3, 2]), ("bfill", [1, 3, 3, 2, 2]), ("nearest", [1, 1, 3, 3, 2]),
    ("mean3", [1, 2, 3, 2.5, 2]), (impute.median_imputation(3), [1, 2, 3, 2.5, 2]), ("zero", [1, 0, 3, 0, 2]),
])
def test_imputation(spark, strategy, want):
    assert values(impute.impute(series.from_values(spark, GAP5), strategy)) == want


def test_imputation_chains_and_failures(spark):
    ends = series.from_values(spark, [None, 1, None])
    with pytest.raises(Exception, match="no strategy gives a value"):
        impute.impute(ends, "linear").collect()
    with pytest.raises(Exception, match="series 0 at [13]"):
        impute.impute(series.from_values(spark, GAP5), "drop").collect()
    chain = impute.Missing("linear").with_fallback("ffill").with_fallback(impute.Missing("bfill"))
    assert values(impute.impute(ends, chain)) == [1, 1, 1]
    assert values(impute.impute(ends, lambda v, w: F.lit(9.0))) == [9, 1, 9]
    with pytest.raises(ImputationError):
        impute.impute(ends, "no")


def test_features(spark):
    rows = features.all_builtin().compute(series.from_values(spark, S5)).orderBy("node").collect()
    assert [r.delta_forward for r in rows] == [2, -1, 2, -3, None] and [r.delta_backward for r in rows] == [None, 2, -1, 2, -3]
    assert [r.delta_symmetric for r in rows] == [r.local_slope for r in rows] == [None, 0.5, 0.5, -0.5, None]
    assert [r.acceleration for r in rows] == [None, -3, 3, -5, None] and [r.local_mean for r in rows] == pytest.approx([2, 2, 3, 7 / 3, 2.5])
    assert [r.is_local_max for r in rows] == [0, 1, 0, 1, 0] and [r.is_local_min for r in rows] == [0, 0, 1, 0, 0]
    assert [r.z_score for r in rows] == pytest.approx(((np.array(S5) - 2.2) / np.std(S5)).tolist())
    assert [r.local_variance for r in rows] == pytest.approx([np.var(S5[max(0, i - 1) : i + 2]) for i in range(5)])
    one = features.all_builtin().compute(series.from_values(spark, [4])).first()
    assert one.z_score is None and one.is_local_max == 0
    flat = features.FeatureSet().add_builtin("z_score").compute(series.from_values(spark, [2, 2])).collect()
    assert [r.z_score for r in flat] == [0, 0]


def test_custom_features(spark):
    df = series.from_values(spark, GAP5)
    own = features.FeatureSet().with_missing_data_strategy("ffill").add_function("double", lambda y, w: 2 * y)
    assert [r.double for r in own.compute(df).orderBy("node").collect()] == [2, 2, 6, 6, 4] and len(own.add_builtin("z_score")) == 2 and len(own) == 1
    rows = features.with_pandas_feature(series.from_values(spark, S5), "rank", lambda v: v.rank()).orderBy("node").collect()
    assert [r["rank"] for r in rows] == [1.5, 4, 3, 5, 1.5]
    maps = features.as_map(features.FeatureSet().add_builtin("delta_forward").compute(series.from_values(spark, S5))).orderBy("node").collect()
    assert maps[0].features == {"delta_forward": 2} and maps[4].features == {}
    with pytest.raises(ValueError, match="no feature"):
        own.add_builtin("no")


def test_windows_and_splits(spark):
    df = series.from_values(spark, [1, 2, 3, 4, 5, 6])
    w = windows.sliding(df, 2, 1)
    assert [r.window for r in w.orderBy("window_no").collect()] == [[[i, i + 1]] for i in range(1, 6)]
    for strategy, train, val in (("time", 0.5, 0.25), ("rolling", 2, 1)):
        got = [r.split for r in windows.split(w, strategy, train, val).orderBy("window_no").collect()]
        assert got == ["train", "train", "val", "test", "test"]
    with pytest.raises(Exception, match="no window is left"):
        windows.split(w, "rolling", 4, 1).collect()
    gaps = windows.sliding(series.from_values(spark, GAP5), 3, 2).orderBy("window_no").collect()
    assert [r.window for r in gaps] == [[[1, 3, 0]], [[3, 2, 0]]]
    both = series.from_values(spark, [1, 2, 3], "a").union(series.from_values(spark, [9], "b")).union(series.from_values(spark, [4, 5], "c"))
    many = windows.sliding(both, 2, 1)
    assert [(r.window_no, r.series_id, r.series_no) for r in many.orderBy("window_no").collect()] == [(0, "a", 0), (1, "a", 0), (2, "c", 2)]
    split = {r.series_id: r.split for r in windows.split(many, "series", 0.5, 0.5).collect()}
    assert sorted(split.values()) == ["train", "val"]
    assert [r.window_no for r in windows.extract_windows(many, [2]).collect()] == [2] and windows.get_window(many, 1).count() == 1
    labels = spark.createDataFrame([(0, 1.0)], "window_no long, label double")
    rows = windows.batches(windows.with_labels(many, labels), 2).orderBy("window_no").collect()
    assert [(r.batch, r.input, r.label) for r in rows] == [(0, [1, 2], 1), (0, [2, 3], None), (1, [4, 5], None)]


def test_signals(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=40)
    df = series.from_array(spark, v)
    mags = [r.magnitudes for r in signal.fft_windows(df, 8).orderBy("idx").collect()]
    for c, got in enumerate(mags):
        part = v[max(0, c - 4) : c + 4]
        assert got == pytest.approx(np.abs(np.fft.fft(np.pad(part, (0, 8 - len(part))))).tolist(), abs=1e-9)
    low = [r.k for r in signal.fft_windows(df, 8).select("idx", signal.dominant_frequency(F.col("magnitudes")).alias("k")).orderBy("idx").collect()]
    assert low == [max(range(1, 5), key=lambda k: (round(m[k], 9), k)) for m in mags]
    energy = [r.e for r in signal.fft_windows(df, 8).select("idx", signal.spectral_energy(F.col("magnitudes"), 1, 3).alias("e")).orderBy("idx").collect()]
    assert energy == pytest.approx([m[1] ** 2 + m[2] ** 2 for m in mags])
    a, want = v, {}
    for level in (1, 2, 3):
        a, d = (a[0 : len(a) // 2 * 2 : 2] + a[1::2][: len(a) // 2]) / 2**0.5, (a[0 : len(a) // 2 * 2 : 2] - a[1::2][: len(a) // 2]) / 2**0.5
        want |= {(level, k): (x, y) for k, (x, y) in enumerate(zip(a, d, strict=True))}
    got = {(r.level, r.k): (r.approximation, r.detail) for r in signal.haar_levels(df, 3).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert signal.wavelet_energy(df, 2).first().energy == pytest.approx(sum(d * d for (lv, _), (_, d) in want.items() if lv == 2))


def test_complexity(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=30)

    def share(m):
        n = len(v) - m
        hits = sum(i != j and max(abs(v[i + d] - v[j + d]) for d in range(m)) <= 0.8 for i in range(n) for j in range(n))
        return hits / (n * (n - 1))

    assert signal.sample_entropy(series.from_array(spark, v), 2, 0.8).first().sample_entropy == pytest.approx(-np.log(share(3) / share(2)))
    assert [signal.sample_entropy(series.from_values(spark, range(n)), 2, 0.5).first().sample_entropy for n in (1, 3, 6)] == [0, 0, 0]
    c = np.cumsum(v - v.mean())
    assert signal.hurst_exponent(series.from_array(spark, v)).first().hurst == pytest.approx(np.log((c.max() - c.min()) / v.std()) / np.log(30))
    assert [signal.hurst_exponent(series.from_values(spark, x)).first().hurst for x in ([1, 2], [3] * 12)] == [0.5, 0.5]


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0, 4.0], [3.0, 1.0, 1.0], [])], "a array<double>, b array<double>, e array<double>")
    a, b, e = F.col("a"), F.col("b"), F.col("e")
    got = row.select(vector.total(a), vector.mean(a), vector.variance(a), vector.dot(a, b), vector.add(a, b), vector.mean(e), vector.variance(e)).first()
    assert tuple(got) == (7, pytest.approx(7 / 3), pytest.approx(np.var([1, 2, 4])), 9, [4, 3, 5], 0, 0)


@pytest.fixture(scope="module")
def graph(spark):
    own = features.FeatureSet().add_builtin("delta_forward").add_builtin("is_local_max")
    return VisibilityGraph.from_series(series.from_values(spark, S5, "S5")).with_features(own).natural_visibility()


def test_text_sinks(graph):
    text = {k: sinks.export(graph, k).first() for k in sinks.EXPORTS}
    assert text["edge_list_csv"].text == "source,target,weight\n0,1,1\n1,2,1\n1,3,1\n2,3,1\n3,4,1"
    assert sinks.to_edge_list_csv(graph, False).first().text.startswith("source,target\n0,1\n")
    assert text["adjacency_csv"].text.split("\n")[:3] == ["node,0,1,2,3,4", "0,0,1,0,0,0", "1,0,0,1,1,0"]
    assert text["features_csv"].text.split("\n")[0] == "node,delta_forward,is_local_max" and text["features_csv"].text.split("\n")[5] == "4,,0"
    found = json.loads(sinks.to_json(graph, sinks.JsonOptions(True, True)).first().json)
    assert found["nodes"] == 5 and found["edges"][2] == {"source": 1, "target": 3, "weight": 1.0} and found["features"][4] == {"node": 4, "values": {"is_local_max": 0.0}}
    dot = text["dot"].text
    assert dot.startswith("graph visibility_graph {") and "  1 -- 3;" in dot and 'tooltip="delta_forward=2.00\\nis_local_max=0.00"' in dot
    assert 'label="n4"' in sinks.to_dot(graph, F.concat(F.lit("n"), "node")).first().text
    doc = xml.dom.minidom.parseString(text["graphml"].text)
    assert len(doc.getElementsByTagName("node")) == 5 and [e.getAttribute("id") for e in doc.getElementsByTagName("edge")] == [f"e{k}" for k in range(5)]
    adjacency = np.load(io.BytesIO(text["npy"].adjacency))
    assert adjacency.shape == (5, 5) and adjacency.sum() == 5 and np.load(io.BytesIO(text["npy"].degrees)).tolist() == [1, 3, 2, 3, 1]
    with pytest.raises(ValueError, match="no form"):
        sinks.export(graph, "no")


def test_file_sinks(spark, graph, tmp_path):
    """What is written is read back, in no more files than tasks for any number of series; a filter skips files."""
    rows = [(f"s{k:03d}", i, float(i), float((i * 7 + k) % 5)) for k in range(200) for i in range(6)]
    own = features.FeatureSet().add_builtin("delta_forward").add_builtin("z_score")
    many = VisibilityGraph.from_series(spark.createDataFrame(rows, "series_id string, idx long, t double, value double")).with_features(own).natural_visibility()
    edges = {tuple(r) for r in sinks.edge_list(many).collect()}
    sinks.write_parquet(many, str(tmp_path / "p"))
    files = list((tmp_path / "p").glob("*.parquet"))
    assert len(files) <= 4 and {tuple(r) for r in sinks.read_parquet(spark, str(tmp_path / "p")).collect()} == edges
    some = sinks.read_parquet(spark, str(tmp_path / "p"), ["s003", "s150"])
    assert {tuple(r) for r in some.collect()} == {e for e in edges if e[0] in ("s003", "s150")}
    assert "PushedFilters: [In(series_id" in some._jdf.queryExecution().toString()
    sinks.write_edges_csv(many, str(tmp_path / "c"))
    assert {tuple(r) for r in sinks.read_csv(spark, str(tmp_path / "c"), sinks.edge_list(many)).collect()} == edges
    sinks.write_features_csv(many, str(tmp_path / "f"))
    assert {tuple(r) for r in sinks.read_csv(spark, str(tmp_path / "f"), sinks.features_table(many)).collect()} == {tuple(r) for r in sinks.features_table(many).collect()}
    texts = sinks.to_graphml(many)
    sinks.write_text(texts, str(tmp_path / "g"))
    assert {tuple(r) for r in sinks.read_text(spark, str(tmp_path / "g"), texts).collect()} == {tuple(r) for r in texts.collect()}
    assert len(list((tmp_path / "g").glob("*.json"))) <= 4
    values = sinks.to_npy(graph).select(sinks.npy_values("edges").alias("e"), sinks.npy_values("degrees").alias("d")).first()
    assert values.e[:6] == [0, 1, 1, 1, 2, 1] and values.d == [1, 3, 2, 3, 1]


def test_sql_surface(spark, graph):
    sqlfns.register(spark)
    rows = spark.sql("select * from visibility_edges(array(1D, 3D, 2D, 4D, 1D), 'natural')").collect()
    assert {(r.src, r.dst) for r in rows} == {(0, 1), (1, 2), (1, 3), (2, 3), (3, 4)}
    for kind, values in (("natural", "array(1D, 3D, 2D, 4D, 1D)"), ("horizontal", "array(1D)"), ("horizontal", "array()")):
        pairs = spark.sql(f"select inline(visibility_pairs(cast({values} as array<double>), '{kind}'))").collect()
        assert {(r.src, r.dst) for r in pairs} == ({(r.src, r.dst) for r in rows} if kind == "natural" else set())
    with pytest.raises(Exception, match="impute first"):
        spark.sql("select visibility_pairs(array(1D, null), 'natural')").collect()
    sqlfns.create_views(graph, "g")
    assert spark.sql("select sum(degree) s from g_degrees").first().s == 10


@pytest.mark.parametrize("kind", ["natural", "horizontal"])
def test_stream_finds_the_batch_edges(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    rows = [(s, float(i), float(v)) for s in "ab" for i, v in enumerate(rng.integers(0, 9, 30) + rng.random(30) * 1e-3)]
    for k in range(3):
        part = [r for r in rows if k * 10 <= r[1] < (k + 1) * 10]
        spark.createDataFrame(part, "series_id string, t double, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, t double, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"edges_{kind}"
    q = streaming.visibility_edges(stream, kind).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    whole = series.points(spark.createDataFrame(rows, "series_id string, t double, value double"), "series_id", "t", "value")
    want = {(r.series_id, r.src, r.dst) for r in getattr(visibility, kind)(whole).collect()}
    assert {(r.series_id, r.src, r.dst) for r in spark.table(name).collect()} == want


def test_shares_are_decimals(spark):
    """0.7 of 90 is 63, though 90 * 0.7 lies below it in doubles."""
    df = spark.range(180).selectExpr("concat('s', lpad(cast(id div 2 as string), 2, '0')) as series_id", "id % 2 as idx", "cast(id as double) as value")
    w = windows.sliding(df, 2, 1)
    for strategy in ("time", "series"):
        got = windows.split(w, strategy, 0.7, 0.15).groupBy("split").count().collect()
        assert {r.split: r["count"] for r in got} == {"train": 63, "val": 13, "test": 14}


def test_npy_moves_no_matrices(spark):
    """Matrices are made where the files are: what Spark moves to them are edges, in the order of nodes."""
    rows = [(k, i, float((i * 7 + k) % 5)) for k in range(3) for i in range(6)] + [(9, 0, 1.0)]
    g = VisibilityGraph.from_series(spark.createDataFrame(rows, "series_id long, idx long, value double")).natural_visibility()
    files = sinks.to_npy(g)
    assert "entries" not in files._jdf.queryExecution().analyzed().toString()
    edges = {}
    for e in g.edges.collect():
        edges.setdefault(e.series_id, []).append((e.src, e.dst, e.weight))
    for r in files.collect():
        n, own = (1 if r.series_id == 9 else 6), sorted(edges.get(r.series_id, []))
        want = np.zeros((n, n))
        for a, b, w in own:
            want[a, b] = w
        assert (np.load(io.BytesIO(r.adjacency)) == want).all() and np.load(io.BytesIO(r.edges)).tolist() == [list(e) for e in own]
        assert (np.load(io.BytesIO(r.degrees)) == ((want > 0) + (want > 0).T).sum(axis=0)).all()
