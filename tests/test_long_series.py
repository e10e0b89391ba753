"""Series cut into spans have the edges that they have in one piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import long_series, visibility


def cases():
    rng = np.random.default_rng(7)
    n = 700
    x = np.arange(n)
    return {
        "random": rng.normal(size=n), "whole": rng.integers(1, 51, n), "few": rng.integers(0, 2, n), "walk": rng.normal(size=n).cumsum(), "up": x * 3, "down": -x * 2, "constant": np.full(n, 5), "collinear pieces": np.minimum(x, 400),
        "concave": -((x - 300) ** 2), "convex": ((x[:150] - 60) ** 2), "waves": np.rint(1000 * np.sin(x / 9)), "one": x[:1], "two": x[:2], "span": rng.normal(size=32), "span and one": rng.normal(size=33), "peaks": np.where(x % 97 == 0, x, 0),
    }


@pytest.fixture(scope="module")
def series(spark):
    rows = [(k, i, float(v)) for k, vs in cases().items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, idx long, value double").repartition(4, "idx").persist()


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(long_series, "SPAN", 32)
    monkeypatch.setattr(long_series, "LEAF", 5)
    monkeypatch.setattr(long_series, "CHUNK", 20)


@pytest.mark.parametrize("of", [visibility.natural, visibility.horizontal])
def test_as_in_one_piece(series, small, of):
    def edges(strategy):
        found = [tuple(r) for r in of(series, "absdiff", strategy=strategy).collect()]
        assert len(found) == len(set(found))
        return set(found)

    got, want = edges("long"), edges("kernel")
    for k in cases():
        assert {r for r in got if r[0] == k} == {r for r in want if r[0] == k}, k


def test_pieces_need_no_whole_series(series, small):
    """No row that is exchanged holds more than a span, or a hull."""
    spans = long_series._spans(series.select("series_id", "idx", F.col("value").alias("v")))
    assert spans.agg(F.max(F.size("values"))).first()[0] == 32


def test_hull_and_tangents():
    rng = np.random.default_rng(1)
    x, v = np.arange(60), rng.normal(size=60).cumsum()
    hx, hv = long_series.hull(x, v)
    assert (np.diff(np.diff(hv) / np.diff(hx)) < 0).all() and hx[0] == 0 and hx[-1] == 59
    left, right = np.arange(-20, 0), np.arange(60, 80)
    y = rng.normal(size=20)
    assert np.allclose(long_series.tangents(left, y, (hx, hv), False), ((v - y[:, None]) / (x - left[:, None])).max(axis=1))
    assert np.allclose(long_series.tangents(right, y, (hx, hv), True), ((v - y[:, None]) / (x - right[:, None])).min(axis=1))
    flat = long_series.hull(np.arange(10), np.full(10, 3.0))
    assert flat[0].tolist() == [0, 9]


def test_edges_of_a_span_leave_together():
    v = np.random.default_rng(4).integers(1, 51, 8192).astype(float)
    pieces = list(long_series._edge_pieces(long_series.natural_within(v, 8192)[0], 8192, v))
    want = np.concatenate([np.stack(p, axis=1) for p in visibility.natural_blocks(v)]) + 8192
    assert len(pieces) == 1 and {(a, b) for a, b in zip(*(x.tolist() for x in pieces[0][:2]))} == set(map(tuple, want.tolist()))
    assert (v[pieces[0][0] - 8192] == pieces[0][2]).all() and (v[pieces[0][1] - 8192] == pieces[0][3]).all()
