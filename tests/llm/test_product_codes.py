import hashlib
import math

import numpy as np
import pytest

from sightline.llm import common
from sightline.llm.product_codes import Codebook, digest, encoded, with_label_errors

SCHEMA = "vec_id long, embedding array<double>, label int, v string, code string"


def brute(rows, rounds=6):
    """The definition, entry by entry."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [(i, [math.floor(4096 * max(-8192.0, min(8192.0, x))) for x in v], label) for i, v, label in kept]
    length = len(whole[0][1])
    fit = [r for r in whole if len(r[1]) == length]
    width = -(-length // 8)
    cut = lambda v: [(v + [0] * (8 * width - length))[p * width : (p + 1) * width] for p in range(8)]
    parts = [cut(v) for _, v, _ in fit]
    books = [[parts[k][p] for k in range(min(16, len(parts)))] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        to = [[near(x[p], books[p])[1] for x in parts] for p in range(8)]
        for p in range(8):
            for k in range(len(books[p])):
                if own := [x[p] for x, t in zip(parts, to[p], strict=True) if t == k]:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, by_label = [], {}
    for i, v, label in whole:
        code = error = None
        if len(v) == length:
            found = [near(x, books[p]) for p, x in enumerate(cut(v))]
            code, error = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)
            by_label[label] = by_label.get(label, 0) + error
        out.append((i, label, code, error))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(str((*r, by_label.get(r[1], 0), sha)) for r in out)


def frame(spark, rows, n=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(n)


def got(df):
    return sorted(str((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in with_label_errors(encoded(df)).collect())


def cases():
    rng = np.random.default_rng(3)
    plain = [(k, (rng.normal(size=24) * (0.1 + k % 5)).tolist(), int(rng.integers(4))) for k in range(120)]
    ties = [(k, [float(x) / 4096 for x in rng.integers(-1, 2, 16)], None if k % 3 else 1) for k in range(80)]
    odd = [(k, rng.normal(size=21).tolist(), 0) for k in range(5)] + [(3, [0.5] * 21, None), (None, [0.25] * 21, 7), (8, [1e300] * 21, 1), (9, [-1e30, *[0.0] * 20], 1)]
    odd += [(10, None, 0), (11, [1.0, None] + [0.0] * 19, 0), (12, [float("nan")] * 21, 0), (13, [float("inf")] * 21, 0), (14, [0.1] * 8, 5), (15, [], 6)]
    return {"plain": plain, "ties": ties, "odd": odd, "copies": [(k // 2, [0.25, -0.5] * 8, 1) for k in range(60)], "no components": [(1, [], 0), (2, [], None)]}


@pytest.mark.parametrize("name", cases())
def test_as_brute_force(spark, name):
    assert got(frame(spark, cases()[name])) == brute(cases()[name])


def test_large_tables_of_labels(spark, monkeypatch):
    """Labels that are not broadcast, a hot one among them; no partition decides anything."""
    rows = [(k, v, label if k % 3 else 0) for k, v, label in cases()["plain"]]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    assert got(frame(spark, rows, 7)) == brute(rows)


def test_empty(spark):
    assert with_label_errors(encoded(frame(spark, []))).collect() == []


def test_annulus_is_exact_and_narrow():
    """Nearest entries equal the full search, ties at the edge of the annulus included, and most entries are never compared."""
    rng = np.random.default_rng(8)
    for scale, width in [(2, 1), (3, 2), (50, 3), (1 << 25, 8)]:
        entries, x = rng.integers(-scale, scale + 1, (16, width)), rng.integers(-scale, scale + 1, (500, width))
        number, best = Codebook(entries).nearest(x)
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (best == d.min(axis=1)).all() and (number == d.argmin(axis=1)).all()
    entries = np.array([[k * 1000, 0] for k in range(16)])
    seen = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            seen.append(np.size(at))
            return np.asarray(super().__getitem__(at))

    book = Codebook(entries)
    book.entries = book.entries.view(Counting)
    book.nearest(np.array([[k * 1000 + 3, 4] for k in range(16)]))
    assert sum(seen) == 16


def test_digest():
    books = np.array([[[1, -2], [3, 4]]])
    assert digest(books) == hashlib.sha256(b"1,-2,3,4").hexdigest()
