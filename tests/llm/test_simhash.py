import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sightline.llm import simhash
from sightline.llm.common import Scratch

from .conftest import sentence


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, tau=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    rng = random.Random(0)
    for text in [None, "", "  ", "One", "one TWO", "ÉA b c", *(sentence(rng, n) for n in (3, 4, 50, 5000))]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def same_partition(found, want):
    return len(set(zip(found, want, strict=True))) == len(set(found)) == len(set(want))


def linked(spark, fps):
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = scratch.keep(simhash.links(df, scratch))
    got = {r.node: r.root for r in simhash.components(edges, scratch).collect()}
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in edges.collect()]
    return [got.get(r, r) for r in (x - (1 << 64) if x >> 63 else x for x in fps)], pairs


def test_links_random_and_dense(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(8)}
    # a dense ball: hundreds of fingerprints that share most bits
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(i + 1, 64, 5)}
    fps = sorted(fps)
    got, pairs = linked(spark, fps)
    assert same_partition(got, brute_groups(fps))
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    monkeypatch.setattr(simhash, "DENSE", 10**9)  # all by pairs, each link once
    got, pairs = linked(spark, fps)
    assert same_partition(got, brute_groups(fps))
    every = {(min(a, b), max(a, b)) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 2}
    assert len(pairs) == len(every) and {(min(p), max(p)) for p in pairs} == every


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges, Scratch(spark, "test")).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and got[101] == 100


def test_documents(frame, odd, none):
    rng = random.Random(2)
    long = sentence(rng, 2500)
    near = long + " tail"
    docs = frame([sentence(rng, 40), long, near, None, "", long], [10, 7, 5, 3, 2, 9])
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(got[i][0] == brute_fingerprint(t) for i, t in texts.items())
    fps = [got[i][0] for i in texts]
    groups = brute_groups(fps)
    least = {g: min(i for i, x in zip(texts, groups, strict=True) if x == g) for g in groups}
    assert {i: c for i, (_, c) in got.items()} == {i: least[g] for i, g in zip(texts, groups, strict=True)}
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(none).collect() == [] and simhash.one_of_each(none).collect() == []


def test_one_of_each(odd):
    found = simhash.near_duplicates(odd)
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    fps = [simhash.fingerprint(r.text) for r in odd.collect()]
    assert len(rows) == len(set(brute_groups(sorted(set(fps)))))
    assert found.count() == odd.count()
    got = brute_groups([simhash.fingerprint(r.text) for r in rows])
    assert len(set(got)) == len(rows)


def test_hexed(spark):
    row = spark.createDataFrame([(-1,), (255,), (0,)], "fp long").select(simhash.hexed(F.col("fp")).alias("x")).collect()
    assert [r.x for r in row] == ["f" * 16, "0" * 14 + "ff", "0" * 16]
    assert np.uint64(2**64 - 1).astype(np.int64) == -1
