import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import lexical_search
from sightline.llm.lexical_search import BLOCK, added, sliced, terms_of, top_documents, top_slots


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=20):
    held = [(i, t) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n_docs, n_terms, out = len(held), sum(len(t) for _, t in held), []
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    for item_id, text in items:
        scores = []
        for doc_id, t in held:
            m, score = 75 + 25 * len(t) * n_docs // n_terms, 0
            for x in terms(text):
                if tf := t.count(x):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


def got(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 3))) for _ in range(40)] + ["é中", "😀", "x1", "Zoë"]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randint(1, 60)))) for k in range(300)]
    docs += [(400, None), (401, ""), (402, " ., \t"), (403, docs[0][1]), (403, docs[0][1]), (None, docs[1][1]), (404, "solo " * 500), (405, "\x80\x00{}`~x")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(12)] + [(20, None), (21, "??"), (22, "never-seen"), (23, "solo Solo"), (23, "solo"), (None, "a b a"), (24, docs[0][1])]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, n string, score int").repartition(3)
    return d, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")


def test_as_brute_force(spark, cases):
    assert got(top_documents(*frames(spark, *cases))) == brute(*cases)


def test_in_small_steps(spark, cases, monkeypatch):
    """Several blocks in a task, groups of items, chunks of items and pieces of texts make no difference."""
    monkeypatch.setattr(lexical_search, "POSTINGS", 300)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 150)
    monkeypatch.setattr(lexical_search, "BUCKETS", 3)
    df = top_documents(*frames(spark, *cases), k=3)
    assert got(df) == brute(*cases, k=3)


def test_pieces(monkeypatch):
    text = "ab" * 40 + " é中 x, Y z" * 30
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    n, found = terms_of(text)
    want = [t.encode() for t in terms(text)]
    assert n == len(want) and found == {t: want.count(t) for t in want}


def test_groups_of_items(monkeypatch):
    rng = np.random.default_rng(1)
    items = [[(t, int(q)) for t, q in enumerate(rng.integers(0, 3, 30)) if q] for _ in range(9)]
    docs = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(200)]
    tfs = [rng.integers(1, 9, len(t)) for t in docs]
    n = [int(x.sum()) + 1 for x in tfs]
    results = []
    for size in (2, 256):
        monkeypatch.setattr(lexical_search, "GROUP", size)
        search = lexical_search.Search(items, list(range(1, 31)), 200, sum(n), 5)
        results.append(sorted(tuple(map(int, r)) for part in search.block(n, docs, tfs) for r in zip(*part, strict=True)))
    assert results[0] == results[1] and len({i for i, _, _ in results[0]}) == 9


def test_bitmaps_add_and_rank():
    rng = np.random.default_rng(2)
    for most in (2, 1000, 1 << 40):
        a, b = rng.integers(0, most, BLOCK), rng.integers(0, most, BLOCK)
        every = np.arange(BLOCK)
        scores = added(sliced(a, every, 42)[None].copy(), sliced(b, every, 42)[None].copy())
        item, slot, score = top_slots(scores, 20)
        want = sorted((a + b)[a + b > 0], reverse=True)[:20]
        assert (score == (a + b)[slot]).all() and sorted(score, reverse=True)[:20] == want
        assert set(slot) == set(np.flatnonzero(a + b >= want[-1]))


def test_empty(spark, cases):
    d, i = frames(spark, *cases)
    assert top_documents(d.limit(0), i).collect() == [] and top_documents(d, i.limit(0)).collect() == []
    assert top_documents(d.filter(F.col("doc_id") == 401), i).collect() == []
