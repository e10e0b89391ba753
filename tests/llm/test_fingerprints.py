import hashlib
import random
import re

from pyspark.sql import functions as F

from sightline.llm import merkle

from .conftest import sentence


def brute_root(text):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    pieces = lambda p: re.findall(r"[^.!?]{1,48}+[.!?]*|[.!?]+", p)
    return h("".join(h("".join(h("".join(h(x) for x in pieces(p))) for p in s.split("\n"))) for s in (text or "").split("\n\n")))


def brute(docs):
    """(doc_id, n_chars, sha of the edited text, root, edited root), next documents by descending id."""
    docs = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_root(t), brute_root(edited))
    return out


def test_edits(frame, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 7)
    monkeypatch.setattr(merkle, "QUANTILES", 4)
    rng = random.Random(6)
    same = sentence(rng, 40)
    texts = [rng.choice([sentence(rng, 30) + "\n" + sentence(rng, 9) + ".\n\n" + sentence(rng, 20), same, "", None, "é😀中" * rng.randint(1, 9)]) for _ in range(120)]
    ids = rng.sample(range(-500, 5000), 100) + rng.sample(range(10**12, 10**12 + 500), 20)
    rows = merkle.edited_fingerprints(frame(texts, ids)).collect()
    want = brute(list(zip(ids, texts, strict=True)))
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in rows} == want
    assert all((r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_likeness_follows_the_edit(frame):
    rng = random.Random(8)
    texts = [". ".join(sentence(rng, 9) for _ in range(40)) for _ in range(20)]
    rows = merkle.edited_fingerprints(frame(texts)).collect()
    assert all(0.5 < r.near_edited < 0.8 and r.near_next < 0.1 for r in rows)


def test_likeness_counts_repeats_and_moved_parts(spark):
    cases = [("ab. " * 50, "ab. " * 50 + "cd. ", 49 / 52, 1), ("ab. " * 50, "cd. " * 50, 0, 0.05), ("one. two. three. four.", "three. four. one. two.", 0.3, 0.9), ("same", "same", 1, 1)]
    df = spark.createDataFrame([(a, b) for a, b, *_ in cases], "a string, b string").select(*(merkle.tree(F.col(c)).alias(c) for c in "ab"))
    got = df.select(merkle.likeness(merkle.root(F.col("a")), merkle.leaves(F.col("a")), merkle.root(F.col("b")), merkle.leaves(F.col("b"))).alias("x")).collect()
    assert all(lo <= r.x <= hi for r, (_, _, lo, hi) in zip(got, cases, strict=True))


def test_edit_is_located(frame):
    texts = ["p one.\n\np two.\np three. " + "x" * 60, "other words entirely. " * 5]
    rows = {r.doc_id: r for r in merkle.edited_fingerprints(frame(texts)).collect()}
    assert (rows[0].edit_section, rows[0].edit_paragraph, rows[0].edited_paragraphs) == (1, 1, 1)


def test_differences(spark):
    a, b = "one\ntwo\n\nthree\n\nfour", "one\n2\n\nthree\n\nfour\nfive"
    df = spark.createDataFrame([(a, b), (a, a), ("", "x\ny")], "a string, b string")
    got = df.select(merkle.differences(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("d")).collect()
    assert [[tuple(x) for x in r.d] for r in got] == [[(0, 1), (2, 1)], [], [(0, 0), (0, 1)]]


def test_odd(odd, none, frame):
    rows = merkle.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    by_text = {}
    for r in merkle.trees(odd).collect():
        by_text.setdefault(r.doc_id, set()).add(r.root)
    assert by_text[0] == by_text[1] and len(by_text[4]) == 1 and by_text[3] == by_text[4]
    assert merkle.edited_fingerprints(none).collect() == []
    (one,) = merkle.edited_fingerprints(frame(["abc def"])).collect()
    assert one.near_next == 1
    assert merkle.edited_fingerprints(frame([None, "a", "b", "c"], [None, None, None, None])).count() == 4
