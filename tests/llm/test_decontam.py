import random

import numpy as np

from sightline.llm import decontam

from .conftest import sentence


def items(spark, texts, answers=None):
    if answers:
        return spark.createDataFrame([(k, t, a, "x") for k, (t, a) in enumerate(zip(texts, answers, strict=True))], "item_id long, text string, answer string, doc_id string")
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "item_id long, text string, doc_id string")


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = rng.choices("abc", k=rng.randint(0, 9)), rng.choices("abc", k=rng.randint(0, 9))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontam.lcs(a, b) == best[-1][-1]


def test_copies_and_paraphrases(spark, frame):
    rng = random.Random(3)
    bench = [sentence(rng, n) for n in (15, 18, 24, 30, 40, 55, 80, 140)]
    texts, want = [], set()
    for k in range(80):
        words = sentence(rng, rng.choice([20, 100, 1500])).split()
        if k % 4 == 0:
            item = bench[k // 4 % len(bench)].upper().split()
            if k % 8 == 0:  # every ninth word is another
                item = [(f"z{i}" if i % 9 == 4 else w) for i, w in enumerate(item)]
            at = rng.randint(0, len(words))
            words[at:at] = [w + rng.choice(["", ",", "."]) for w in item]
            want.add((k, k // 4 % len(bench)))
        texts.append(" ".join(words))
    found = decontam.contaminated(frame(texts), items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(0.6 <= r.lcs <= 1 and r.answer is None for r in found)
    kept = {r.doc_id for r in decontam.without_contaminated(frame(texts), items(spark, bench)).collect()}
    assert kept == set(range(80)) - {d for d, _ in want}


def test_answers_are_asked_for(spark, frame):
    rng = random.Random(4)
    item = sentence(rng, 30)
    loose = " ".join(f"z{i}" if i % 4 == 1 else w for i, w in enumerate(item.split()))
    docs = frame([sentence(rng, 50) + " " + loose, sentence(rng, 50) + " " + loose + " fortytwo", *(sentence(rng, 60) for _ in range(200))])
    assert {r.doc_id for r in decontam.contaminated(docs, items(spark, [item], ["fortytwo"])).collect()} == {1}


def vocabulary(rng, n=4000):
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 7))) for _ in range(n)]
    return words, [1 / (k + 1) for k in range(n)]


def test_recall_in_the_fitted_space_against_brute_force(spark, frame):
    """All pairs of documents and items by LCS; items of 3 to 2,000 words, whole or with up to a third of their words replaced."""
    rng = random.Random(5)
    words, weights = vocabulary(rng)
    some = lambda n: rng.choices(words, weights, k=n)
    bench = [some(n) for n in (3, 5, 8, 12, 20, 33, 60, 100, 300, 900, 2000) for _ in range(2)]
    texts, planted = [], []
    for k in range(160):
        own, item = some(rng.choice([30, 200, 900])), list(bench[k % len(bench)])
        rate = (0, 0.1, 0.2, 0.33)[k % 4] if len(item) >= 6 else 0
        for i in range(len(item)):
            if rng.random() < rate:
                item[i] = rng.choice(words)
        at = rng.randint(0, len(own))
        texts.append(own[:at] + item + own[at:] if k % 3 else own)
        planted.append(k % len(bench) if k % 3 else None)

    def share(item, text):
        n = len(item)
        if n < decontam.SHORT:
            return float(any(text[i : i + n] == item for i in range(len(text) - n + 1)))
        return max(decontam.lcs(item, text[at : at + 2 * n]) / n for at in range(0, max(1, len(text) - n), max(1, n // 4)))

    want = {(d, k) for d, t in enumerate(texts) for k, x in enumerate(bench) if share(x, t) >= decontam.LCS}
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame([" ".join(t) for t in texts]), items(spark, [" ".join(x) for x in bench])).collect()}
    short = {(d, k) for d, k in want if len(bench[k]) < decontam.SHORT and sum(map(len, bench[k])) < decontam.SHORT_CHARS}
    want -= short
    print(f"recall {len(found & want)} of {len(want)}")
    assert len(want) > 80 and found <= want | short
    assert len(found & want) >= 0.9 * len(want)
    assert all((d, k) in found for d, k in enumerate(planted) if k is not None and d % 4 == 0 and (d, k) in want)  # exact copies


def cosine_by_all_passages(texts, item, other):
    """Of the two texts in the space of all passages, where words are fewer than its dimensions."""
    cols = [decontam.columns_of(decontam.word_hashes([t])[0]) for t in [*texts, item]]
    used = np.unique(np.concatenate(cols))
    df = np.array([sum(c in own for own in map(set, cols[:-1])) for c in used.tolist()])
    idf = np.log((len(texts) + 1) / (df + 1)) + 0.05
    counts = lambda c: np.bincount(np.searchsorted(used, c), minlength=len(used)) * idf
    a = np.array([counts(c[at : at + decontam.PASSAGE]) for c in cols for at in range(0, len(c), decontam.PASSAGE)])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    inner = np.linalg.pinv(a.T @ a)
    x, y = (counts(decontam.columns_of(decontam.word_hashes([t])[0])) * idf for t in (item, other))
    return x @ inner @ y / np.sqrt((x @ inner @ x) * (y @ inner @ y))


def found_cosine(spark, frame, texts, item):
    return next(r.cosine for r in decontam.contaminated(frame(texts), items(spark, [item])).collect() if r.doc_id == 0)


def paraphrase(rng):
    words = [f"w{k}" for k in range(40)]
    item = words[:12]
    return words, " ".join(item), " ".join("w30" if k == 5 else w for k, w in enumerate(item))


def test_space_is_of_all_documents(spark, frame):
    rng = random.Random(11)
    words, item, other = paraphrase(rng)
    texts = [other, *(" ".join(rng.choices(words, range(1, 41), k=30)) for _ in range(3600))]
    assert abs(found_cosine(spark, frame, texts, item) - cosine_by_all_passages(texts, item, other)) < 1e-4


def test_space_is_of_all_passages(spark, frame):
    """Of 36,000 passages of few documents, too."""
    rng = random.Random(12)
    words, item, other = paraphrase(rng)
    texts = [other, *(" ".join(rng.choices(words[k % 8 :], range(1, 41 - k % 8), k=72_000)) for k in range(24))]
    found = [r.cosine for r in decontam.contaminated(frame(texts), items(spark, [item])).collect() if r.doc_id == 0]
    assert abs(found[0] - cosine_by_all_passages(texts, item, other)) < 1e-4
    assert decontam.without_contaminated(frame(texts), items(spark, [item])).filter("doc_id = 0").isEmpty()


def test_index_loses_nothing(spark):
    """Without the cosine, regions hold every text of enough LCS."""
    rng = random.Random(8)
    words, weights = vocabulary(rng, 300)
    bench = [decontam.Item(k, " ".join(rng.choices(words, weights, k=rng.randint(6, 40))), None) for k in range(60)]
    idf = np.random.default_rng(1).random(decontam.FEATURES).astype(np.float32)
    index = decontam.Index(bench, np.zeros((decontam.FEATURES, 2), np.float32), idf)
    for k, x in enumerate(bench):
        kept = sorted(rng.sample(range(len(x.words)), -(-6 * len(x.words) // 10)))
        text = rng.choices(words, weights, k=50) + ["qq"] + rng.choices(words, weights, k=50)
        h, _ = decontam.word_hashes([" ".join(text)])
        mixed = np.concatenate([h[:50], x.words[kept], h[50:]])
        assert any(i == k and p[0] < 50 + len(kept) and p[-1] >= 50 for _, i, p in index.regions(mixed, np.array([0, len(mixed)])))


def test_cosine_loses_no_copy():
    """Wherever a copy begins, also when what is beside it outweighs it in the space."""
    item = [f"w{k}" for k in range(12)]
    vectors = np.random.default_rng(2).normal(size=(decontam.FEATURES, decontam.DIM)).astype(np.float32)
    vectors[decontam.columns_of(decontam.word_hashes(["heavy"])[0])] *= 1000
    index = decontam.Index([decontam.Item(7, " ".join(item), None)], vectors, np.ones(decontam.FEATURES, np.float32))
    for n in range(30):
        h, bounds = decontam.word_hashes([" ".join(["x"] * n + ["heavy"] + item + ["heavy"] + ["y"] * 20)])
        assert [(d, i) for d, i, *_ in index.hits(h, bounds)] == [(0, 7)]


def test_short_items_and_unspaced_scripts(spark, frame):
    bench = items(spark, ["yes no", "incontrovertible evidence", "\u6c34\u306f\u6c34\u7d20\u3068\u9178\u7d20\u304b\u3089\u3067\u304d\u3066\u3044\u308b"])
    docs = frame(["Yes; no!", "oh yes no", "what incontrovertible EVIDENCE there is", "\u5148\u751f\u300c\u6c34\u306f\u6c34\u7d20\u3068\u9178\u7d20\u304b\u3089\u3067\u304d\u3066\u3044\u308b\u300d\u3068", "evidence incontrovertible"])
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(0, 0), (2, 1), (3, 2)}


def test_benchmark_in_blocks(spark, frame, monkeypatch):
    rng = random.Random(6)
    bench = [sentence(rng, 20) for _ in range(20)]
    docs = frame([sentence(rng, 30) + " " + b for b in bench])
    monkeypatch.setattr(decontam, "ITEMS", 3)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items(spark, bench)).collect()} == {(k, k) for k in range(20)}


def test_hashes_are_of_words():
    texts = ["A b_c, d-e\u00e9 9", "", "\ud800 x", "zz " * 50, "\u6c34\u7d20 ab"]
    h, bounds = decontam.word_hashes(texts)
    assert np.diff(bounds).tolist() == [5, 0, 1, 50, 3]
    assert h[0] == decontam.word_hashes(["a"])[0][0] and len(set(h.tolist())) == 10
    long = "ab cd " * 500_000
    h, bounds = decontam.word_hashes([long, "ab"])
    assert bounds.tolist() == [0, 1_000_000, 1_000_001] and len(np.unique(h)) == 2


def test_odd(spark, odd, none):
    bench = items(spark, [None, "", "a b", sentence(random.Random(99), 20)])
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(odd, bench).collect()] == [(8, 2)]  # the document is the two words
    assert decontam.contaminated(none, bench).collect() == []
    assert decontam.contaminated(odd, bench.limit(0)).collect() == []
    assert decontam.without_contaminated(odd, bench).count() == odd.count() - 1
    assert decontam.without_contaminated(none, bench).columns == none.columns
    same = next(r.text for r in odd.collect() if r.doc_id == 3)
    hits = decontam.contaminated(odd, items(spark, [same])).collect()
    assert sorted(r.doc_id for r in hits) == [3, 4, 4, 12]
