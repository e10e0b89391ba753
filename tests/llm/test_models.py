import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sightline.llm import lm_score, quality, toxicity

from .conftest import sentence

LABELS = "doc_id long, quality int, toxic int, text string"


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def labelled(spark, frame):
    rng = random.Random(11)
    bad = ["idiot", "moron", "stupid"]
    texts, labels = [], []
    for i in range(400):
        words, toxic, junk = sentence(rng, rng.randint(20, 80)).split(), i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        if junk:
            words = [w.upper() + "!!" for w in words]
        texts.append(" ".join(words))
        labels.append((i, int(not junk), int(toxic), "x"))
    return frame(texts), spark.createDataFrame([*labels, (None, 1, 1, "x"), (3, None, None, "x")], LABELS), {i: (q, t) for i, q, t, _ in labels}


@pytest.mark.parametrize(("run", "folds", "fold", "which"), [(toxicity.toxicity, 3, 1, 1), (quality.quality, 4, 2, 0)])
def test_classifiers_on_held_out_rows(labelled, run, folds, fold, which):
    docs, labels, truth = labelled
    rows = run(docs, labels).collect()
    assert len(rows) == 400
    assert all(r.held_out == (crc(r.doc_id, folds) == fold) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id][which] for r in out) >= 0.97 * len(out)
    again = {r.doc_id: r.score for r in run(docs.repartition(5), labels).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in rows)


@pytest.mark.parametrize(("run", "label"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_labels_of_held_out_rows_are_not_read(spark, labelled, run, label):
    from pyspark.sql import functions as F

    from sightline.llm.labelled import held_out

    docs, labels, _ = labelled
    folds, fold = (3, 1) if label == "toxic" else (4, 2)
    turned = labels.withColumn(label, F.when(held_out(F.col("doc_id"), folds, fold), 1 - F.col(label)).otherwise(F.col(label)))
    a, b = ({r.doc_id: r.score for r in run(docs, x).collect()} for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_classifiers_on_odd_rows(odd, none, labelled, run):
    _, labels, _ = labelled
    rows = run(odd, labels).collect()
    assert len(rows) == odd.count() and not [r for r in rows if r.doc_id is None and r.held_out]
    assert run(none, labels).collect() == []
    assert {r.score for r in run(odd, labels.limit(0)).collect()} == {0.5}


def test_toxic_rows_go(labelled):
    docs, labels, truth = labelled
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if not r.predicted}
    assert {r.doc_id for r in kept.collect()} == want


def test_weights_are_sparse_and_memo_turns_over(monkeypatch):
    monkeypatch.setattr(toxicity, "MEMO", 100)
    monkeypatch.setattr(toxicity, "STEP", 40)
    rng = random.Random(2)
    text = sentence(rng, 500)
    small, large = toxicity.Hasher(), None
    monkeypatch.setattr(toxicity, "MEMO", 10_000)
    monkeypatch.setattr(toxicity, "STEP", 10_000)
    large = toxicity.Hasher()
    want = np.unique(large.features(text))
    monkeypatch.setattr(toxicity, "MEMO", 100)
    monkeypatch.setattr(toxicity, "STEP", 40)
    assert (np.unique(small.features(text)) == want).all()
    w = toxicity.fit([(np.arange(5, dtype=np.uint32), 1), (np.arange(5, 10, dtype=np.uint32), 0)] * 50)
    assert len(w.index) <= 10 and w.score(np.arange(5, dtype=np.uint32)) > 0.9


def test_shapes():
    assert [quality.shape(w) for w in ("Word", "WORD!!", "a1b", "$$$", "é")] == ["Aa", "A!", "a0a", "$", "a"]
    assert quality.shape("a1" * 50 + "!" * 90 + "Z") == "a0" * 50 + "!A"  # to the last character


def test_word_vectors_by_definition():
    """A token's own index vector of length one, and half that of the sum over its neighbours in the texts."""
    rng = np.random.default_rng(2)
    texts = [np.column_stack([rng.integers(0, 12, n), np.full((n, 2), -1)]).astype(np.int16) for n in (30, 1, 2, 0, 9)]
    base, unit = quality.index_vectors().astype(np.float64), lambda x: x / max(np.linalg.norm(x), 1e-9)
    assert all(np.count_nonzero(v) == quality.NONZERO and set(np.unique(v)) <= {-1.0, 0.0, 1.0} for v in base)
    got = quality.word_vectors(texts)
    for token in (*range(12), 2000):
        around = np.zeros(quality.DIM)
        for ids in texts:
            w = ids[:, 0].tolist()
            for i, x in enumerate(w):
                for j in range(max(0, i - quality.WINDOW), min(len(w), i + quality.WINDOW + 1)):
                    if x == token and j != i:
                        around += base[w[j]]
        assert got[token] == pytest.approx(unit(base[token]) + 0.5 * unit(around), abs=1e-5)


def test_pooling_by_definition():
    vectors = np.random.default_rng(3).normal(size=(quality.VOCABULARY + quality.SHAPES + 1, quality.DIM)).astype(np.float32)
    ids = quality.Encoder(["plain", "word"]).ids("Plain word WORD! x9 x9")
    assert ids[:, 2].tolist() == [-1, -1, -1, -1, quality.VOCABULARY + quality.SHAPES] and ids[:3, 0].tolist() == [0, 1, 1]
    assert quality.pool(ids, vectors) == pytest.approx(sum(vectors[i].astype(np.float64) for row in ids for i in row if i >= 0) / 5, abs=1e-5)
    assert not quality.pool(ids[:0], vectors).any()


def test_the_network_follows_its_gradient():
    rng = np.random.default_rng(5)
    z, y = rng.normal(size=(40, quality.DIM)), rng.integers(0, 2, 40).astype(float)
    p = [rng.normal(0, 0.2, (quality.DIM, quality.HIDDEN)), rng.normal(0, 0.1, quality.HIDDEN), rng.normal(0, 0.3, quality.HIDDEN), np.array([0.1])]

    def loss(p):
        logit = np.maximum(z @ p[0] + p[1], 0) @ p[2] + p[3][0]
        return np.logaddexp(0, -np.where(y > 0, 1, -1) * logit).mean() + quality.DECAY / 2 * ((p[0] ** 2).sum() + (p[2] ** 2).sum())

    found = quality.gradients(p, z, y)
    for k, at in ((0, (3, 4)), (0, (70, 11)), (1, 6), (2, 9), (3, 0)):
        up, down = [x.copy() for x in p], [x.copy() for x in p]
        up[k][at] += 1e-6
        down[k][at] -= 1e-6
        assert found[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-6, rel=1e-3, abs=1e-8)


def test_temperature_is_the_likeliest_of_its_grid():
    rng = np.random.default_rng(6)
    logit = rng.normal(0, 6, 500)
    y = (rng.random(500) < 1 / (1 + np.exp(-logit / 3))).astype(float)
    found = quality.temperature(logit, y)

    def likelihood(t):
        p = [1 / (1 + math.exp(-x / t)) for x in logit.tolist()]
        return sum(math.log(q if k else 1 - q) for q, k in zip(p, y, strict=True))

    assert 2 < found < 4.5 and all(likelihood(found) >= likelihood(t) - 1e-9 for t in np.geomspace(1, 16, 61))
    assert quality.temperature(100 * logit, (logit > 0).astype(float)) == 1.0


def test_weights_equal_a_plain_loop():
    """FTRL-proximal by coordinates: weights from z and n, sums over the features, one update each."""
    rng = np.random.default_rng(8)
    rows = [(np.unique(rng.integers(0, 40, 12) + 20 * (k % 2)).astype(np.uint32), k % 2) for k in range(60)]
    z, n, bias = Counter(), Counter(), "bias"

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = np.arange(len(rows))
    for epoch in range(toxicity.EPOCHS):
        np.random.default_rng(epoch).shuffle(order)
        for k in order:
            x, y = [*rows[k][0].tolist(), bias], rows[k][1]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in x:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = toxicity.fit(rows)
    want = {i: weight(i) for i in z if i != bias and weight(i)}
    assert dict(zip(got.index.tolist(), got.value.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)
    assert len(want) > 5 and got.bias == pytest.approx(weight(bias), rel=1e-6)
    text = rows[1][0]
    assert got.score(text) == pytest.approx(1 / (1 + math.exp(-weight(bias) - sum(want.get(i, 0) for i in text.tolist()))), rel=1e-5)


def test_features_of_a_text_by_definition():
    """Words, their stems, pairs, and pairs over a gap, each in a bit of its own."""
    m, odd = (1 << 64) - 1, int(toxicity.ODD)
    own = "A bad idea, AND bad again".lower().replace(",", "").split()
    h = [zlib.crc32(w.encode()) for w in own]
    first = [(x + 1) * odd & m for x in h]
    want = {(a ^ x + 0x1000003) * odd & m for a, x in zip(first, h[1:], strict=False)} | {(a ^ x + 0x3000017) * odd & m for a, x in zip(first, h[2:], strict=False)} | set(first)
    want |= {(zlib.crc32(f"{w[:k]}\0".encode()) + 1) * odd & m for w in own for k in toxicity.STEMS}
    assert set(toxicity.Hasher().features("A bad idea, AND bad again").tolist()) == {x >> (64 - toxicity.BITS) for x in want}


def test_language_model(frame):
    rng = random.Random(7)
    lexicons = [[sentence(rng, 1) for _ in range(60)] for _ in range(2)]
    texts = [" ".join(rng.choices(lexicons[i % 2], k=rng.randint(10, 60))).title() for i in range(300)] + [None, "", sentence(rng, 9000)]
    rows = {r.doc_id: r for r in lm_score.lm_scores(frame(texts)).collect()}
    own = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in enumerate(texts)}
    counts = Counter(w for i, ws in own.items() if crc(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in own.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in counts for w in ws), n, crc(i, 7) == 2)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
    out = [r for i, r in rows.items() if r.held_out and i < 300]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # the two lexicons are told apart by context


def test_language_model_is_normalised():
    rng = np.random.default_rng(1)
    model = lm_score.Model(rng.normal(size=lm_score.CLASSES))
    past = rng.integers(0, lm_score.CLASSES, 40)
    total = sum(10 ** model.log10s(np.append(past, k), 0)[-1] for k in range(lm_score.CLASSES))
    assert total == pytest.approx(1, abs=1e-4)
    ids = rng.integers(0, lm_score.CLASSES, 20_000)
    whole = model.log10s(ids, 0)
    assert model.log10s(ids[:9000], 0)[-1] == pytest.approx(whole[8999], abs=1e-3)


def test_language_model_on_odd_rows(odd, none):
    rows = lm_score.lm_scores(odd).collect()
    assert len(rows) == odd.count() and all(r.n_tokens >= 1 for r in rows)
    assert lm_score.lm_scores(none).collect() == []


def test_scores_do_not_depend_on_the_layout(frame):
    rng = random.Random(12)
    words = [sentence(rng, 1) for _ in range(300)]
    docs = frame([" ".join(rng.choices(words, k=rng.randint(5, 80))) for _ in range(200)])
    one, two = ({r.doc_id: r.score for r in lm_score.lm_scores(d).collect()} for d in (docs.coalesce(1), docs.repartition(5)))
    assert one == two


def test_a_step_follows_the_gradient_of_the_contrast():
    """One step against the loss differentiated numerically, with the step's own noise draws."""
    rng = np.random.default_rng(4)
    noise = rng.random(lm_score.CLASSES) + 0.1
    noise /= noise.sum()
    ids, end = rng.integers(0, lm_score.CLASSES, 60), 0
    own = np.ones(60, bool)
    base = lm_score.Model(np.log(noise))
    start = [p.astype(np.float64).copy() for p in base.parts()]
    trainer = lm_score.Trainer(base, noise, 0.01, end)
    drawn = np.minimum(np.searchsorted(np.cumsum(noise), np.random.default_rng(3).random(lm_score.NOISE) * np.cumsum(noise)[-1]), lm_score.CLASSES - 1)

    def loss(parts):
        m = lm_score.Model(parts[3], *(p.astype(np.float64) for p in parts[:3]))
        m.bias = parts[3]
        c = m.contexts(ids, end)[0]
        k = np.log(lm_score.NOISE * noise)
        right = np.einsum("ij,ij->i", c, m.outputs[ids]) + m.bias[ids] - k[ids]
        wrong = c @ m.outputs[drawn].T + m.bias[drawn] - k[drawn]
        return (np.logaddexp(0, -right).sum() + np.logaddexp(0, wrong).sum()) / len(ids)

    trainer.step(ids, own, 0)
    for k, row in ((2, int(ids[5])), (2, int(drawn[0])), (3, int(ids[7]))):
        moved = base.parts()[k][row] - start[k][row]
        for j in range(3) if k == 2 else (None,):
            at = (row, j) if j is not None else row
            up, down = [p.copy() for p in start], [p.copy() for p in start]
            up[k][at] += 1e-3
            down[k][at] -= 1e-3
            g = (loss(up) - loss(down)) / 2e-3
            want = -0.01 * g / np.sqrt(0.01 + g * g)
            assert (moved if j is None else moved[j]) == pytest.approx(want, rel=0.05, abs=2e-5)
