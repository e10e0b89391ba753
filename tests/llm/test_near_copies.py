import random

import pytest

from sightline.llm import common, near_copies, simhash

import corpus_pipeline

from .conftest import sentence


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def kept_by_brute_force(texts):
    """Of each component over Jaccard >= 0.8 the first place."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * common >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(sets))}


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"z{rng.random()}"
    return " ".join(words)


def corpus(rng):
    texts = [None, "", "  ", "One", "one", "a b c", "a b  C"]
    shared = sentence(rng, 20)
    for _ in range(12):
        base = sentence(rng, rng.choice([6, 12, 30, 60, 100, 300]))
        texts += [base, base.upper(), base + " tail", edited(rng, base, 1), edited(rng, base, 2)]
        texts += [shared + " " + sentence(rng, 25)]
        chain = base
        for _ in range(4):
            chain = edited(rng, chain, 1)
            texts.append(chain)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("dense, rounds", [(64, 4), (3, 4), (3, 0)])
def test_stage_against_brute_force(spark, frame, monkeypatch, dense, rounds):
    monkeypatch.setattr(near_copies, "DENSE", dense)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "FEW", 0 if dense == 3 else 1 << 18)
    texts = corpus(random.Random(7))
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, frame(texts), "").collect()}
    want = kept_by_brute_force(texts)
    assert got == want
    # the digests of op2 leave some of these copies
    assert len({simhash.fingerprint(t) for t in texts}) > len(want)


def test_odd_rows(odd, none):
    kept = near_copies.one_of_each(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in odd.collect()]
    assert kept.count() == len(kept_by_brute_force(texts))
    assert near_copies.one_of_each(none).collect() == []


def test_few_links_need_no_rounds(spark, tmp_path, monkeypatch):
    """Their components come by one query, and are those that rounds give."""
    rng = random.Random(21)
    edges = spark.createDataFrame([(rng.randint(-500, 500), rng.randint(-500, 500)) for _ in range(450)] + [(k, k + 1) for k in range(1000, 1300)], "a long, b long")
    asked = []
    scratch = near_copies.Scratch(spark, "test")
    monkeypatch.setattr(scratch, "keep", lambda df, keep=scratch.keep: asked.append(1) or keep(df))
    roots = lambda: {(r.node, r.root) for r in near_copies._roots(edges, scratch).collect() if r.node != r.root}
    few = roots()
    assert len(asked) == 1
    monkeypatch.setattr(near_copies, "LINKS", 10)
    assert few == roots() and len(few) > 600
    assert near_copies._roots(edges.limit(0), scratch).collect() == []


def test_sets_are_not_copied_for_every_partition(spark, frame):
    """What links shuffle follows the texts and not the number of partitions; copies for many pairs lose none."""
    rng = random.Random(23)
    texts = []
    for _ in range(40):
        base = sentence(rng, 1500)
        texts += [base, edited(rng, base, 3)]
    base = sentence(rng, 400)
    texts += [base, *(edited(rng, base, 3) for _ in range(20))]
    store = spark.sparkContext._jsc.sc().statusStore()
    doubles, none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(none, False, False, doubles, none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    docs, ran = frame(texts).cache(), set(shuffled())
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.doc_id for r in near_copies.one_of_each(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        docs.unpersist()
    assert got == kept_by_brute_force(texts) and len(got) == 41
    sent = sum(n for k, n in shuffled().items() if k not in ran)
    assert sent < 12 * sum(8 * len(shingles(t)) for t in texts)


def test_sets_of_many_pairs_are_copied(spark, frame, monkeypatch):
    """A set of many pairs is dealt out, and each pair is still compared once."""
    rng = random.Random(24)
    base = sentence(rng, 60)
    texts = [base, *(edited(rng, base, 1) for _ in range(12)), *(sentence(rng, 60) for _ in range(3))]
    docs, scratch = frame(texts), near_copies.Scratch(spark, "test")
    rows = scratch.keep(near_copies.shingled(docs))
    fps = [r.fp for r in rows.orderBy("doc_id").collect()]
    asked = [(a, fps[0]) for a in fps[1:]] + [(fps[13], fps[14])]
    for share in (1, 3, 256):
        monkeypatch.setattr(near_copies, "SHARE", share)
        found = near_copies._verified(spark.createDataFrame(asked, near_copies.PAIRS), docs, rows.select("doc_id", "fp"), scratch).collect()
        assert sorted((r.a, r.b) for r in found) == sorted((a, fps[0]) for a, t in zip(fps[1:], texts[1:], strict=True) if 5 * len(shingles(t) & shingles(base)) >= 4 * len(shingles(t) | shingles(base)))


def test_centres_are_always_dealt_out(spark, frame, monkeypatch):
    """The text that a group comes from is b in all its pairs, whatever the hashes, and no task has all of them; joins of large tables lose none."""
    monkeypatch.setattr(near_copies, "SHARE", 4)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    sides = set()
    pruned = near_copies._pruned

    def watched(pairs, classes, scratch):
        found = pruned(pairs, classes, scratch)
        rows = pairs.collect()
        if len(rows) >= 25:
            sides.add(max((sum(r[k] == v for r in rows), k) for k in (0, 1) for v in {r[k] for r in rows})[1])
        return found

    monkeypatch.setattr(near_copies, "_pruned", watched)
    for seed in range(3):
        rng = random.Random(seed)
        base = sentence(rng, 60)
        texts = [base, *(edited(rng, base, 1) for _ in range(30)), *[base] * 20, *(sentence(rng, 60) for _ in range(5))]
        rng.shuffle(texts)
        assert {r.doc_id for r in near_copies.one_of_each(frame(texts)).collect()} == kept_by_brute_force(texts)
    assert sides == {1}


def test_simhash_links_come_first(spark, frame):
    """Fingerprints are majorities over shingles; what is within their bits meets by them, what is equal in them by a star."""
    rng = random.Random(25)
    base = sentence(rng, 3000)
    texts = [base, edited(rng, base, 1), *(sentence(rng, 80) for _ in range(8))]
    for items in near_copies.shingles([*texts, ""]):
        hashes = items.tolist()
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert near_copies.simhash_of(items) % (1 << 64) == want
    scratch = near_copies.Scratch(spark, "test")
    rows = scratch.keep(near_copies.shingled(frame(texts)))
    fps, sims = zip(*((r.fp, r.sim) for r in rows.orderBy("doc_id").collect()), strict=True)
    want = {frozenset((fps[i], fps[j])) for i in range(10) for j in range(i) if ((sims[i] ^ sims[j]) % (1 << 64)).bit_count() <= simhash.TAU}
    found = near_copies._near_fingerprints(rows, scratch).collect()
    assert {frozenset(r) for r in found} == want and frozenset(fps[:2]) in want
    equal = spark.createDataFrame([(k, 7) for k in range(5)], "fp long, sim long")
    assert sorted(map(tuple, near_copies._near_fingerprints(equal, scratch).collect())) == [(k, 4) for k in range(4)]
