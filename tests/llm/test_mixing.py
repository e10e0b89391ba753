import random
from collections import defaultdict

import numpy as np
import pytest

from sightline.llm import mixing

from .conftest import sentence


def test_targets_stop_and_reshare():
    sizes = [10, 100, 1000, 50]
    got = mixing.targets(sizes, [1, 2, 3, 1], sum(sizes))
    assert sum(got) == pytest.approx(sum(sizes)) and all(g <= 3 * s + 1e-9 for g, s in zip(got, sizes, strict=True))
    assert got[0] == 30 and mixing.targets([], [], 0) == [] and mixing.targets([0, 5], [1, 1], 5) == [0.0, 5.0]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_permutation(n):
    out = mixing.permuted(np.arange(n), n, 7)
    assert sorted(out.tolist()) == list(range(n))
    assert (mixing.permuted(out, n, 7, back=True) == np.arange(n)).all()


def test_draws_are_multinomial_and_settled_exactly():
    sizes = [0, 50, 16_000, 5_333]
    goals = mixing.targets(sizes, [1, 2, 3, 1], sum(sizes))
    mix = mixing.Mix(sizes, goals, 16, 10, 1)
    drawn = [np.bincount(mix.drawn(s), minlength=4) for s in range(mix.shards)]
    p = mix.quota / mix.slots
    spread = np.array(drawn[:-1])[:, 2].var() / (10 * p[2] * (1 - p[2]))
    assert 0.7 < spread < 1.4  # as of independent draws
    mix.settle(np.sum(drawn, axis=0))
    at, got, words = np.zeros(4, np.int64), np.zeros(4, np.int64), np.zeros(4, np.int64)
    times = [np.zeros(n, np.int64) for n in mix.blocks]
    for lo in range(0, mix.shards, 7):
        own = range(lo, min(mix.shards, lo + 7))
        shard, slot, source, block, cut = mix.chunk(own, at)
        at += np.sum([drawn[s] for s in own], axis=0)
        got += np.bincount(source, minlength=4)
        words += np.bincount(source, cut, minlength=4).astype(np.int64)
        for i, b in zip(source.tolist(), block.tolist(), strict=True):
            times[i][b] += 1
    assert (got == mix.quota).all() and words.tolist() == [round(g) for g in goals]
    assert all(t.max(initial=0) - t.min(initial=9) <= 1 for t in times[1:])  # each pass takes every block once


def test_repeated_rows_are_packed_each(frame):
    texts = ["a b c d e f g"] * 300 + ["h i j"] * 5
    got = mixing.taken(frame(texts, [1] * 300 + [2] * 5, ["s"] * 300 + ["t"] * 5), 16, shard_slots=4).collect()
    assert len(got) == 305 and sum(r.taken for r in got if r.source == "s") == round(next(r.target for r in got if r.source == "s"))
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_mix(frame, spark):
    rng = random.Random(4)
    texts = [sentence(rng, rng.choice([1, 5, 60, 400])) for _ in range(120)] + [None, "", " \t"]
    sources = [rng.choice(["big"] * 6 + ["é", "a", None, ""]) for _ in texts]
    docs = frame(texts, None, sources)
    got = mixing.taken(docs, 16, shard_slots=8).collect()
    assert len(got) == len(texts)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        by[r.source][0] += r["size"]
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
        assert r.taken <= 3 * r["size"]
        assert r["size"] == len((texts[r.doc_id] or "").encode().split())
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.targets([by[s][0] for s in order], [1.0 + k % 3 for k in range(len(order))], sum(x[0] for x in by.values()))
    for s, t in zip(order, want, strict=True):
        assert by[s][2] == pytest.approx(t) and by[s][1] == round(t)
    again = mixing.taken(docs.repartition(7), 16, shard_slots=8).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_slots_and_blocks_say_what_is_taken(frame):
    rng = random.Random(9)
    docs = frame([sentence(rng, 30) for _ in range(40)])
    placed, slots = mixing.mixed(docs, 16, shard_slots=8)
    slots = slots.collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots)
    words = defaultdict(int)
    for r in slots:
        for w in range(r.block * 16, r.block * 16 + r.cut):
            words[r.source_no, w] += 1
    want = {r.doc_id: sum(words[r.source_no, w] for w in range(r["at"], r["at"] + r["size"])) for r in placed.collect()}
    assert {r.doc_id: r.taken for r in mixing.taken(docs, 16, shard_slots=8).collect()} == want


def test_odd(odd, none):
    assert mixing.taken(odd).count() == odd.count()
    assert mixing.taken(none).collect() == []
