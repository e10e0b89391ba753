import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sightline.llm import bwt_dedup as bwt


def brute(texts, n=bwt.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int(((np.diff(np.concatenate([[0], gone.astype(int)]))) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefgh \né", k=rng.randint(150, 700))) for _ in range(8)]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b) // 3)
            t += b[a : rng.randint(a, len(b))] + "".join(rng.choices("xyz", k=rng.randint(0, 40)))
        texts.append(t + "a" * rng.choice([0, 0, 0, 300]))
    return texts


def compare(frame, texts, ids=None):
    got = sorted(map(tuple, bwt.digests(frame(texts, ids)).collect()), key=str)
    ids = ids or range(len(texts))
    assert got == sorted([(i, *x) for i, x in zip(ids, brute(texts), strict=True)], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(frame, seed):
    compare(frame, corpus(seed))


def test_crowded_anchors_go_by_windows(frame, monkeypatch):
    monkeypatch.setattr(bwt, "MOST", 1)
    compare(frame, corpus(3))


def test_lengths_copies_and_repeated_rows(frame):
    rng = random.Random(4)
    letters = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
    x, y = letters(199), letters(200)
    copies = letters(1000)
    compare(frame, [x, x, y, "q" + y + "z", copies, copies, copies, None, "", "a" * 201, letters(3000)], [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, None])


def test_within_one_document_and_long_texts(frame):
    rng = random.Random(5)
    part = "".join(rng.choices("abcdef", k=260))
    long = "".join(rng.choices("abcdefgh", k=60_000))
    compare(frame, [part + "-" + part, long, "zz" + long[10_000:10_400]])


def test_segments_meet(monkeypatch):
    data = "".join(random.Random(6).choices("ab", k=5000)).encode() + b"a" * 1500
    monkeypatch.setattr(bwt, "SEGMENT", 777)
    h, start, count, off = bwt.contexts(data)
    covered = np.concatenate([np.arange(s, s + n) for s, n in zip(start, count, strict=True)])
    assert (covered == np.arange(len(data) - bwt.LENGTH + 1)).all() and (off >= 0).all() and (off < bwt.SPAN).all()


def test_merge_sorts_and_finds_common_prefixes():
    rng = random.Random(7)
    strings = [np.array(rng.choices([1, 2, 3], k=rng.randint(5, 40))) for _ in range(30)]
    cuts = [strings[:7], strings[7:19], strings[19:]]
    shards = [bwt.transform(s) for s in cuts]
    depth = 6
    rows, block, prefix = bwt.merge(shards, depth)
    suffixes = []
    for s, (_, _, order) in zip(cuts, shards, strict=True):
        flat = [(k, i) for k, x in enumerate(s) for i in range(len(x) + 1)]
        suffixes += [(tuple(s[flat[p][0]][flat[p][1] :]), len(s[flat[p][0]]) - flat[p][1]) for p in order]
    found = [suffixes[r][0] for r in rows]
    heads = [x[:depth] for x in found]
    assert heads == sorted(heads)
    for k in range(1, len(found)):
        common = 0
        while common < depth and common < min(len(found[k]), len(found[k - 1])) and found[k][common] == found[k - 1][common]:
            common += 1
        assert prefix[k] == common
        assert (block[k] == block[k - 1]) == (common >= depth)


def test_rounds_of_window_ends_alone():
    """The rows that stand in a block of several after all rounds of ``merge``; few rows go through the last rounds."""
    rng = random.Random(9)
    strings = [np.array(rng.choices([1, 2], k=rng.randint(1, 60))) for _ in range(40)] + [np.arange(1, 400)]
    shards = [bwt.transform(s) for s in (strings[:9], strings[9:30], strings[30:])]
    for depth in (1, 5, 9):
        rows, block, _ = bwt.merge(shards, depth)
        alike = set(rows[np.bincount(block)[block] > 1].tolist())
        flat, first = [], 0  # (start, string) of the suffix of every row
        for s, (_, _, order) in zip((strings[:9], strings[9:30], strings[30:]), shards, strict=True):
            every = [(i, k + first) for k, x in enumerate(s) for i in range(len(x) + 1)]
            flat += [every[p] for p in order]
            first += len(s)
        row_of = {x: r for r, x in enumerate(flat)}
        ends = np.array([r for r, (i, _) in enumerate(flat) if i >= depth])
        found = bwt.repeated_ends(shards, ends, depth)
        assert {row_of[flat[r][0] - depth, flat[r][1]] for r in found.tolist()} == {r for r in alike if flat[r][0] + depth <= len(strings[flat[r][1]])}
        seen = Counter(tuple(x[i : i + depth]) for x in strings for i in range(len(x) - depth + 1))
        assert len(found) == sum(n for n in seen.values() if n > 1)


def test_shards_and_rounds_stay_cheap():
    """Symbols of contexts that differ near their ends: about a third of the rows are window ends, and most leave in the first rounds."""
    rng = np.random.default_rng(10)
    anchor = rng.integers(0, 256, bwt.ANCHOR, np.uint8).tobytes()
    groups = [[(rng.integers(0, 256, 72, np.uint8).tobytes() + anchor + rng.integers(0, 256, 72, np.uint8).tobytes(), 72) for _ in range(2)] for _ in range(300)]
    moved = []
    plain = np.argsort
    with pytest.MonkeyPatch.context() as m:
        m.setattr(np, "argsort", lambda x, **kw: moved.append(len(x)) or plain(x, **kw))
        found = bwt.repeated_windows(groups)
    assert not any(len(x) for g in found for x in g)
    assert sum(moved) < 20 * sum(len(d) - bwt.ANCHOR + 2 for g in groups for d, _ in g)  # it was over 73 times the symbols


def test_stage_and_odd(frame, odd, none):
    texts = corpus(8)
    docs = frame(texts)
    got = {r.doc_id: r for r in bwt.without_repeats(docs).collect()}
    for i, (t, (n, removed, _, _)) in enumerate(zip(texts, brute(texts), strict=True)):
        assert got[i].n_chars == len(got[i].text)
        assert n - removed - 6 * 4 <= len(got[i].text.encode()) <= n - removed
        if not removed:
            assert got[i].text == t
    assert bwt.without_repeats(docs).columns == docs.columns
    assert bwt.digests(odd).count() == odd.count() == bwt.without_repeats(odd).count()
    assert bwt.digests(none).collect() == [] == bwt.without_repeats(none).collect()
