"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters, digits and ``_`` (lower case); a character of a script
without spaces is a word of its own. They are hashed as whole arrays of code points,
and the first 16 bits of the hash are the ``FEATURES`` columns, weighted by inverse
document frequency over all documents.

A randomised SVD of the TF-IDF passages, those of all documents and of the benchmark,
gives a latent space: two passes multiply a block by all passages and back, task by task,
and sum the pieces in Spark; the first block is random, and a Nystroem approximation
from the second's product takes the place of more passes. They read the features of
the words (two bytes each), which are written once. A task hands over one sum of
FEATURES x (DIM + OVER) numbers, so there is one for ``TASK_WORDS`` words; sums are
added in two levels, as streams (``common.summed``), and the driver has one. Directions are scaled by their singular values, since the
strongest tell languages and not passages apart.

Search: an inverted index has the rarer half of each item's words. A text whose
longest common subsequence with an item of n words is ``LCS`` * n or more has at
least a known number of these words within 2n words; only such places are
looked at, in windows of n words, whose latent vectors must come within ``COSINE`` of
the item's; one window begins where a copy would, so that no copy is lost. All of a document is searched, and the index loses nothing before the
cosine. The windows are then verified: enough of the item's words, LCS, and below ``COPY``
the answer check for paraphrases: of the words of ``answer``, where the benchmark has
that column, the share ``ANSWER`` must be there.

Items of fewer than ``SHORT`` words must be there word by word; if they have fewer than
``SHORT_CHARS`` characters too, they are no evidence inside a text, and match only a
document of the same words.

The benchmark is the stated query set: it is read in blocks of about ``ITEMS``
items, each broadcast for one pass over the documents.

Defined results: a null text counts as empty; documents without a hit have no row; one row
for each document row and item, that of the best window; items that are null or without
words match nothing; words of over 1,000,000 characters are cut; a null doc_id or item_id is passed on;
``answer`` is null where there is no answer to check;
repeated rows are found each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SUMS, Scratch, fresh, summed, to_batch, trimmed

FEATURE_BITS, DIM, OVER, PASSAGE = 16, 64, 8, 48
FEATURES = 1 << FEATURE_BITS
#: Words for each task of the fit, and tasks at least; passages that are worked on together.
TASK_WORDS, TASKS, TOGETHER = 16_000_000, 8, 512
ITEMS, ITEM_BYTES = 2000, 4 << 20
COSINE, SHARED, LCS, COPY, ANSWER = 0.5, 0.5, 0.6, 0.8, 0.6
SHORT, SHORT_CHARS = 6, 16
CHARS, BLOCKS, MARK_BITS = 1 << 20, 32, 20
#: Code points of scripts that are written without spaces.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind of every code point (0: no word, 1: of a word, 2: a word), and a multiplier for each place in a word."""
    kind = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), np.uint8, 0x110000)
    kind[ord("_")] = 1
    for lo, hi in UNSPACED:
        kind[lo : hi + 1] *= 2
    return kind, np.random.default_rng(29).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _hashed(text: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``text``, and how many of them begin before each offset."""
    kinds, odd = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds[codes]
    word = kind > 0
    first = word.copy()
    first[1:] &= ~word[:-1] | (kind[1:] == 2) | (kind[:-1] == 2)
    at = np.flatnonzero(word)
    start = np.flatnonzero(first[at])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(at), dtype=np.int32) - np.repeat(start.astype(np.int32), np.diff(np.append(start, len(at))))
    h = np.add.reduceat((codes[at].astype(np.uint64) + np.uint64(1)) * odd[place & 255], start)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h, np.searchsorted(at[start], offsets)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin (and the last ends)."""
    low = [t.lower() for t in texts]
    if sum(map(len, low)) <= 2 * CHARS:
        lengths = np.cumsum([0, *(len(t) + 1 for t in low)])
        h, bounds = _hashed("\n".join(low), lengths[:-1])
        return h, np.append(bounds, len(h))
    parts, bounds = [], [0]
    for t in low:
        at, n = 0, 0
        while at < len(t) or not at:
            to = at + CHARS
            if to < len(t):  # at a space, where there is one near
                to = max(t.rfind(" ", to - 4096, to), t.rfind("\n", to - 4096, to)) + 1 or to
            parts.append(_hashed(t[at:to], np.zeros(0, np.int64))[0])
            n, at = n + len(parts[-1]), to
        bounds.append(bounds[-1] + n)
    return np.concatenate(parts), np.array(bounds)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list], np.ndarray, np.ndarray]]:
    """Columns (the last is the text), word hashes and bounds of rows of about CHARS characters together."""
    for batch in batches:
        rows: list[list] = [[] for _ in range(batch.num_columns)]
        size = 0
        for row in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
            for out, x in zip(rows, row, strict=True):
                out.append(x.as_py())
            rows[-1][-1] = rows[-1][-1] or ""
            size += len(rows[-1][-1])
            if size > CHARS >> 2:
                yield rows, *word_hashes(rows[-1])
                rows, size = [[] for _ in rows], 0
        if rows[-1]:
            yield rows, *word_hashes(rows[-1])


def columns_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each element of ``a``."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        if m := masks.get(y):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Item:
    """One benchmark item: its id, word hashes, the hashes of its answer, and whether it is short."""

    def __init__(self, item_id: int | None, text: str, answer: str | None):
        self.item_id = item_id
        self.words = word_hashes([text])[0]
        self.listed = self.words.tolist()
        self.distinct = set(self.listed)
        self.answer = set(word_hashes([answer or ""])[0].tolist())
        self.short = len(self.words) < SHORT
        self.alone = self.short and sum(map(str.isalnum, text)) < SHORT_CHARS


class Index:
    """Postings of the rarer half of each item's words, and the items in latent space."""

    def __init__(self, items: list[Item], vectors: np.ndarray, idf: np.ndarray):
        self.items, self.vectors = items, vectors
        n = np.array([len(x.words) for x in items], np.int64)
        short = np.array([x.short for x in items], bool)
        least = np.where(short, n, np.ceil(LCS * n - 1e-9).astype(np.int64))
        chosen = np.where(short, 1, (n + 1) // 2)
        self.need, self.span = np.maximum(1, chosen - (n - least)), 2 * n
        hashes, owners = [], []
        self.rarest = np.zeros(len(items), np.int64)
        for k, x in enumerate(items):
            order = np.lexsort((x.words, -idf[columns_of(x.words)]))[: chosen[k]]
            self.rarest[k] = order[0]
            own = np.unique(x.words[order])
            hashes.append(own)
            owners.append(np.full(len(own), k))
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((owners, hashes))
        self.marks, first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.first, self.posted = first, owners[order]
        self.bits = np.zeros(1 << MARK_BITS, bool)
        self.bits[self.marks >> np.uint64(64 - MARK_BITS)] = True
        latent = np.array([vectors[columns_of(x.words)].sum(axis=0) for x in items], np.float32).reshape(len(items), -1)
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def regions(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, item, places): the places of the item's marked words where enough of them are near each other."""
        at = np.flatnonzero(self.bits[h >> np.uint64(64 - MARK_BITS)])
        k = np.minimum(np.searchsorted(self.marks, h[at]), len(self.marks) - 1)
        right = self.marks[k] == h[at]
        at, k = at[right], k[right]
        if not len(at):
            return
        count = self.count[k]
        behind = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.posted[np.repeat(self.first[k], count) + behind].astype(np.int64)
        key = np.sort(item << 40 | np.repeat(at, count))
        item, at = key >> 40, key & ((1 << 40) - 1)
        doc = np.searchsorted(bounds, at, side="right") - 1
        last = np.arange(len(at)) + self.need[item] - 1
        end = np.minimum(last, len(at) - 1)
        near = (last < len(at)) & (item[end] == item) & (doc[end] == doc) & (at[end] - at <= self.span[item])
        if not near.any():
            return
        # A place is of interest when such a group begins at it or holds it.
        change = np.bincount(np.flatnonzero(near), minlength=len(at) + 1)[: len(at)] - np.bincount(end[near] + 1, minlength=len(at) + 1)[: len(at)]
        used = np.flatnonzero(np.cumsum(change) > 0)
        item, at, doc = item[used], at[used], doc[used]
        cut = np.flatnonzero((item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > self.span[item[1:]])) + 1
        for places, i, d in zip(np.split(at, cut), item[np.append(0, cut)].tolist(), doc[np.append(0, cut)].tolist(), strict=True):
            yield d, i, places

    def windows(self, h: np.ndarray, k: int, lo: int, hi: int, whole: np.ndarray) -> Iterator[tuple[float, int]]:
        """(cosine, first word) of the windows of the item's length between two words that are near it: some, and those from ``whole``."""
        n = len(self.items[k].words)
        step = max(1, n // 4)
        for at in range(lo, max(lo + 1, hi - n + 1), step * 2048):
            to = min(hi, at + step * 2048 + n)
            x = self.vectors[columns_of(h[at:to])]
            sums = np.concatenate([np.zeros((1, x.shape[1]), np.float32), np.cumsum(x, axis=0)])
            start = np.arange(0, max(1, min(step * 2048, to - at - n + 1)), step)
            start = np.union1d(start, whole[(whole >= at) & (whole < at + step * 2048) & (whole + n <= to)] - at)
            own = sums[np.minimum(start + n, len(x))] - sums[start]
            cosine = own @ self.latent[k] / np.maximum(np.linalg.norm(own, axis=1), 1e-9)
            for j in np.flatnonzero(cosine >= COSINE).tolist():
                yield float(cosine[j]), at + int(start[j])

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple]:
        """document, item_id, cosine, lcs, answer, first word, words: the best verified window of each item."""
        best: dict[tuple[int, int], tuple] = {}
        for d, k, places in self.regions(h, bounds):
            x, begin, end = self.items[k], int(bounds[d]), int(bounds[d + 1])
            n = len(x.words)
            if x.short:
                start = places - self.rarest[k]
                start = start[(start >= begin) & (start + n <= end)]
                for j in range(n):
                    start = start[h[start + j] == x.words[j]]
                if len(start) and (not x.alone or end - begin == n):
                    best.setdefault((d, k), (1.0, 1.0, None, int(start[0]) - begin, n))
                continue
            whole = places[h[places] == x.words[self.rarest[k]]] - self.rarest[k]  # where a copy would begin
            for cosine, start in self.windows(h, k, max(begin, int(places[0]) - n), min(end, int(places[-1]) + n + 1), whole):
                lo, hi = max(begin, start - n // 2), min(end, start + n + n // 2)
                around = h[lo:hi].tolist()
                there = x.distinct.intersection(around)
                if len(there) < SHARED * len(x.distinct):
                    continue
                share = lcs(x.listed, around) / n
                if share < LCS or ((d, k) in best and (share, cosine) <= best[d, k][:2]):
                    continue
                right = len(x.answer.intersection(around)) / len(x.answer) if x.answer else None
                if share >= COPY or right is None or right >= ANSWER:
                    best[d, k] = (share, cosine, right, lo - begin, hi - lo)
        return [(d, self.items[k].item_id, c, s, r, a, w) for (d, k), (s, c, r, a, w) in best.items()]


WORDS = T.StructType([T.StructField("features", T.BinaryType())])
HITS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.DoubleType()),
    T.StructField("answer", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
])


def _summed(parts: DataFrame, out: np.ndarray) -> np.ndarray:
    """Adds what tasks hand over in blocks (block, sums) of one whole to ``out``."""
    flat, edges = out.ravel(), np.cumsum([0, *(len(x) for x in np.array_split(np.empty(out.size, np.int8), BLOCKS))])
    for block, own in summed(parts, out.dtype):
        flat[edges[block] : edges[block + 1]] += own
    return out


def _blocks(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k, p in enumerate(np.array_split(x.ravel(), BLOCKS)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([p.tobytes()], pa.binary())], names=SUMS.names)


def features(texts: DataFrame) -> DataFrame:
    """The 16-bit features of the words of each text."""

    def run(batches):
        for _, h, bounds in _slices(batches):
            data, edges = columns_of(h).astype("<u2").tobytes(), (2 * bounds).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=WORDS.names)

    return texts.select("text").mapInArrow(trimmed(run), WORDS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of the words of rows of about CHARS / 4 words together, and where each row's begin (and the last ends)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(0).cast(pa.large_binary())
        _, offsets, data = col.buffers()
        bounds = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] // 2
        words = np.frombuffer(data, "<u2", int(bounds[-1])) if bounds[-1] else np.zeros(0, "<u2")
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (CHARS >> 2), "right")) - 1)
            yield words[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            at = to


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents with each feature, over all ``features`` of documents, their number, and that of their words."""

    def run(batches):
        own = np.zeros(FEATURES + 2, np.int64)
        for words, bounds in _features(batches):
            key = np.sort(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) << FEATURE_BITS | words)
            own[:-2] += np.bincount(key[np.append(True, key[1:] != key[:-1])] & (FEATURES - 1) if len(key) else key, minlength=FEATURES)
            own[-2:] += len(bounds) - 1, len(words)
        yield from _blocks(own)

    found = _summed(rows.mapInArrow(trimmed(run), SUMS), np.zeros(FEATURES + 2, np.int64))
    return found[:-2], int(found[-2]), int(found[-1])


def passages(words: np.ndarray, bounds: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The TF-IDF passages of texts, TOGETHER at a time: PASSAGE features each, sorted (FEATURES: none), and their weights."""
    n = -(-np.diff(bounds) // PASSAGE)
    start = np.repeat(bounds[:-1] - (np.cumsum(n) - n) * PASSAGE, n) + np.arange(n.sum()) * PASSAGE
    edges, idf = np.append(start, len(words)), np.append(idf, np.float32(0))
    for at in range(0, len(start), TOGETHER):
        own = edges[at : at + TOGETHER + 1]
        place = own[:-1, None] + np.arange(PASSAGE)
        k = words.take(place, mode="clip").astype(np.int32)
        k[place >= own[1:, None]] = FEATURES
        k.sort(axis=1)
        weight, flat = idf[k], k.ravel()
        first = np.append(True, flat[1:] != flat[:-1])
        first[::PASSAGE] = True
        first = np.flatnonzero(first)
        square = (weight.ravel()[first] * np.diff(np.append(first, k.size))) ** 2
        yield k, weight / np.sqrt(np.add.reduceat(square, np.searchsorted(first, np.arange(0, k.size, PASSAGE))))[:, None].astype(np.float32)


def add_products(total: np.ndarray, k: np.ndarray, weight: np.ndarray, block: np.ndarray) -> None:
    """Adds AtA x block for the passages ``k`` with ``weight``; words that are as frequent as each other are summed together."""
    y = (weight[:, None, :] @ block.take(k, axis=0, mode="clip"))[:, 0]
    at = np.flatnonzero(k.ravel() < FEATURES)
    own = k.ravel()[at].astype(np.uint16)
    order = np.argsort(own, kind="stable")
    own, at = own[order], at[order]
    value, row = weight.ravel()[at], at // k.shape[1]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    count = np.diff(np.append(first, len(own)))
    for n in np.unique(count).tolist():
        some = first[count == n]
        place = some[:, None] + np.arange(n)
        total[own[some]] += (value[place][:, None, :] @ y.take(row[place], axis=0))[:, 0]


def latent_space(rows: DataFrame, idf: np.ndarray) -> np.ndarray:
    """FEATURES x DIM: right singular vectors of the TF-IDF passages A of all ``features`` over their singular values."""
    sc = rows.sparkSession.sparkContext

    def times(width: int, block: np.ndarray | None) -> np.ndarray:
        """AtA x block, or a random block."""
        sent = sc.broadcast((idf, block))

        def run(batches):
            w, b = sent.value
            b = np.random.default_rng(13).standard_normal((FEATURES, width), np.float32) if b is None else b
            total = np.zeros((FEATURES, width), np.float32)
            for words, bounds in _features(batches):
                for k, weight in passages(words, bounds, w):
                    add_products(total, k, weight, b)
            yield from _blocks(total)

        out = _summed(rows.mapInArrow(trimmed(run), SUMS), np.zeros((FEATURES, width), np.float32))
        sent.destroy()
        return out

    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sum(a.T.astype(np.float64) @ b for a, b in zip(np.array_split(x, BLOCKS), np.array_split(y, BLOCKS), strict=True))

    def scaled(square: np.ndarray, least: float, power: float) -> np.ndarray:
        """Its eigenvectors of more than ``least`` of the largest eigenvalue, the largest first, times a power of their eigenvalues."""
        values, turn = np.linalg.eigh((square + square.T) / 2)
        some = np.flatnonzero(values > least * max(1e-30, float(values[-1])))[::-1]
        return turn[:, some] * values[some] ** power

    def turned(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """x turn, in the place of ``x``."""
        for part in np.array_split(x, BLOCKS):
            part[:, : turn.shape[1]] = part @ turn.astype(np.float32)
        return x[:, : turn.shape[1]]

    block = times(DIM + OVER, None)
    block = np.ascontiguousarray(turned(block, scaled(product(block, block), 1e-7, -0.5)))
    if not block.shape[1]:  # no words
        return block
    # AtA is nearly C Ct with C = AtA Q (Qt AtA Q)^-1/2, and has its left singular vectors.
    found = times(block.shape[1], block)
    half = scaled(product(block, found), 1e-6, -0.5)
    del block
    return np.ascontiguousarray(turned(found, half @ scaled(half.T @ product(found, found) @ half, 1e-6, -1.0)[:, :DIM]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, first_word, n_words of every verified hit."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    answers = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = scratch.keep(benchmark.select("item_id", "text", answers.alias("answer")).filter("text is not null"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // ITEMS), -(-size // ITEM_BYTES))
    if not n:
        return spark.createDataFrame([], HITS)
    known = scratch.keep(features(docs))
    df, total, words = document_frequencies(known)
    idf = np.log((total + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    vectors = latent_space(known.union(features(items)).coalesce(max(TASKS, words // TASK_WORDS)), idf)
    scratch.drop(known)
    vectors *= (idf * idf)[:, None]
    found = []
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        own = [x for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"])) if len((x := Item(*r)).words)]
        if own:
            found.append(_searched(docs, spark.sparkContext.broadcast(Index(own, vectors, idf))))
    if not found:
        return spark.createDataFrame([], HITS)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _searched(docs: DataFrame, index) -> DataFrame:
    def run(batches):
        own, arrow = index.value, to_arrow_schema(HITS)
        for rows, h, bounds in _slices(batches):
            if found := own.hits(h, bounds):
                yield to_batch([(rows[0][d], *x) for d, *x in found], arrow)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), HITS)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the rows that contain a benchmark item (for null doc_ids: rows of the same text go together)."""
    scratch = Scratch(docs.sparkSession, "decontam")
    key, name = F.xxhash64("doc_id", "text"), fresh(docs)
    hit = scratch.keep(contaminated(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(hit, key == F.col(name), "left_anti")
