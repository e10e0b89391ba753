"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words (whole and cut to a
stem), adjacent word pairs and pairs with one word between, in ``BITS`` bits. Training visits the sampled
documents one by one with a learning rate of its own for every coordinate, and
L1 leaves few weights other than zero: at most 2**BITS, which bounds what is
broadcast (8 bytes each).

Training takes at most ``TRAIN_ROWS`` labelled documents (see labelled.py) and runs in
one task of an executor; every document is scored whole.

Defined results: a null text counts as empty and gets the score of the bias
alone; a null doc_id is not held out and its label is not used; repeated rows are scored
each; without any training row every score is 0.5; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_batches, trim
from .labelled import fitted, held_out, training_rows

BITS, TRAIN_ROWS, EPOCHS = 22, 12_000, 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.1
FOLDS, FOLD, THRESHOLD = 3, 1, 0.7
MEMO, STEP = 300_000, 50_000
#: Lengths of the prefixes that stand for a word beside itself, so that inflected forms share weights.
STEMS = (4, 5, 6)
ODD = np.uint64(0x9E3779B97F4A7C15)
words = re.compile(r"\w+").findall


class Hasher:
    """Feature hashes of texts, with a bounded memo of the hashes of words and stems."""

    def __init__(self, bits: int = BITS):
        self.shift, self.memo, self.table = np.uint64(64 - bits), {}, np.zeros((MEMO, 1 + len(STEMS)), np.uint64)

    def word(self, w: str) -> int:
        at = self.memo[w] = len(self.memo)
        self.table[at] = [zlib.crc32(w.encode("utf-8", "surrogatepass")), *(zlib.crc32(f"{w[:k]}\0".encode("utf-8", "surrogatepass")) for k in STEMS)]
        return at

    def features(self, text: str | None) -> np.ndarray:
        """Not distinct: words, stems, pairs, pairs with a gap."""
        found, parts = words((text or "").lower()), []
        # A memo that could overflow is emptied between pieces; two words carry over for the pairs.
        for at in range(0, max(1, len(found) - 2), STEP):
            some = found[at : at + STEP + 2]
            if len(self.memo) + len(some) > MEMO:
                self.memo.clear()
            get, new = self.memo.get, self.word
            ids = np.fromiter((i if (i := get(w)) is not None else new(w) for w in some), np.int64, len(some))
            with np.errstate(over="ignore"):
                h = self.table[ids, 0]
                a = (h + np.uint64(1)) * ODD
                pair = (a[:-1] ^ (h[1:] + np.uint64(0x1000003))) * ODD
                skip = (a[:-2] ^ (h[2:] + np.uint64(0x3000017))) * ODD
                single = (self.table[np.unique(ids)] + np.uint64(1)) * ODD
            parts += [single.ravel(), pair, skip]
        return (np.concatenate(parts) >> self.shift).astype(np.uint32)


class Weights:
    """Sparse weights, and the dense table made from them once in each worker."""

    def __init__(self, index: np.ndarray, value: np.ndarray, bias: float):
        self.index, self.value, self.bias = index, value, bias
        self._dense = None

    def __getstate__(self):
        return self.index, self.value, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, features: np.ndarray) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.index] = self.value
        used = features[self._dense[features] != 0]
        z = self.bias + float(self._dense[np.unique(used)].sum(dtype=np.float64))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def fit(rows: list[tuple[np.ndarray, int]]) -> Weights:
    """``rows``: distinct features and label of each document, in the order of training."""
    if not rows:
        return Weights(np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0)
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.arange(len(rows))
    for epoch in range(EPOCHS):
        np.random.default_rng(epoch).shuffle(order)
        for k in order:
            x, y = rows[k]
            x = np.append(x, size)
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum()))))
            g = p - y
            sigma = (np.sqrt(nx + g * g) - root) / ALPHA
            z[x] = zx + g - sigma * w
            n[x] = nx + g * g
    some = np.append(np.flatnonzero(np.abs(z[:-1]) > L1), size)  # the bias last
    z, n = z[some], n[some]
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Weights(some[:-1].astype(np.uint32), w[:-1].astype(np.float32), float(w[-1]))


TRAINING = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("features", T.BinaryType()), T.StructField("label", T.IntegerType())])
SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, folds: int = FOLDS, fold: int = FOLD) -> Weights:
    def make():
        hasher = Hasher()
        return lambda c: [(i, np.unique(hasher.features(t)).tobytes(), y) for i, t, y in zip(c["doc_id"], c["text"], c["label"], strict=True)]

    encoded = map_batches(training_rows(docs, labels, label, folds, fold, rows), TRAINING, make)
    return fitted(encoded, lambda own: fit([(np.frombuffer(f, np.uint32), y) for _, f, y in own]), rows)


def scores(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        hasher, own = Hasher(), sent.value
        return lambda c: [(i, own.score(hasher.features(t))) for i, t in zip(c["doc_id"], c["text"], strict=True)]

    return map_batches(docs.select("doc_id", "text"), SCORES, make)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    found = scores(docs, train(docs, labels, **options))
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` less the rows that are predicted toxic; scored in place, without a join, and written."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for text in parts:
            yield pd.Series([sent.value.score(hasher.features(t)) for t in text], dtype="float64")
        del hasher
        trim()

    return Scratch(docs.sparkSession, "toxicity").keep(docs.filter(score("text") < THRESHOLD))
