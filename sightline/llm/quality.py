"""Quality by random-indexing word vectors and a two-layer network.

Tokens are words (white space around them, lower case, outer punctuation kept
apart), the shapes of words (runs of upper and lower case, digits and symbols)
and a mark for a word that repeats the one before. Each token of the vocabulary
has a sparse random index vector; its word vector adds the index vectors that
surround it in the training sample. Words outside the vocabulary go by their
shape alone. A text's vector pools (averages) its tokens' vectors; a two-layer
numpy network with one hidden layer maps it to a logit, and a temperature (one at least) fitted
on training rows left out of its fit makes the probabilities calibrated.

Training takes at most ``TRAIN_ROWS`` labelled documents (see labelled.py) and runs in
one task of an executor, of which the driver sees the model; every document is
scored whole. What is broadcast is at most ``VOCABULARY`` + ``SHAPES`` vectors
of ``DIM`` numbers.

Defined results: a null text counts as empty and is scored from the zero vector;
a null doc_id is not held out and its label is not used; repeated rows are
scored each; without any training row every score is 0.5; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches
from .labelled import fitted, held_out, training_rows

TRAIN_ROWS, VOCABULARY, SHAPES, DIM, NONZERO, WINDOW = 12_000, 3000, 1000, 128, 6, 2
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 32, 60, 3e-3, 1e-4, 128
FOLDS, FOLD, THRESHOLD = 4, 2, 0.7
MEMO, STEP = 300_000, 100_000
_symbol = re.compile(r"\W+|_+")


def shape(word: str) -> str:
    """Runs of kinds of characters of the whole word: A upper case, a other letters, 0 digits, symbols as they are (once)."""
    return "".join(kind for kind, _ in groupby("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


class Encoder:
    """Token numbers of texts: vocabulary first, then buckets of shapes, then the repeat mark."""

    def __init__(self, vocabulary: list[str]):
        self.known = {w: i for i, w in enumerate(vocabulary)}
        self.memo: dict[str, tuple[int, int]] = {}
        self.repeat = VOCABULARY + SHAPES

    def word(self, w: str) -> tuple[int, int]:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        by_shape = VOCABULARY + zlib.crc32(shape(w).encode("utf-8", "surrogatepass")) % SHAPES
        found = self.memo[w] = (self.known.get(_symbol.sub("", w.lower()), by_shape), by_shape)
        return found

    def ids(self, text: str | None) -> np.ndarray:
        """(words, 3): word or its shape, shape, repeat mark or -1."""
        parts, last = [np.zeros((0, 3), np.int32)], None
        found = (text or "").split()
        for at in range(0, len(found), STEP):
            some = found[at : at + STEP]
            get, new = self.memo.get, self.word
            got = np.array([get(w) or new(w) for w in some], np.int32)
            same = np.fromiter((a == b for a, b in zip([last, *some], some, strict=False)), bool, len(some))
            parts.append(np.column_stack([got, np.where(same, self.repeat, -1)]))
            last = some[-1]
        return np.concatenate(parts)


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(7)
    out = np.zeros((VOCABULARY + SHAPES + 1, DIM), np.float32)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def word_vectors(texts: list[np.ndarray]) -> np.ndarray:
    """Own index vector, and those of the neighbours within WINDOW, each of length one."""
    base, n = index_vectors(), VOCABULARY + SHAPES + 1
    near = np.zeros(n * n, np.float32)
    for ids in texts:
        w = ids[:, 0].astype(np.int64)
        for d in range(1, WINDOW + 1):
            pairs, counts = np.unique(w[:-d] * n + w[d:], return_counts=True)
            near[pairs] += counts
    near = near.reshape(n, n)
    around = near @ base + near.T @ base

    def unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    return (unit(base) + 0.5 * unit(around)).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.zeros(DIM, np.float32)
    flat = ids.ravel()
    counts = np.bincount(flat[flat >= 0], minlength=len(vectors)).astype(np.float32)
    used = np.flatnonzero(counts)
    return counts[used] @ vectors[used] / len(ids)


class Model:
    def __init__(self, vocabulary: list[str], vectors: np.ndarray, layers: list[np.ndarray], temperature: float):
        self.vocabulary, self.vectors, self.layers, self.temperature = vocabulary, vectors, layers, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.maximum((x - mean) / scale @ w1 + b1, 0) @ w2 + b2[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def gradients(p: list[np.ndarray], z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean logistic loss and half ``DECAY`` times the squared weights, by each of the parameters."""
    h = z @ p[0] + p[1]
    a = np.maximum(h, 0)
    d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -35, 35))) - y) / len(y)
    back = np.outer(d, p[2]) * (h > 0)
    return [z.T @ back + DECAY * p[0], back.sum(0), a.T @ d + DECAY * p[2], np.array([d.sum()])]


def temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """Of a grid from 1 to 16, what makes the labels likeliest; the least of equals."""
    best = (np.inf, 1.0)
    for t in np.geomspace(1, 16, 61):
        s = np.where(y > 0, 1, -1) * logit / t
        best = min(best, (float(np.logaddexp(0, -s).mean()), float(t)))
    return best[1]


def fit(vocabulary: list[str], texts: list[np.ndarray], y: np.ndarray) -> Model:
    vectors = word_vectors(texts)
    if not len(y):
        return Model(vocabulary, vectors, [], 1.0)
    x = np.array([pool(t, vectors) for t in texts], np.float32)
    rng = np.random.default_rng(11)
    order = rng.permutation(len(y))
    cut = len(y) // 6
    out, own = order[:cut], order[cut:]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    p = [rng.normal(0, (2 / DIM) ** 0.5, (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = ((x - mean) / scale).astype(np.float64)
    for _ in range(EPOCHS):
        rng.shuffle(own)
        for at in range(0, len(own), BATCH):
            k = own[at : at + BATCH]
            t += 1
            for i, g in enumerate(gradients(p, z[k], y[k])):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    model = Model(vocabulary, vectors, [mean, scale, *p], 1.0)
    if len(out):
        model.temperature = temperature(model.logits(x[out]), y[out])
    return model


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("label", T.IntegerType())])
WORDS = T.StructType([T.StructField("w", T.StringType())])
SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, folds: int = FOLDS, fold: int = FOLD) -> Model:
    some = training_rows(docs, labels, label, folds, fold, rows)

    def distinct():
        return lambda c: [(w,) for t in c["text"] for w in {_symbol.sub("", w.lower()) for w in (t or "").split()} if w]

    top = map_batches(some.select("text"), WORDS, distinct).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(VOCABULARY).collect()
    vocabulary = [r["w"] for r in top]

    def encode():
        ids = Encoder(vocabulary).ids
        return lambda c: [(i, ids(t).astype(np.int16).tobytes(), y) for i, t, y in zip(c["doc_id"], c["text"], c["label"], strict=True)]

    def fit_own(own):
        return fit(vocabulary, [np.frombuffer(b, np.int16).reshape(-1, 3) for _, b, _ in own], np.array([y for *_, y in own], np.float64))

    return fitted(map_batches(some, ENCODED, encode), fit_own, rows)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value
        ids = Encoder(own.vocabulary).ids

        def work(c):
            x = np.array([pool(ids(t), own.vectors) for t in c["text"]], np.float32).reshape(-1, DIM)
            return list(zip(c["doc_id"], own.probabilities(x).tolist(), strict=True))

        return work

    return map_batches(docs.select("doc_id", "text"), SCORES, make)


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    found = scores(docs, train(docs, labels, **options))
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
