"""Log-bilinear language model, trained with noise-contrastive estimation.

Tokens are the words of a text (A-Z lowered, split at ASCII white space) and one
end. Outputs of the model are the ``HEAD`` most frequent tokens of the training
documents and ``RARE`` classes, by hash of the first two bytes, for all others (tokens go by 64-bit hashes);
within its class a rare token has probability (c + 1) / Z, with c its training
count and Z the sum over the class's types and one unseen type. The context is
linear: each of the ``ORDER`` tokens before has its vector scaled by weights of its
place, and the mean of the ``LONG`` tokens before is scaled likewise. A batch's
scores are one matrix product of contexts and outputs, and their log-sum-exp
normalises every token's probability exactly.

Training: counts cover all training documents. The parameters start from a
bounded sample (``WARM_DOCS`` documents), then all training documents are dealt into
groups of about ``GROUP_TOKENS`` tokens by a hash, each group is visited in the order of that hash
with noise-contrastive steps from there, and the mean of
the groups' parameters, weighted by tokens, is the model (one round of
parameter mixing, summed in two levels). Groups and their order depend on the documents alone,
so scores are the same however Spark has cut the table.

The ``KNOWN`` most frequent tokens and their counts are broadcast (a bound on rows);
the counts of all other tokens are joined in, as sums for each document.

Defined results: a null text counts as empty and scores its end token alone; a
null doc_id is not held out and its text is trained on; repeated rows count and are scored
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import CHARS, LOW, SUMS, WORD, Scratch, summed, word_hashes
from .labelled import fitted, held_out

HEAD, RARE, DIM, ORDER, LONG = 320, 64, 32, 4, 24
KNOWN, WARM_DOCS, WARM_EPOCHS, NOISE, BATCH = 100_000, 1500, 10, 96, 2048
RATE, MIX_RATE = 0.15, 0.05
FOLDS, FOLD = 7, 2
CLASSES = HEAD + RARE
#: Tokens of a group that is trained on in one go.
GROUP_TOKENS = 4_000_000
#: Stands for the hash of the end, which no word has (the words' hashes are odd).
END = np.uint64(0)
FLUSH = 300_000
#: Tokens whose scores are held at once.
ROOM = 512
LOG10 = math.log(10)
#: Class of a rare word by its first two bytes (0: it has one).
_BUCKETS = np.array([zlib.crc32(bytes((a, b) if b else (a,))) % RARE for a in range(256) for b in range(256)], np.int32)


def tokens(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and rare classes of the tokens of each text, its end included."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if sum(map(len, data)) > 4 * CHARS and len(data) > 1:
        return [x for t in texts for x in tokens([t])]
    joined = b"\n".join([*data, b""])
    h, start = word_hashes(joined)
    codes = LOW[np.frombuffer(joined, np.uint8)]
    second = codes[start + 1]
    buckets = _BUCKETS[codes[start].astype(np.int64) << 8 | np.where(WORD[second], second, 0)]
    h |= np.uint64(1)
    edges = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in data)]))
    return [(np.append(h[a:b], END), np.append(buckets[a:b], 0)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _slices(batches):
    """First column and the tokens of the last, some rows at a time."""
    for batch in batches:
        first, texts, size = [], [], 0
        for i, text in zip(batch.column(0), batch.column(batch.num_columns - 1), strict=True):
            first.append(i.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size > CHARS:
                yield first, tokens(texts)
                first, texts, size = [], [], 0
        if texts:
            yield first, tokens(texts)


class Lexicon:
    """Codes of tokens: known ones by rank, then one code for each class of unknown ones."""

    SLOTS = 21

    def __init__(self, known: list[tuple[int, int, int]]):
        """``known``: hash, rare class and count, by rank."""
        n = self.unknown = len(known)
        self.hashes = np.array([h for h, *_ in known], np.uint64)
        self.order = np.argsort(self.hashes)
        # The first token of each slot; what it isn't is searched for.
        slot = (self.hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        self.first = np.zeros(1 << self.SLOTS, np.int32)
        self.first[slot[::-1]] = np.arange(n, dtype=np.int32)[::-1]
        self.several = np.bincount(slot, minlength=1 << self.SLOTS) > 1
        self.classes = np.array([i if i < HEAD else HEAD + b for i, (_, b, _) in enumerate(known)] + [HEAD + b for b in range(RARE)], np.int16)
        self.log_count = np.array([math.log10(c + 1) for *_, c in known] + [0.0] * RARE)
        self.seen = np.array([c > 0 for *_, c in known] + [False] * RARE)

    def encode(self, h: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the tokens, and the hashes of those that are not known."""
        slot = (h >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.first[slot].copy()
        wrong = np.flatnonzero(self.hashes[out] != h)
        out[wrong] = -1
        wrong = wrong[self.several[slot[wrong]]]
        if len(wrong):
            at = self.order[np.minimum(np.searchsorted(self.hashes, h[wrong], sorter=self.order), self.unknown - 1)]
            right = self.hashes[at] == h[wrong]
            out[wrong[right]] = at[right]
        missing = out < 0
        out[missing] = self.unknown + buckets[missing]
        return out, h[missing]


class Model:
    """Parameters: input vectors, place weights, output vectors, output biases."""

    def __init__(self, bias: np.ndarray, vectors: np.ndarray | None = None, places: np.ndarray | None = None, outputs: np.ndarray | None = None):
        rng = np.random.default_rng(5)
        self.vectors = rng.normal(0, 0.3, (CLASSES, DIM)).astype(np.float32) if vectors is None else vectors
        self.places = np.full((ORDER + 1, DIM), 1 / (ORDER + 1), np.float32) if places is None else places
        self.outputs = rng.normal(0, 0.05, (CLASSES, DIM)).astype(np.float32) if outputs is None else outputs
        self.bias = bias.astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.places, self.outputs, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        a, b = CLASSES * DIM, (ORDER + 1) * DIM
        return Model(flat[2 * a + b :], flat[:a].reshape(CLASSES, DIM), flat[a : a + b].reshape(ORDER + 1, DIM), flat[a + b : 2 * a + b].reshape(CLASSES, DIM))

    def contexts(self, ids: np.ndarray, end: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Context vectors, the vectors at each place, the long mean, and the ids that these are of; what stands before a text are ends."""
        n = len(ids)
        padded = np.concatenate([np.full(LONG, end), ids[:-1]])
        vectors = np.take(self.vectors, padded, axis=0)
        at = [vectors[LONG - 1 - d : LONG - 1 - d + n] for d in range(ORDER)]
        long = moving_sum(vectors, LONG)
        long /= LONG
        out = long * self.places[ORDER]
        scaled = np.empty_like(out)
        for v, place in zip(at, self.places, strict=False):
            out += np.multiply(v, place, out=scaled)
        return out, at, long, padded

    def prepared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float]]:
        """What ``log10s`` makes of the parameters, for many calls, and its room for scores."""
        most = float(np.linalg.norm(self.outputs, axis=1).max()), float(np.abs(self.bias).max())
        return np.ascontiguousarray(self.outputs.T), np.exp(np.minimum(self.bias, 80)), np.empty((ROOM, CLASSES), np.float32), most

    def log10s(self, ids: np.ndarray, end: int, prepared: tuple | None = None) -> np.ndarray:
        """Normalised log10 probability of each token's class."""
        out = np.empty(len(ids))
        weights, factors, block, most = prepared or self.prepared()
        for lo in range(0, len(ids), BATCH):
            first = max(0, lo - LONG)
            context = self.contexts(ids[first : lo + BATCH], end)[0][lo - first :]
            # Scores stay far below 80; where they could not, the bound keeps the sum finite.
            tame = float(np.sqrt(np.einsum("ij,ij->i", context, context).max())) * most[0] + most[1] < 80
            for at in range(0, len(context), len(block)):
                part = context[at : at + len(block)]
                s = np.matmul(part, weights, out=block[: len(part)])
                target = ids[lo + at : lo + at + len(s)]
                own = s[np.arange(len(s)), target] + self.bias[target]
                if tame:
                    total = np.exp(s, out=s) @ factors
                else:
                    s += self.bias
                    np.minimum(s, 80, out=s)
                    own = np.minimum(own, 80)
                    total = np.exp(s, out=s).sum(axis=1)
                out[lo + at : lo + at + len(s)] = own - np.log(total)
        return out / LOG10


def moving_sum(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of each ``width`` consecutive rows, from sums of powers of two."""
    n, out, at, size = len(x) - width + 1, np.zeros(1, x.dtype), 0, 1
    while size <= width:
        if width & size:
            out = out + x[at : at + n]
            at += size
        if 2 * size <= width:
            x = x[size:] + x[:-size]
        size *= 2
    return out


class Trainer:
    """Noise-contrastive steps with rates of their own for every parameter."""

    def __init__(self, model: Model, noise: np.ndarray, rate: float, end: int):
        self.m, self.rate, self.end = model, rate, end
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.cumulated = np.cumsum(noise)
        self.rng = np.random.default_rng(3)
        self.squares = [np.full_like(p, 0.01) for p in model.parts()]
        self.held: list[np.ndarray] = []
        self.size = 0

    def _move(self, k: int, rows: np.ndarray | None, g: np.ndarray) -> None:
        p, q = self.m.parts()[k], self.squares[k]
        if rows is None:
            q += g * g
            p -= self.rate * g / np.sqrt(q)
            return
        order = np.argsort(rows.astype(np.int16), kind="stable")
        ordered = rows[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        some, total = ordered[first], np.add.reduceat(np.take(g, order, axis=0), first, axis=0)
        moved = q[some] + total * total
        q[some] = moved
        p[some] -= self.rate * total / np.sqrt(moved)

    def text(self, ids: np.ndarray) -> None:
        """Texts are trained on in batches; ends stand between them, which are no targets."""
        self.held += [ids, np.full(LONG, self.end)]
        self.size += len(ids) + LONG
        if self.size >= BATCH:
            self.flush()

    def flush(self) -> None:
        if not self.size:
            return
        ids = np.concatenate(self.held)
        own = np.concatenate([np.full(len(x), k % 2 == 0) for k, x in enumerate(self.held)])
        self.held, self.size = [], 0
        for at in range(0, len(ids), BATCH):
            first = max(0, at - LONG)
            self.step(ids[first : at + BATCH], own[at : at + BATCH], at - first)

    def step(self, ids: np.ndarray, own: np.ndarray, skip: int) -> None:
        m, rows = self.m, np.flatnonzero(own) + skip
        if not len(rows):
            return
        context, places, long, padded = m.contexts(ids, self.end)
        context, target = np.take(context, rows, axis=0), ids[rows]
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1]), CLASSES - 1)
        own_out = np.take(m.outputs, target, axis=0)
        right = np.einsum("ij,ij->i", context, own_out) + m.bias[target] - self.log_noise[target]
        some = m.outputs[noise]
        g_wrong = context @ -some.T
        g_wrong -= m.bias[noise] - self.log_noise[noise]
        g_right = (1 / (1 + np.exp(-np.clip(right, -30, 30))) - 1).astype(np.float32) / len(target)
        with np.errstate(over="ignore"):  # to zero
            np.exp(g_wrong, out=g_wrong)
        g_wrong += 1
        np.divide(np.float32(1 / len(target)), g_wrong, out=g_wrong)
        g_context = g_wrong @ some
        g_context += g_right[:, None] * own_out
        g_out = np.concatenate([g_right[:, None] * context, g_wrong.T @ context])
        spread = np.zeros_like(long)
        spread[rows] = g_context
        g_places = np.stack([np.einsum("ij,ij->j", spread, v) for v in [*places, long]])
        # What a word gets from all places that it has; the first ids of ``padded`` have none.
        g_in, scaled = np.zeros((len(ids) + ORDER - 1, DIM), np.float32), np.empty_like(spread)
        for d in range(ORDER):
            g_in[ORDER - 1 - d : ORDER - 1 - d + len(ids)] += np.multiply(spread, m.places[d], out=scaled)
        outputs = np.concatenate([target, noise])
        self._move(2, outputs, g_out)
        self._move(3, outputs, np.concatenate([g_right, g_wrong.sum(0)]))
        self._move(0, padded[LONG - ORDER :], g_in)
        self._move(1, None, g_places)


COUNTS = T.StructType([T.StructField("h", T.LongType()), T.StructField("b", T.IntegerType()), T.StructField("c", T.LongType())])
CODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("label", T.IntegerType())])
ENCODED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("logs", T.DoubleType()), T.StructField("inner", T.DoubleType()),
    T.StructField("rare", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType())]))),
])
SCORED = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("logs", T.DoubleType()), T.StructField("model_log", T.DoubleType()),
])


def _counts(train: DataFrame) -> DataFrame:
    """h, b, c over all training texts; each task hands on sums, in pieces of bounded size."""

    def run(batches):
        held, size = [], 0

        def out():
            h, at, c = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_counts=True)
            b = np.concatenate([x[1] for x in held])[at]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(b, pa.int32()), pa.array(c, pa.int64())], names=COUNTS.names)

        for _, found in _slices(batches):
            held += found
            size += sum(len(x[0]) for x in found)
            if size > 4 * FLUSH:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return train.select("text").mapInArrow(run, COUNTS).groupBy("h").agg(F.min("b").alias("b"), F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, types: int) -> list[tuple[int, int, int]]:
    """At most KNOWN tokens, by a count that they exceed; so no more than these leave the executors."""
    least = 0
    if types > KNOWN:
        run = 0
        for c, n in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(KNOWN).toArrow().to_pandas().itertuples(index=False):
            run += n
            if run > KNOWN:
                least = int(c)
                break
    found = counts.filter(F.col("c") > least).toArrow()
    own = zip(found.column("h").to_numpy().view(np.uint64).tolist(), found.column("b").to_pylist(), found.column("c").to_pylist(), strict=True)
    return sorted(own, key=lambda x: (-x[2], x[0]))


def _mixed(train: DataFrame, start, noise: np.ndarray, end: int, groups: int) -> Model:
    """The mean, by tokens, of what each group makes of the parameters; of ``train`` (h, ids)."""

    def run(batches):
        model, n = Model.of(start.value.copy()), 0
        trainer = Trainer(model, noise, MIX_RATE, end)
        for batch in batches:
            for x in batch.column(1):
                ids = np.frombuffer(x.as_buffer(), np.int16).astype(np.int64)
                trainer.text(ids)
                n += len(ids)
        trainer.flush()
        if n:
            sums = np.append(model.flat().astype(np.float64) * n, n)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=SUMS.names)

    parts = train.select("h", "ids").repartition(groups, "h").sortWithinPartitions("h", "ids").mapInArrow(run, SUMS)
    found = summed(parts, np.dtype(np.float64))
    return Model.of((found[0][1][:-1] / found[0][1][-1]).astype(np.float32)) if found else Model.of(start.value)


def lm_scores(docs: DataFrame, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    scratch, sc = Scratch(spark, "lm"), spark.sparkContext
    docs = docs.select("doc_id", "text")
    train = docs.filter(~held_out(F.col("doc_id"), folds, fold))
    counts = scratch.keep(_counts(train))
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = _most_frequent(counts, types)
    if int(END) not in {h for h, *_ in top[:HEAD]}:  # without training texts, or where ends are rare: the end keeps a class of its own
        top = [(int(END), 0, next((c for h, _, c in top if h == int(END)), 0)), *(x for x in top if x[0] != int(END))][:KNOWN]
    # Sums of the rare classes over all training tokens.
    head = spark.createDataFrame(np.array([h for h, *_ in top[:HEAD]], np.uint64).view(np.int64)[:, None].tolist(), "h long")
    by_class = {r[0]: r[1:] for r in counts.join(F.broadcast(head), "h", "left_anti").groupBy("b").agg(F.sum(F.col("c") + 1), F.sum("c")).collect()}
    z = np.array([1 + by_class.get(b, (0, 0))[0] for b in range(RARE)], np.float64)
    class_counts = np.array([c for *_, c in top[:HEAD]] + [0] * (HEAD - len(top[:HEAD])) + [by_class.get(b, (0, 0))[1] for b in range(RARE)], np.float64)
    noise = (class_counts + 1) / (class_counts + 1).sum()
    end = next(i for i, (h, *_) in enumerate(top) if h == int(END))
    words = Lexicon(top)
    lexicon = sc.broadcast(words)

    def coded(batches):
        words = lexicon.value
        for ids, found in _slices(batches):
            own = [words.classes[words.encode(*x)[0]].tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.binary()), pa.array([0] * len(ids), pa.int32())], names=CODED.names)

    def warm(own: list[tuple[int, bytes, int]]) -> np.ndarray:
        model = Model(np.log(noise))
        trainer = Trainer(model, noise, RATE, end)
        for _ in range(WARM_EPOCHS):
            for _, ids, _ in own:
                trainer.text(np.frombuffer(ids, np.int16).astype(np.int64))
            trainer.flush()
        return model.flat()

    hashed = train.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    some = hashed.select("h").distinct().orderBy("h").limit(WARM_DOCS)
    sample = hashed.join(F.broadcast(some), "h").groupBy("h").agg(F.min("text").alias("text"))
    start = sc.broadcast(fitted(sample.mapInArrow(coded, CODED), warm, WARM_DOCS))
    # By code, what a token's own count adds to the probability of its class.
    within = np.where(words.classes < HEAD, 0, words.log_count - np.concatenate([np.zeros(HEAD), np.log10(z)])[words.classes])
    within = sc.broadcast(within)

    def encode(batches):
        words, arrow = lexicon.value, to_arrow_schema(ENCODED)
        pair = arrow.field("rare").type.value_type
        for keys, found in _slices(batches):
            out, rares, times = [], [], []
            for key, (h, buckets) in zip(keys, found, strict=True):
                codes, rare = words.encode(h, buckets)
                rare, n = np.unique(rare.view(np.int64), return_counts=True)
                rares.append(rare)
                times.append(n)
                out.append((key["doc_id"], key["h"], words.classes[codes].tobytes(), len(codes), int(words.seen[codes].sum()), float(words.log_count[codes].sum()), float(within.value[codes].sum())))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(rares), pa.int64()), pa.array(np.concatenate(times), pa.int32())], fields=list(pair))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rares)]), pa.int32()), pairs).cast(arrow.field("rare").type)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=False)), lists], schema=arrow)

    # Texts become tokens once; training and scoring read the classes of these.
    keyed = docs.select(F.struct("doc_id", F.xxhash64("doc_id", "text").alias("h")).alias("key"), "text")
    encoded = scratch.keep(keyed.mapInArrow(encode, ENCODED).withColumn("row", F.monotonically_increasing_id()))
    mixed = _mixed(encoded.filter(~held_out(F.col("doc_id"), folds, fold)), start, noise, end, max(1, -(-total // GROUP_TOKENS)))
    final = sc.broadcast(mixed.flat())

    def score(batches):
        model = Model.of(final.value)
        prepared = model.prepared()
        for batch in batches:
            logs = [model.log10s(np.frombuffer(x.as_buffer(), np.int16).astype(np.int64), end, prepared).sum() for x in batch.column(6)]
            logs = pa.array(np.array(logs) + batch.column(5).to_numpy(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], logs], names=SCORED.names)

    scored = scratch.keep(encoded.select("row", "doc_id", "n_tokens", "n_known", "logs", "inner", "ids").mapInArrow(score, SCORED))
    joined = encoded.select("row", F.explode("rare").alias("x")).select("row", "x.h", "x.n").join(counts, "h")
    more = joined.groupBy("row").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("more"))
    out = scored.join(more, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * math.log10(total + types + 1)).alias("base_score"), (F.col("model_log") + more).alias("score"),
    )
