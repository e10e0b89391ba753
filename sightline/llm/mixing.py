"""Mixing sources to target weights.

Each source's documents are laid end to end and cut into blocks of ``block``
words (the last one may be short). The mix is a sequence of slots of one block
each, dealt into output shards. Each shard draws how many of its slots go to each source:
a multinomial draw, seeded by the shard's number, so that it needs no other shard.
The slots of a source are numbered through the shards. Where the draws of all shards
together give a source more slots than its target needs, the last of them go to the sources that got too
few, so every source has its exact number. Slot q of a source
takes block perm(q mod n) of pass q div n, where perm is a pseudorandom
permutation (a Feistel network that walks cycles) keyed by source and pass.
Slots and blocks meet in a join on source and block index.

Targets: sources in code point order, null last, weigh 1, 2, 3, repeating, and
share the words of all documents. A target stops at ``most`` times its source's
size; the excess is shared again by weight among the others until none is above.

The last slot of a source is cut where its target (rounded to whole words) is
reached, and a source takes whole passes over its blocks first, so a document
is taken ``most`` times its size at most and a source's words meet its target.

Repeated rows are counted before they are placed, and prefix sums run in two levels (pieces
of about the square root of the number of documents), so neither a hot source nor a
row that is repeated often is gathered in one task. One row for each source is
collected for the targets and broadcast (about 50 bytes each); sources are labels of origin,
and nothing else that is broadcast grows with the documents.

Defined results: a null text counts as empty; documents without words are
returned with taken 0; a null doc_id is passed on, and the order of packing is
by a hash of doc_id and text; repeated rows are packed each on their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch

BLOCK, SHARD_SLOTS, MOST = 512, 1024, 3
#: Shards whose draws are added up together.
CHUNK = 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], total: int, most: float = MOST) -> list[float]:
    """Words for each source: by weight, ``most`` times its size at most, the excess reshared."""
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    left = float(total)
    while free:
        share = left / sum(weights[i] for i in free)
        over = [i for i in free if share * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = share * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Image of ``index`` under a pseudorandom permutation of 0..n-1, or under its inverse."""
    half = max(1, math.ceil((n - 1).bit_length() / 2))
    low, half_ = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(4)]

    def mix(x: np.ndarray, k: np.uint64) -> np.ndarray:
        m = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (m >> np.uint64(32)) & low

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> half_, x & low
        for k in reversed(keys) if back else keys:
            a, b = (b ^ mix(a, k), a) if back else (b, a ^ mix(b, k))
        return a << half_ | b

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (outside := out >= n).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


class Mix:
    """What all shards draw from, by source: slots wanted, blocks, words, and the slot that is cut."""

    def __init__(self, sizes: list[int], goals: list[float], block: int, shard_slots: int, seed: int):
        self.block, self.shard_slots, self.seed = block, shard_slots, seed
        self.sizes = np.array(sizes, np.int64)
        self.blocks = -(-self.sizes // block)
        self.quota = np.zeros(len(sizes), np.int64)
        self.cut_at, self.cut_to = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
        # Whole passes first; of the last pass so many slots as could be needed, the short block included.
        for i, (n, s, goal) in enumerate(zip(self.blocks.tolist(), sizes, goals, strict=True)):
            w = round(goal)
            p = w // s if s else 0
            r = w - p * s
            self.quota[i] = n * p
            if not r:
                continue
            short, k = s - (n - 1) * block, -(-r // block)
            where = int(permuted(np.array([n - 1]), n, _key(seed, i, p), back=True)[0]) if short < block else k
            got = r - ((k - 1) * block)
            if where < k:  # the short block is among them: go on until the words are reached
                have = (k - 1) * block + short
                if have < r:
                    k += 1
                    got = r - have
                else:
                    got = r - (have - (short if where == k - 1 else block))
            self.quota[i] += k
            self.cut_at[i], self.cut_to[i] = n * p + k - 1, got
        self.slots = int(self.quota.sum())
        self.shards = -(-self.slots // shard_slots)
        self.cumulated = np.cumsum(self.quota)

    def drawn(self, shard: int) -> np.ndarray:
        """The source of each slot of a shard: independent draws by quota, so their counts are multinomial."""
        n = min(self.shard_slots, self.slots - shard * self.shard_slots)
        return np.searchsorted(self.cumulated, np.random.default_rng([self.seed, self.shards, shard]).integers(0, self.slots, n), side="right")

    def settle(self, totals: np.ndarray) -> None:
        """``totals``: slots that all shards have drawn of each source; what is too much goes to where it is too little."""
        self.totals, over, under = totals, np.maximum(totals - self.quota, 0), np.maximum(self.quota - totals, 0)
        self.over, self.under = np.cumsum(over) - over, np.cumsum(under)

    def chunk(self, shards: range, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """shard, slot, source, block and words of every slot of some shards, after ``before`` slots of each source."""
        drawn = [self.drawn(s) for s in shards]
        shard, slot = np.repeat(np.array(shards), [len(x) for x in drawn]), np.concatenate([np.arange(len(x)) for x in drawn])
        source = np.concatenate(drawn)
        order = np.argsort(source, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(source[order]) > 0))
        q = np.empty(len(source), np.int64)
        q[order] = np.arange(len(source)) - np.repeat(first, np.diff(np.append(first, len(source))))
        q += before[source]
        much = np.flatnonzero(q >= self.quota[source])
        if len(much):
            r = self.over[source[much]] + q[much] - self.quota[source[much]]
            to = np.searchsorted(self.under, r, side="right")
            begin = np.append(0, self.under)[to]
            source[much], q[much] = to, self.totals[to] + r - begin
        n = self.blocks[source]
        turn, at, block = q // n, q % n, np.empty(len(q), np.int64)
        order = np.lexsort((turn, source))
        cut = np.flatnonzero((np.diff(source[order]) != 0) | (np.diff(turn[order]) != 0)) + 1
        for part in np.split(order, cut):
            i = int(source[part[0]])
            block[part] = permuted(at[part], int(self.blocks[i]), _key(self.seed, i, int(turn[part[0]])))
        words = np.minimum(self.block, self.sizes[source] - block * self.block)
        return shard, slot, source, block, np.where(q == self.cut_at[source], self.cut_to[source], words)


SLOTS = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("source_no", T.IntegerType()),
    T.StructField("block", T.LongType()), T.StructField("cut", T.LongType()),
])


def mixed(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, most: int = MOST, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(documents, slots): the packed documents, and the mix.

    documents: doc_id, size, source, source_no, source_size, target, at (its
    first word's place in the source). slots: shard, slot, source_no, block,
    cut (words of the block that the slot takes), in the order of the mix.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64("doc_id", "text").alias("order"))
    sized = scratch.keep(rows.groupBy("doc_id", "source", "size", "order").agg(F.count("*").alias("copies")))
    by_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("n")).collect()
    by_source.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes, n_rows = [r["size"] for r in by_source], sum(r["n"] for r in by_source)
    goals = targets(sizes, [1.0 + i % 3 for i in range(len(sizes))], sum(sizes), most)
    table = scratch.keep(spark.createDataFrame([(r["source"], i, int(r["size"]), float(g)) for i, (r, g) in enumerate(zip(by_source, goals, strict=True))], "source string, source_no int, source_size bigint, target double"))
    # Two-level prefix sums: pieces of a source first, then the documents of a piece.
    pieces = max(1, math.isqrt(n_rows))
    sized = sized.withColumn("piece", F.pmod("order", F.lit(pieces))).withColumn("all", F.col("size") * F.col("copies"))
    before = "sum({0}) over (partition by {1} order by {2} rows between unbounded preceding and 1 preceding)"
    starts = scratch.keep(sized.groupBy("source", "piece").agg(F.sum("all").alias("piece_size")).withColumn("piece_at", F.expr(f"coalesce({before.format('piece_size', 'source', 'piece')}, 0)")).select(F.col("source").alias("s"), F.col("piece").alias("p"), "piece_at"))
    placed = scratch.keep(sized.withColumn("in_piece", F.expr(f"coalesce({before.format('`all`', 'source, piece', '`order`, doc_id, size')}, 0)")))
    placed = placed.join(starts, placed.source.eqNullSafe(starts.s) & (placed.piece == starts.p)).join(F.broadcast(table.withColumnRenamed("source", "t")), placed.source.eqNullSafe(F.col("t")))
    # Copies of a row stand one after the other; their numbers come in two steps, so no array is long.
    far = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.shiftright(F.col("copies") - 1, 16)))).withColumn("copy", F.explode(F.sequence(F.shiftleft("k", 16), F.least(F.col("copies") - 1, F.shiftleft(F.col("k") + 1, 16) - 1))))
    placed = scratch.keep(far.select("doc_id", "source", "source_no", "size", "source_size", "target", (F.col("piece_at") + F.col("in_piece") + F.col("copy") * F.col("size")).alias("at")))

    mix = Mix(sizes, goals, block, shard_slots, seed)
    sent = spark.sparkContext.broadcast(mix)
    chunks = spark.range(0, -(-mix.shards // CHUNK), 1, max(1, min(4096, -(-mix.shards // CHUNK)))).toDF("chunk")

    def own(chunk: int) -> range:
        return range(chunk * CHUNK, min(mix_shards, (chunk + 1) * CHUNK))

    mix_shards = mix.shards

    def count(batches):
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                source, n = np.unique(np.concatenate([sent.value.drawn(s) for s in own(chunk)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), pa.array(source, pa.int64()), pa.array(n, pa.int64())], names=["chunk", "source_no", "n"])

    counts = scratch.keep(chunks.mapInArrow(count, "chunk long, source_no long, n long"))
    totals = np.zeros(len(sizes), np.int64)
    for r in counts.groupBy("source_no").agg(F.sum("n").alias("n")).collect():
        totals[r["source_no"]] = r["n"]
    mix.settle(totals)
    settled = spark.sparkContext.broadcast(mix)
    starts = counts.withColumn("before", F.expr(f"coalesce({before.format('n', 'source_no', 'chunk')}, 0)"))
    starts = scratch.keep(starts.groupBy("chunk").agg(F.collect_list(F.struct("source_no", "before")).alias("b")))
    arrow = to_arrow_schema(SLOTS)

    def make(batches):
        for batch in batches:
            for chunk, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.zeros(len(settled.value.sizes), np.int64)
                for x in known:
                    at[x["source_no"]] = x["before"]
                cols = settled.value.chunk(own(chunk), at)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return placed, starts.select("chunk", "b").mapInArrow(make, SLOTS)


def _key(seed: int, source_no: int, turn: int) -> int:
    return (seed << 64) + (source_no << 32) + turn


def taken(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every row: slots joined with blocks by index."""
    scratch = Scratch(docs.sparkSession, "mixing-taken")
    placed, slots = mixed(docs, block, **options)
    full = F.sum(F.when(F.col("full"), 1).otherwise(0)).alias("times")
    slots = slots.withColumn("full", F.col("cut") == block)
    used = scratch.keep(slots.groupBy("source_no", "block").agg(full, F.collect_list(F.when(~F.col("full"), F.col("cut"))).alias("cuts")))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    spans = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block))
    part = F.aggregate(F.transform("cuts", lambda c: F.greatest(F.least(hi, c) - lo, F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    words = F.coalesce(F.col("times") * (hi - lo) + part, F.lit(0))
    keys = ["doc_id", "size", "source", "source_size", "target"]
    got = spans.join(used, ["source_no", "block"], "left").groupBy(*keys, "source_no", "at").agg(F.sum(words).cast("bigint").alias("taken"))
    return got.select(*keys, "taken").union(placed.filter("size = 0").select(*keys, F.lit(0).cast("bigint").alias("taken")))
