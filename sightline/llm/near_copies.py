"""Near-duplicates by word shingles: texts link when Jaccard reaches ``SIMILAR`` = 4/5.

A text is the set of its ``SHINGLE``-word shingles, as 64-bit hashes. First come SimHash fingerprints of
these: those within ``simhash.TAU`` bits meet through pigeonring chains (``simhash.links``), and the pairs that are
similar as sets connect their classes. Most similar sets differ in more bits (9.7 on average at 4/5), and no number of bits finds
them all, so an exact way follows for the rest: two sets
with Jaccard of 4/5 or more share one of the first n - ceil(4n/5) + 1 of their
shingles in any order that is the same for all texts, so these prefixes are the
join keys, and sizes and positions bound what a pair can still share. The order
has shingles that are frequent in a sample last, which changes the cost only.

A fingerprint of a set has the parity of its shingles in each of 2n buckets or more. Two
sets that differ in t shingles have fingerprints that differ in t bits at most, and
Jaccard of 4/5 allows t = (n + m) / 9. So candidates go through the pigeonring filter: the
bits lie on a ring of ``SEGMENTS``, and some chain of consecutive segments must stay within its
proportional share of t at each of its lengths, else the pair is pruned. Sets of what
is left are made again from the texts and held against each other shingle by shingle, so
links are exact up to 64-bit hashes.

Equal sets are one class and cost nothing more. First, one class of each key is compared with
all others that have the key: the one whose keys are the most popular, which in a group of
edited copies is the text that they come from. Pairs that this connects are done with. Of the
rest, a key that at most ``DENSE`` classes share is paired out, and a larger one
gets more such stars until its classes are in one component; what ``ROUNDS``
stars leave, or what is left with ``FEW`` pairs at most, is paired, but for pairs already connected. The
links of up to ``LINKS`` pairs are settled in one task and more in rounds; neither changes the result.

The text that a group comes from is in nearly all of its pairs, always as ``b``: its fingerprint and its set are dealt to
as many tasks as its pairs need. Where classes have many rows, one row stands for each.

Defined results: texts without words are one class and link with each other
only; texts below ``SHINGLE`` words are one shingle; the rest is as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHARS, Scratch, joined, rested, trimmed, word_hashes
from .simhash import components, first_rows
from .simhash import links as fingerprint_links

SHINGLE, SIMILAR = 5, (4, 5)
DENSE, ROUNDS, SAMPLE, SAMPLE_ROWS, OFTEN, MOST = 64, 4, 16, 20_000, 4, 200_000
SEGMENTS, MOST_BITS = 8, 1 << 16
#: Links that are settled in one task; more go in rounds.
LINKS = 1 << 18
#: Pairs that are compared against one copy of a set, and pairs that are few enough to need no stars.
SHARE, FEW = 256, 1 << 18
#: Bytes of a table's row groups.
ROW_GROUP = 8 << 20
FLUSH = 8 << 20
POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)

ROWS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()),
    T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType()), T.StructField("sim", T.LongType()),
])
SETS = T.StructType([T.StructField("fp", T.LongType()), T.StructField("items", T.BinaryType())])
ROOTS = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _set_of(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's words."""
    if not len(hashes):
        return hashes
    width = min(SHINGLE, len(hashes))
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        out += hashes[k : k + len(out)] * POWERS[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """The set of each text."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if sum(map(len, data)) > 4 * CHARS and len(data) > 1:
        return [x for t in texts for x in shingles([t])]
    h, begin = word_hashes(b"\n".join(data))
    edges = np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in data)]))
    return [_set_of(h[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def set_hash(items: np.ndarray) -> int:
    """Signed hash of a sorted set."""
    return int(np.uint64(xxhash.xxh64_intdigest(items.tobytes(), seed=42)).astype(np.int64))


def simhash_of(items: np.ndarray) -> int:
    """SimHash of a set, signed: a bit is 1 if it is set in over half of the shingle hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(items), 4096):
        ones += np.unpackbits(items[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(items), bitorder="little").view("<i8")[0])


def prefix(n: int) -> int:
    return n - (SIMILAR[0] * n + SIMILAR[1] - 1) // SIMILAR[1] + 1 if n else 0


def similar(common: int, n: int, m: int) -> bool:
    return SIMILAR[1] * common >= SIMILAR[0] * (n + m - common)


def apart(n: int, m: int) -> int:
    """Shingles in which similar sets of n and m can differ."""
    return (n + m) * (SIMILAR[1] - SIMILAR[0]) // (SIMILAR[0] + SIMILAR[1])


def parities(items: np.ndarray) -> bytes:
    """The fingerprint of a set: parity of its shingles by bucket."""
    width = min(MOST_BITS, max(64, 1 << (2 * len(items)).bit_length()))
    return np.packbits((np.bincount((items & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(bool), bitorder="little").tobytes()


def may_be_similar(x: bytes, y: bytes, n: int, m: int) -> bool:
    """The pigeonring filter on two fingerprints; true for all similar sets."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):  # a wider fingerprint folds to a narrower one
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    differ = np.bitwise_count(a ^ b).astype(np.int64)
    parts = differ.reshape(SEGMENTS, -1).sum(axis=1) if len(differ) >= SEGMENTS else differ
    # In units of a segment's share: chains from each start must not exceed their length.
    over = np.concatenate([[0], np.cumsum(np.append(parts, parts) * len(parts) - apart(n, m))])
    return any((over[k + 1 : k + 1 + len(parts)] <= over[k]).all() for k in range(len(parts)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Values of the first column and the sets of the last, some rows at a time."""
    for batch in batches:
        first, texts, size = [], [], 0
        for i, text in zip(batch.column(0), batch.column(batch.num_columns - 1), strict=True):
            first.append(i.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size > CHARS:
                yield first, shingles(texts)
                first, texts, size = [], [], 0
        if texts:
            yield first, shingles(texts)


def _often(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of a sample of texts have, sorted, and their counts there."""

    def run(batches):
        for _, sets in _texts(batches):
            keys = np.concatenate(sets).view(np.int64)
            keys, c = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c)], names=["key", "c"])

    every = max(SAMPLE, docs.count() // SAMPLE_ROWS)
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("doc_id", "text").mapInArrow(trimmed(run), "key long, c long")
    found = some.groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("c") >= OFTEN).orderBy(F.desc("c"), "key").limit(MOST).toArrow()
    keys, counts = (np.array(found.column(k).to_numpy()) for k in ("key", "c"))
    keys = keys.astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], counts[order].astype(np.int64)


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, fp (hash of the set), n, keys (its prefix in order) and bits (its fingerprint) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(_often(docs))

    def run(batches):
        often, counts = sent.value
        held, size = [], 0

        def out():
            cols = list(zip(*held, strict=True))
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cols[3])]), pa.int32()), pa.array(np.concatenate(cols[3]).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), keys, pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.int64())], names=ROWS.names)

        for ids, sets in _texts(batches):
            for i, items in zip(ids, sets, strict=True):
                p = prefix(len(items))
                first = items
                if p and len(often):
                    at = np.minimum(np.searchsorted(often, items), len(often) - 1)
                    frequent = often[at] == items
                    first = items[~frequent]
                    if len(first) < p:
                        rest = at[frequent]
                        first = np.concatenate([first, often[rest[np.lexsort((rest, counts[rest]))]]])
                held.append((i, set_hash(items), len(items), first[:p], parities(items), simhash_of(items)))
                size += p * 8 + 200 + len(held[-1][4])
            if size > FLUSH:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), ROWS)


def _may(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether sets of n and m shingles that share their first at these places can be similar."""
    most = F.lit(1) + F.least(n - F.lit(1) - pos, m - F.lit(1) - at)
    return (SIMILAR[0] + SIMILAR[1]) * most >= SIMILAR[0] * (n + m)


def _paired(keys: DataFrame) -> DataFrame:
    """Candidates (a, b) among all that share a key, of different roots."""
    x, y = (keys.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("fp", "n", "pos", "root"))) for s in "xy")
    return x.join(y, "key").filter((F.col("fp_x") < F.col("fp_y")) & (F.col("root_x") != F.col("root_y")) & _may(F.col("n_x"), F.col("pos_x"), F.col("n_y"), F.col("pos_y"))).select(F.col("fp_x").alias("a"), F.col("fp_y").alias("b")).distinct()


def _free(scratch: Scratch, *dfs: DataFrame) -> None:
    """Drop tables, and let Spark delete the shuffle files of queries that have ended."""
    scratch.drop(*dfs)
    scratch.spark.sparkContext._jvm.System.gc()


def _roots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (smallest node reachable) for the nodes of the links (a, b); a few links need no queries in rounds."""

    def run(batches):
        both = [np.array(batch.column(k)) for batch in batches for k in range(2)]
        nodes, at = np.unique(np.concatenate([*both[::2], *both[1::2], np.zeros(0, np.int64)]), return_inverse=True)
        a, b = np.split(at.astype(np.int64), 2)
        root, before = np.arange(len(nodes)), None
        while before is None or (root != before).any():
            before, x, y = root.copy(), root[a], root[b]
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], names=ROOTS.names)

    if edges.count() > LINKS:
        return components(edges, scratch)
    return scratch.keep(edges.select("a", "b").coalesce(1).mapInArrow(trimmed(run), ROOTS))


def _dealt(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (a, b) with the number of the copy of b that each meets, and (b, copy) of all copies: one for ``SHARE`` pairs."""
    copies = scratch.keep(pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).alias("copies")))
    dealt = joined(pairs, copies, ["b"], scratch).select("a", "b", F.pmod(F.xxhash64("a"), "copies").alias("copy"))
    return dealt, copies.select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))


def _pruned(pairs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that pass the pigeonring filter, written; b may be in most pairs, so its fingerprint is dealt out."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(6)]
            kept = [k for k, (x, y, n, m) in enumerate(zip(*cols[2:], strict=True)) if may_be_similar(x, y, n, m)]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in kept], pa.int64()) for c in cols[:2]], names=PAIRS.names)

    pairs = scratch.keep(pairs)
    if pairs.isEmpty():
        return pairs
    dealt, copies = _dealt(pairs, scratch)
    end = lambda s: classes.select(F.col("fp").alias(s), F.col("bits").alias(f"bits_{s}"), F.col("n").alias(f"n_{s}"))
    found = dealt.join(end("a"), "a").join(end("b").join(copies, "b"), ["b", "copy"])
    return scratch.keep(found.select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(trimmed(run), PAIRS))


def _sets(docs: DataFrame, asked: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """fp, items of the classes ``asked`` (fp), made from the texts of their least doc_ids; written."""

    def run(batches):
        for wanted, sets in _texts(batches):
            right = [(fp, x.tobytes()) for fp, x in zip(wanted, sets, strict=True) if set_hash(x) == fp]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in right], pa.int64()), pa.array([r[1] for r in right], pa.binary())], names=SETS.names)

    where = scratch.keep(rows.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = docs.select("doc_id", "text").join(where, F.col("doc_id").eqNullSafe(F.col("least"))).select("fp", "text").mapInArrow(trimmed(run), SETS)
    found = scratch.keep(found.dropDuplicates(["fp"]))
    _free(scratch, where)
    return found


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are similar, written; b may be in most pairs, so its set is copied, once for ``SHARE`` of them."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(2)]
            kept = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if similar(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)):
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in kept], pa.int64()) for c in cols], names=PAIRS.names)

    if pairs.isEmpty():
        return pairs
    sets = _sets(docs, pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), rows, scratch)
    dealt, copies = _dealt(pairs, scratch)
    # Both joins have the sets by fp, so Spark shuffles them once.
    ends = sets.join(copies.withColumnRenamed("b", "fp"), "fp").select(F.col("fp").alias("b"), F.col("items").alias("y"), "copy")
    with_a = sets.join(dealt.select(F.col("a").alias("fp"), "b", "copy"), "fp").select(F.col("fp").alias("a"), F.col("items").alias("x"), "b", "copy")
    found = scratch.keep(with_a.join(ends, ["b", "copy"]).select("a", "b", "x", "y").mapInArrow(trimmed(run), PAIRS))
    _free(scratch, sets)
    return found


def _near_fingerprints(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidates (a, b) whose SimHash fingerprints are equal or within ``TAU`` bits; one class stands for each fingerprint, as b."""
    sims = scratch.keep(classes.select("fp", "sim"))
    one = scratch.keep(sims.groupBy("sim").agg(F.max("fp").alias("b")))
    same = joined(sims, one, ["sim"], scratch).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    # A star's centre is the first of its links, and b here.
    near = fingerprint_links(one.select(F.col("sim").alias("fp")), scratch).select(F.col("a").alias("sim_b"), F.col("b").alias("sim_a"))
    ends = [one.select(F.col("sim").alias(f"sim_{c}"), F.col("b").alias(c)) for c in "ab"]
    return same.union(near.join(ends[0], "sim_a").join(ends[1], "sim_b").select("a", "b")).distinct()


def links(docs: DataFrame, rows: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect the distinct sets ``classes`` (fp, n, keys, bits, sim) as all similar pairs would."""

    def check(pairs: DataFrame) -> DataFrame:
        return _verified(_pruned(pairs, classes, scratch), docs, rows, scratch)

    near = check(_near_fingerprints(classes, scratch))
    rested(scratch.spark)
    keys = classes.select("fp", "n", F.posexplode("keys").alias("pos", "key")).select("key", "fp", "n", "pos")
    shared = scratch.keep(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    _free(scratch)
    some = scratch.keep(keys.join(shared, "key"))
    _free(scratch, shared)
    score = some.groupBy("fp").agg((F.sum("c") / F.max("n")).alias("score"))  # keys that no other has count nothing
    left = some.join(score, "fp")
    if near.isEmpty():
        left = left.withColumn("root", F.col("fp"))
    else:
        roots = _roots(near, scratch)
        left = left.join(roots, left.fp == roots.node, "left").drop("node").withColumn("root", F.coalesce("root", "fp"))
    left = scratch.keep(left)
    _free(scratch, some)
    rested(scratch.spark)

    def star(open_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of the most popular class of each key with the others, and the rows of all but that class."""
        best = F.max(F.struct("score", "fp", "n", "pos", "root")).alias("c")
        centres = scratch.keep(open_keys.groupBy("key").agg(best).select(F.col("key"), *(F.col(f"c.{k}").alias(f"c_{k}") for k in ("fp", "n", "pos", "root"))))
        near = open_keys.join(centres, "key").filter((F.col("root") != F.col("c_root")) & _may(F.col("n"), F.col("pos"), F.col("c_n"), F.col("c_pos")))
        # The centre is the more popular of a pair wherever they meet, so it is always b.
        found = check(near.select(F.col("fp").alias("a"), F.col("c_fp").alias("b")).distinct())
        return found, open_keys.join(centres.select("key", F.col("c_fp").alias("fp")), ["key", "fp"], "left_anti")

    def unconnected(now: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of keys that have classes of more than one component, with their roots."""
        rooted = now
        if not found.isEmpty():
            roots = _roots(found, scratch)
            rooted = now.drop("root").join(roots, now.fp == roots.node, "left").select(*(c for c in now.columns if c != "root"), F.coalesce("root", "fp").alias("root"))
        rooted = scratch.keep(rooted)
        several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        out = scratch.keep(rooted.join(several, "key", "left_semi"))
        _free(scratch, rooted)
        return out

    more, left = star(left)
    found = scratch.keep(near.union(more))
    left = unconnected(left, found)
    found = scratch.keep(found.union(check(_paired(left.filter(F.col("c") <= DENSE)))))
    left = left.filter(F.col("c") > DENSE)
    for turn in range(ROUNDS + 1):
        if left.isEmpty():
            break
        left = unconnected(left, found)
        pairs = left.groupBy("key").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0)).alias("pairs")).first()["pairs"]
        more, left = star(left) if turn < ROUNDS and pairs > FEW else (check(_paired(left)), left.limit(0))
        found = scratch.keep(found.union(more))
    return found


def _resolve(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp of the rows, and fp, root, component_id of the distinct sets."""
    rows = scratch.keep(shingled(docs).withColumn("row", F.monotonically_increasing_id()))
    named = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("row").alias("first"), F.count("*").alias("c")))
    copies = joined(rows.select("fp", "row"), named.filter("c > 1").select("fp", "first"), ["fp"], scratch).filter("row <> first").select("row")
    classes = rows.join(scratch.keep(copies), "row", "left_anti").select("fp", "n", "keys", "bits", "sim")
    linking = Scratch(docs.sparkSession, "near_copies_links", ROW_GROUP)
    edges = links(docs, named.select(F.col("least").alias("doc_id"), "fp"), classes, linking)
    rested(docs.sparkSession)
    if edges.isEmpty():
        named = named.select("fp", "least", F.col("fp").alias("root"))
    else:
        roots = _roots(edges, linking)
        named = named.join(roots, named.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = scratch.keep(named)
    linking.drop_all()
    least = scratch.keep(named.groupBy("root").agg(F.min("least").alias("component_id")))
    # Only rows of a class's least doc_id can stay, so that of very many equal texts few rows are left.
    firsts = named.select(F.col("least").alias("_least")).distinct()
    own = scratch.keep(rows.join(firsts, rows.doc_id.eqNullSafe(F.col("_least")), "left_semi").select("doc_id", "fp"))
    members = scratch.keep(named.select("fp", "root").join(least, "root"))
    scratch.drop(rows)
    return own, members


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each component one row of the smallest doc_id stays."""
    scratch = Scratch(docs.sparkSession, "near_copies", ROW_GROUP)
    own, members = _resolve(docs, scratch)
    return first_rows(docs, own, members, lambda text: set_hash(shingles([text])[0]), scratch)
