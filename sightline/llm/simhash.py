"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: 64 bits by majority over the XXH64 hashes (seed 42) of the
word shingles of a text.

Linking: two fingerprints link when they differ in at most ``TAU`` = 2 bits.
The 64 bits are laid on a ring of ``SEGMENTS`` = 5. By the pigeonring principle
some rotation starts a chain of consecutive segments in which the first l
segments differ together in at most l * TAU / SEGMENTS bits, for every l. So
the first two segments are equal, which is the join key (25 or 26 bits), the
first four differ in one bit at most, and all five in two. Candidates that fail the chain
are pruned before the full Hamming check, and each link comes from its first
rotation only.

Fingerprints are made distinct before they are joined, so copies cost nothing.
Where more than ``DENSE`` distinct fingerprints share a key, they are not
paired: each is listed under every value that the rest of its bits take with at
most one bit flipped. Two of them link if and only if they meet under some
value, all that meet under a value link, and there are 65 of these at most, so
a star in each value keeps every connection, at a cost linear in the group.

Components come from alternating large-star and small-star rounds over the
links, with every round's edges written to the shared folder.

Defined results: a null text counts as empty; texts without words have
fingerprint zero and link like any other; a null doc_id never names a component
unless all of its component are null, then component_id is null; repeated rows
are returned each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, map_batches

TAU, SEGMENTS, DENSE = 2, 5, 64
#: First bit of each segment, and one past the last.
BOUNDS = (0, 13, 26, 39, 52, 64)

FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Of one text, as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row."""

    def make():
        def work(cols):
            return [(i, fp - (1 << 64) if (fp := fingerprint(t, shingle)) >> 63 else fp) for i, t in zip(cols["doc_id"], cols["text"], strict=True)]

        return work

    return map_batches(docs.select("doc_id", "text"), FINGERPRINTS, make)


def _mask(first: int, n: int) -> int:
    """Of ``n`` consecutive segments from ``first`` on, as a signed 64-bit number."""
    m = 0
    for k in range(first, first + n):
        k %= SEGMENTS
        m |= (1 << BOUNDS[k + 1]) - (1 << BOUNDS[k])
    return m - (1 << 64) if m >> 63 else m


def _diff(x: Column, first: int, n: int) -> Column:
    return F.bit_count(x.bitwiseAND(F.lit(_mask(first, n))))


def _chain(x: Column, first: int) -> Column:
    """Whether the chain from segment ``first`` stays within its budgets."""
    ok = F.lit(True)
    for n in range(1, SEGMENTS):
        ok = ok & (_diff(x, first, n) <= n * TAU // SEGMENTS)
    return ok


def _by_rotation(rot: Column, make: Callable[[int], Column]) -> Column:
    out = make(SEGMENTS - 1)
    for k in reversed(range(SEGMENTS - 1)):
        out = F.when(rot == k, make(k)).otherwise(out)
    return out


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` within TAU bits."""
    keys = scratch.keep(fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("rot"), F.col("fp").bitwiseAND(F.lit(_mask(k, TAU))).alias("key")) for k in range(SEGMENTS)))).alias("x")).select("x.rot", "x.key", "fp"))
    shared = scratch.keep(keys.groupBy("rot", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    some = scratch.keep(keys.join(shared, ["rot", "key"]))
    few = some.filter(F.col("n") <= DENSE).drop("n")
    x = F.col("a").bitwiseXOR(F.col("b"))
    earlier = _by_rotation(F.col("rot"), lambda k: ~_any([_chain(x, j) for j in range(k)]))
    pairs = (
        few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["rot", "key"])
        .filter(F.col("a") < F.col("b")).filter(_by_rotation(F.col("rot"), lambda k: _chain(x, k)) & earlier)
        .filter(F.bit_count(x) <= TAU).select("a", "b")
    )
    rest = _by_rotation(F.col("rot"), lambda k: F.array(F.lit(0).cast("bigint"), *(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("bigint") for b in _bits(k))))
    around = some.filter(F.col("n") > DENSE).select("fp", F.explode(rest).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    stars = around.groupBy("v").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.union(stars)


def _any(found: list[Column]) -> Column:
    out = F.lit(False)
    for x in found:
        out = out | x
    return out


def _bits(first: int) -> list[int]:
    """The bits outside the key that starts at segment ``first``."""
    m = _mask(first, TAU) % (1 << 64)
    return [b for b in range(64) if not m >> b & 1]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (smallest node reachable) for every node of the links (a, b)."""
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        # Large star: greater neighbours go to the smallest of the neighbourhood.
        both = now.union(now.select("b", "a"))
        low = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = scratch.keep(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: lesser neighbours and the node itself go to the smallest of them.
        least = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        after = scratch.keep(large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(now, low, large, least)
        found = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        now = after
        if found == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = found


def _resolve(docs: DataFrame, shingle: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows, and fp, root, component_id of the distinct fingerprints."""
    own = scratch.keep(fingerprints(docs, shingle))
    classes = scratch.keep(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = scratch.keep(links(classes.select("fp"), scratch))
    roots = components(edges, scratch)
    named = scratch.keep(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = scratch.keep(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return own, scratch.keep(named.select("fp", "root").join(least, "root"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row."""
    own, members = _resolve(docs, shingle, Scratch(docs.sparkSession, "simhash"))
    return own.join(members, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` without near-duplicates: of each component one row of the smallest doc_id stays.

    Where that doc_id is repeated, or null throughout the component, the least
    of its rows stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own, members = _resolve(docs, shingle, scratch)
    return first_rows(docs, own, members, lambda text: int(np.uint64(fingerprint(text, shingle)).astype(np.int64)), scratch)


def first_rows(docs: DataFrame, own: DataFrame, members: DataFrame, fp_of_text: Callable[[str | None], int], scratch: Scratch) -> DataFrame:
    """One row of ``docs`` for each component, by the fingerprints (signed) of its rows and the components of these."""
    first = own.join(members, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = scratch.keep(first.groupBy("doc_id").agg(F.count("*").alias("n")))
    single, several = kept.filter("n = 1 and doc_id is not null").select("doc_id"), kept.filter("n > 1 or doc_id is null").select(F.col("doc_id").alias(fresh(docs)))

    @F.pandas_udf("long")
    def fp_of(text: pd.Series) -> pd.Series:
        return pd.Series([fp_of_text(t) for t in text], dtype="int64")

    whole = docs.join(single, "doc_id", "left_semi").select(docs.columns)
    if several.isEmpty():
        return whole
    odd = docs.join(several, docs.doc_id.eqNullSafe(F.col(fresh(docs))), "left_semi").select(F.struct(*docs.columns).alias("row"), fp_of("text").alias("fp"))
    odd = odd.join(members, "fp").filter(F.col("row.doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    return whole.unionByName(odd)
