"""Suffix-array deduplication by merged Burrows-Wheeler transforms.

Every byte covered by a string of ``LENGTH`` = 200 bytes that starts anywhere
else too is removed; matches never cross documents.

1. Anchors. Each 200-byte window is represented by the least, by hash, of its
   128-byte strings (its minimizer; the leftmost of equals). Equal windows have
   equal anchors at equal places, so a window whose anchor's hash is unique in the corpus
   is unique. Runs of windows with the same anchor make one context: the bytes
   that these windows cover. Anchors are counted over all documents.
2. Contexts of repeated anchors, made distinct with their numbers. A context
   that occurs twice is repeated in all its windows. Where an anchor has one
   context only, nothing else is to be compared.
3. The other contexts go, by anchor, to batches. An anchor stands as one symbol in its
   contexts, which is exact for strings that share it and shortens them. A
   batch's contexts are split into shards; each shard's suffixes are sorted and give its
   Burrows-Wheeler transform; the transforms are merged by iterative interleave
   refinement: the rows of all shards start in shard order, and each round moves
   every row to its last-to-first place, stably by preceding symbol, so that
   after h rounds rows are in the order of their first h symbols. Rows that still are in one
   block after as many rounds as a window has symbols form a repeated interval;
   the round in which neighbours part is their common prefix. No suffix is sorted again.
   Only rows at which a window ends go through the rounds, as far as its start, and a row
   that is alone in its block leaves: equal windows are in one block in every round.
4. An anchor with over ``MOST`` distinct contexts is not gathered in one batch: its windows
   are counted by hash instead, which is exact too and aggregates before the shuffle.
5. Repeated windows are joined back to the occurrences, and removed.

Strings are held equal when a 64-bit hash of the anchor and one of the context
agree together.

Defined results: a null text counts as empty; texts shorter than 200 bytes lose
nothing; a repeated row is another place, so both lose what is long enough; a
null doc_id is passed on; an empty table gives an empty result; other columns
are ignored. ``kept_text`` drops a code point of which bytes were removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, map_batches, trim, trimmed

LENGTH, ANCHOR = 200, 128
SPAN = LENGTH - ANCHOR + 1  # windows that can share one anchor; also the symbols of a window whose anchor is one
MOST, BATCH_SYMBOLS, SHARD_SYMBOLS, SEGMENT = 1024, 250_000, 4096, 500_000
_PLACE = np.uint64((1 << 20) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _hashes(data: np.ndarray) -> np.ndarray:
    """Of every string of ANCHOR bytes, by doubling."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * _A
        h ^= h >> np.uint64(32)
        n = 1
        while n < ANCHOR:
            h = (h[:-n] * _B) ^ (h[n:] + np.uint64(n) * _A)
            h *= _A
            h ^= h >> np.uint64(29)
            n *= 2
    return h


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive numbers."""
    k = 1
    while 2 * k <= n:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (n - k)], x[n - k :]) if k < n else x


def contexts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first byte, number of windows and place of the anchor of every context."""
    out = []
    for at in range(0, len(data) - LENGTH + 1, SEGMENT):
        h = _hashes(np.frombuffer(data, np.uint8)[at : at + SEGMENT + LENGTH - 1])
        place = (_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), SPAN) & _PLACE).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(start, len(place)))
        out.append((h[place[start]].astype(np.int64), start + at, count, place[start] - start))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def transform(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of strings (symbols from 1 on), last-to-first map, and suffix array.

    Each string ends with a symbol 0 of its own. Rows of these ends come first.
    """
    flat = np.concatenate([x for s in strings for x in (s, [0])]).astype(np.uint16)
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    n, k = len(flat), 1
    rank = flat.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    while True:  # by the first k symbols; ends differ, so that no order reaches past them
        rows = np.argsort(rank)
        own = rank[rows]
        place = np.cumsum(np.append(False, own[1:] != own[:-1]))
        rank[rows] = place
        if place[-1] == n - 1:
            break
        rank = rank * n + rank[np.minimum(np.arange(k, n + k), n - 1)]
        k *= 2
    before = np.roll(flat, 1)[rows]
    to = np.zeros(len(rows), np.int64)
    live = np.flatnonzero(before)
    to[live[np.argsort(before[live], kind="stable")]] = np.arange(len(ends), len(rows))
    return before, to, rows


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (numbered through the shards) in merged order, the block of each, and
    the common prefix of each row with the one before it (``depth`` where it is that or more)."""
    sizes = [len(b) for b, _, _ in shards]
    first = np.cumsum([0, *sizes[:-1]])
    before = np.concatenate([b for b, _, _ in shards])
    to = np.concatenate([t + f for (_, t, _), f in zip(shards, first, strict=True)])
    ends = np.concatenate([f + np.arange(np.count_nonzero(b == 0)) for (b, _, _), f in zip(shards, first, strict=True)])
    n, m = len(before), len(ends)
    rows, block = np.arange(n), np.zeros(n, np.int64)
    prefix = np.full(n, depth, np.int64)
    for h in range(depth):
        symbol = before[rows]
        live = np.flatnonzero(symbol)
        symbol = symbol[live]
        order = np.argsort(symbol, kind="stable")
        symbol, moved = symbol[order], live[order]
        old = block[moved]
        new = np.ones(n, bool)
        new[m + 1 :] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        rows = np.concatenate([ends, to[rows[moved]]])
        block = np.cumsum(new)
        prefix[new & (prefix == depth)] = h
    return rows, block, prefix


def repeated_ends(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ends: np.ndarray, depth: int) -> np.ndarray:
    """Those of the rows ``ends`` (numbered through the shards) that have the same ``depth`` symbols before them as some other has.

    The rounds of ``merge`` for these rows alone: each goes to its last-to-first place, stably by preceding symbol,
    and a row that is by itself in its block is left out, since it stays so.
    """
    first = np.cumsum([0, *(len(b) for b, _, _ in shards[:-1])])
    before = np.concatenate([b for b, _, _ in shards])
    to = np.concatenate([t + f for (_, t, _), f in zip(shards, first, strict=True)])
    rows = ends
    block = np.zeros(len(rows), np.int32)
    for _ in range(depth):
        symbol = before[rows]
        order = np.argsort(symbol, kind="stable")
        symbol, block = symbol[order], block[order]
        new = np.ones(len(rows) + 1, bool)
        new[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        several = np.flatnonzero(~(new[:-1] & new[1:]))
        order, block = order[several], np.cumsum(new[:-1], dtype=np.int32)[several]
        rows, ends = to[rows[order]], ends[order]
    return ends


def repeated_windows(groups: list[list[tuple[bytes, int]]]) -> list[list[np.ndarray]]:
    """For each anchor's distinct contexts (bytes, place of the anchor): the windows
    of each that some other context of the same anchor has as well."""
    strings, where = [], []
    for g, members in enumerate(groups):
        for k, (data, off) in enumerate(members):
            raw = np.frombuffer(data, np.uint8).astype(np.uint16) + 1
            strings.append(np.concatenate([raw[:off], [257 + g], raw[off + ANCHOR :]]).astype(np.uint16))
            where.append((g, k))
    shards, at, owner, offset = [], 0, [], []
    while at < len(strings):
        to, total = at, 0
        while to < len(strings) and (to == at or total + len(strings[to]) < SHARD_SYMBOLS):
            total += len(strings[to])
            to += 1
        shards.append(transform(strings[at:to]))
        lengths = [len(s) + 1 for s in strings[at:to]]
        own = np.repeat(np.arange(at, to), lengths)
        start = np.concatenate([np.arange(k) for k in lengths])
        owner.append(own[shards[-1][2]])
        offset.append(start[shards[-1][2]])
        at = to
    owner, offset = np.concatenate(owner), np.concatenate(offset)
    length = np.array([len(s) for s in strings])
    off = np.array([off for members in groups for _, off in members])
    x = offset - SPAN  # of the window that ends before the row's suffix
    found = repeated_ends(shards, np.flatnonzero((x >= 0) & (x <= off[owner]) & (offset <= length[owner])), SPAN)
    owner, offset = owner[found], offset[found] - SPAN
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * len(members) for members in groups]
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1) if len(owner) else []:
        g, k = where[owner[part[0]]]
        out[g][k] = offset[part]
    return out


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive numbers as (first, last)."""
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x) > 1)
    return list(zip(x[np.append(0, cut + 1)].tolist(), x[np.append(cut, len(x) - 1)].tolist(), strict=True))


ANCHORS = T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])
PLACES = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "r", "h", "c", "place")])
RUNS = T.StructType([T.StructField(c, T.LongType()) for c in ("h", "c", "lo", "hi")])
WINDOWS = T.StructType([T.StructField(c, T.LongType()) for c in ("h", "c", "w", "x")])
RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("r", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))),
])


def _arrow(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, held = [], 0
        for text in batch.column(0):
            parts.append(contexts((text.as_py() or "").encode())[0])
            held += len(parts[-1])
            if held > 200_000:
                yield _arrow(np.unique(np.concatenate(parts), return_counts=True), ANCHORS.names)
                parts, held = [], 0
        if held:
            yield _arrow(np.unique(np.concatenate(parts), return_counts=True), ANCHORS.names)


def _list_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, held = [], 0
        for doc_id, r, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            data = (text.as_py() or "").encode()
            h, start, count, off = contexts(data)
            if not len(h):
                continue
            end = start + count - 1 + LENGTH
            c = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b], seed=o) for a, b, o in zip(start.tolist(), end.tolist(), off.tolist(), strict=True)), np.uint64, len(h)).astype(np.int64)
            parts.append((np.full(len(h), doc_id.as_py()), np.full(len(h), r.as_py()), h, c, start << 20 | count << 10 | off))
            held += len(h)
            if held > 100_000:
                yield _arrow([np.concatenate(x) for x in zip(*parts, strict=True)], PLACES.names)
                parts, held = [], 0
        if held:
            yield _arrow([np.concatenate(x) for x in zip(*parts, strict=True)], PLACES.names)


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, data, off) in the order of h; whole groups are merged in batches."""
    names: list[tuple[int, list[int]]] = []
    groups: list[list[tuple[bytes, int]]] = []
    symbols = 0

    def done() -> pa.RecordBatch:
        rows = [(h, c, lo, hi) for (h, cs), found in zip(names, repeated_windows(groups), strict=True) for c, x in zip(cs, found, strict=True) for lo, hi in _runs(x)]
        return _arrow(list(zip(*rows, strict=True)) if rows else [[]] * 4, RUNS.names)

    for batch in batches:
        for h, c, data, off in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if not names or names[-1][0] != h:
                if symbols > BATCH_SYMBOLS or len(names) > 60_000:
                    yield done()
                    names, groups, symbols = [], [], 0
                names.append((h, []))
                groups.append([])
            names[-1][1].append(c)
            groups[-1].append((data, off))
            symbols += len(data) - ANCHOR + 2
    if names:
        yield done()


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(h, c, w, xxhash.xxh3_64_intdigest(data[w : w + LENGTH]) - (1 << 63)) for h, c, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for w in range(len(data) - LENGTH + 1)]
        for at in range(0, len(rows), 50_000):
            yield _arrow(list(zip(*rows[at : at + 50_000], strict=True)), WINDOWS.names)


def repeats(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): doc_id, r, text of every row; doc_id, r and the list of repeated byte spans of those that have any."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("r"), "text")
    keyed = rows.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "r", "text")
    anchors = scratch.keep(docs.select("text").mapInArrow(trimmed(_count_anchors), ANCHORS).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
    places = scratch.keep(keyed.mapInArrow(trimmed(_list_contexts), PLACES).join(anchors, "h", "left_semi"))
    distinct = scratch.keep(places.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "r", "place")).alias("at")))
    several = scratch.keep(distinct.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1"))
    wanted = scratch.keep(distinct.select("h", "c", "at.*").join(several, "h"))
    shift = lambda k, n: F.shiftright("place", k).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    data = F.substring(F.col("text").cast("binary"), F.shiftright("place", 20).cast("int") + 1, shift(10, 10) + LENGTH - 1)
    listed = keyed.join(wanted.groupBy("doc_id", "r").agg(F.collect_list(F.struct("h", "c", "place", "k")).alias("w")), ["doc_id", "r"]).dropDuplicates(["doc_id", "r"])
    bodies = scratch.keep(listed.select("text", F.explode("w").alias("x")).select("x.*", "text").select("h", "c", "k", data.alias("data"), shift(0, 10).alias("off")))
    few = bodies.filter(F.col("k") <= MOST).select("h", "c", "data", "off").repartition("h").sortWithinPartitions("h").mapInArrow(trimmed(_merge_batches), RUNS)
    windows = scratch.keep(bodies.filter(F.col("k") > MOST).select("h", "c", "data").mapInArrow(trimmed(_window_hashes), WINDOWS))
    shared = windows.groupBy("h", "x").agg(F.count("*").alias("k")).filter("k > 1")
    many = windows.join(shared, ["h", "x"]).select("h", "c", F.col("w").alias("lo"), F.col("w").alias("hi"))
    whole = distinct.filter("n > 1").select("h", "c", F.lit(0).cast("bigint").alias("lo"), F.shiftright("at.place", 10).bitwiseAND(F.lit(1023)).cast("bigint").alias("hi") - 1)
    runs = scratch.keep(few.union(many).union(whole))
    start = F.shiftright("place", 20)
    spans = places.join(runs, ["h", "c"]).select("doc_id", "r", (start + F.col("lo")).alias("from"), (start + F.col("hi") + LENGTH).alias("to"))
    spans = scratch.keep(spans.groupBy("doc_id", "r").agg(F.collect_set(F.struct("from", "to")).alias("spans")))
    scratch.drop(anchors, places, distinct, several, wanted, bodies, windows, runs)
    return rows, spans


def _cut(data: bytes, spans: list[dict]) -> tuple[bytes, list[dict]]:
    """What is left, and the maximal removed runs."""
    merged: list[dict] = []
    for s in sorted(spans, key=lambda s: s["from"]):
        if merged and s["from"] <= merged[-1]["to"]:
            merged[-1]["to"] = max(merged[-1]["to"], s["to"])
        else:
            merged.append(dict(s))
    parts, at = [], 0
    for s in merged:
        parts.append(data[at : s["from"]])
        at = s["to"]
    return b"".join([*parts, data[at:]]), merged


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (binary), removed (byte spans) of every row."""
    scratch = Scratch(docs.sparkSession, "bwt")
    rows, spans = repeats(docs, scratch)
    spans = spans.withColumnsRenamed({"doc_id": "i", "r": "q"})
    joined = rows.join(spans, (F.coalesce(rows.doc_id, F.lit(-1)) == spans.i) & (rows.r == spans.q), "left").select("doc_id", "r", "text", "spans")

    def make():
        def work(c):
            out = []
            for i, r, t, s in zip(c["doc_id"], c["r"], c["text"], c["spans"], strict=True):
                data = (t or "").encode()
                out.append((i, r, len(data), *_cut(data, s or [])))
            return out

        return work

    return map_batches(joined, RESULT, make, slice_rows=64)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return deduplicated(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes taken out of text (n_chars follows, where there is one)."""
    scratch = Scratch(docs.sparkSession, "bwt")
    rows, spans = repeats(docs, scratch)
    i, r, own = (fresh(docs, k) for k in range(3))
    spans = spans.withColumnsRenamed({"doc_id": i, "r": r, "spans": own})
    joined = docs.join(spans, (F.coalesce("doc_id", F.lit(-1)) == F.col(i)) & (F.xxhash64("doc_id", "text") == F.col(r)), "left")

    @F.pandas_udf("string")
    def kept(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, spans in parts:
            yield text.combine(spans, lambda t, s: t if s is None else _cut(t.encode(), list(s))[0].decode(errors="ignore"))
        trim()

    cut = joined.withColumn("text", F.when(F.col(own).isNull(), F.col("text")).otherwise(kept("text", own)))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)
