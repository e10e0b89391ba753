"""Token counts by heap-and-linked-list byte-pair merging.

Symbols of a chunk form a doubly linked list, and every adjacent pair that the
vocabulary knows waits in a heap by its rank. The lowest rank is popped and
merged until none is left; the number of tokens is the number of symbols at the
start minus the number of merges. No identifiers are produced.

The vocabulary is a sentencepiece BPE model. A symbol that it lacks costs one
token for each of its UTF-8 bytes (byte fallback). Texts are cut at places that
no merge can cross, which is read from the vocabulary itself, and counts of
chunks are kept in a bounded memo; both leave the counts as they are.

Defined results: a null text counts as empty; an empty text has no tokens; a
null doc_id is passed on; repeated rows are counted each; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import cache
from heapq import heapify, heappop, heappush
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches

SPACE = "▁"
#: Chunks in each of the two generations that a worker remembers, and the longest that it does.
MEMO_CHUNKS, MEMO_CHARS = 500_000, 48
PLACE = 40
LOW = (1 << PLACE) - 1

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
])


class Merger:
    """Counts tokens of texts by the merges of one sentencepiece BPE model."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and identity normalisation are counted")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not counted")
        pieces = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        by_score = sorted({s for _, s in pieces}, reverse=True)
        place = {s: i for i, s in enumerate(by_score)}
        self.rank = {p: place[s] for p, s in pieces}
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        joined = {c for p, _ in pieces if len(p) > 1 for c in p}
        # No merge crosses from another character to a space, nor touches a character that occurs in no longer piece.
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        loose = "\n" not in joined
        nl = "\n" if loose else ""
        self.chunks = None if crossing else re.compile(f"{SPACE}*[^{SPACE}{nl}]+|{SPACE}+" + ("|\n" if loose else "")).findall
        self.single = {p for p in self.rank if len(p) == 1}
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merge(self, chunk: str) -> int:
        n, rank = len(chunk), self.rank.get
        total = n
        if not self.single.issuperset(chunk):
            total += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in chunk if c not in self.single)
        # An entry holds a pair's rank and, in the low bits, the place of its left symbol.
        heap = [r << PLACE | i for i, r in enumerate(map(rank, map(add, chunk, chunk[1:]))) if r is not None]
        if not heap:
            return total
        heapify(heap)
        piece: list[str] = list(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & LOW
            left = piece[i]
            if not left or (j := after[i]) >= n:
                continue
            joined = left + piece[j]
            if rank(joined) != entry >> PLACE:
                continue
            piece[i], piece[j] = joined, ""
            k = after[i] = after[j]
            total -= 1
            if k < n:
                before[k] = i
                if (r := rank(joined + piece[k])) is not None:
                    heappush(heap, r << PLACE | i)
            if (h := before[i]) >= 0 and (r := rank(piece[h] + joined)) is not None:
                heappush(heap, r << PLACE | h)
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = self.prefix + text.replace(" ", SPACE)
        if self.chunks is None:
            return self.merge(text)
        memo, total, found = self.memo, 0, self.chunks(text)
        try:
            return sum(map(memo.__getitem__, found))
        except KeyError:
            pass
        for chunk in found:
            n = memo.get(chunk)
            if n is None:
                n = self.older.get(chunk)
                if n is None:
                    n = self.merge(chunk)
                if len(chunk) <= MEMO_CHARS:
                    if len(memo) >= MEMO_CHUNKS:
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[chunk] = n
            total += n
        return total


@cache
def merger(model_file: str) -> Merger:
    """One for each worker process."""
    return Merger(model_file)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text)."""

    def make():
        count = merger(model_file).count

        def work(cols):
            return [(i, len((t or "").encode()), n := count(t), n > limit) for i, t in zip(cols["doc_id"], cols["text"], strict=True)]

        return work

    return map_batches(docs.select("doc_id", "text"), SCHEMA, make)
