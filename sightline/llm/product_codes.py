"""Vector code compression: product codes, with entries found by annular norm pruning.

Components become whole numbers, floor(4096 x); a vector is cut into ``PARTS`` equal consecutive parts, and
each part is replaced by the number of the nearest entry of its codebook. Codebooks begin with the parts
of the vectors of the smallest ids and are moved to the means of what they stand for, a few rounds long.

An entry is sought by its norm. By the triangle inequality an entry at distance r or less from a part lies
in the annulus of norms within r of the part's own. Entries are sorted by norm; the one of the nearest norm gives the
first distance, binary search finds the interval of norms that it allows (ends included), and only the
entries in it are compared, exactly, from the inside out, while the annulus shrinks with the best distance so far. Ties go to the entry
of the lowest number.

Vectors stay where they are in all rounds: each task hands on its sums for each entry (no more numbers than the codebooks have), and
the driver holds the codebooks alone, ``ENTRIES`` vectors. All arithmetic is on whole numbers.

Defined results: rows whose vector is null, or has null or non-finite components, are left out. The length of vectors
is that of the kept row with the smallest id (nulls last); rows of another length stay with a null code and error and move no entry.
A length that is no multiple of ``PARTS`` is filled up by zeros at the end. Components beyond +-8192 count as
+-8192, so sums stay below 2^63 up to 1,024 components. Fewer rows than entries make smaller codebooks; of rows with the same id the
lower vector comes first. Repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, joined, small_batches, trimmed

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE, MOST = 4096, 8192.0
#: Components that are worked on together.
CELLS = 1 << 18


class Codebook:
    """The entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.number = np.argsort(squares, kind="stable")
        self.entries, self.norms = entries[self.number], np.sqrt(squares[self.number].astype(float))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry to each row, and its squared distance."""
        norm, k = np.sqrt((x * x).sum(axis=1).astype(float)), len(self.norms)
        after = np.searchsorted(self.norms, norm).clip(0, k - 1)
        before = np.maximum(after - 1, 0)
        start = np.where(norm - self.norms[before] <= np.abs(self.norms[after] - norm), before, after)
        best = ((x - self.entries[start]) ** 2).sum(axis=1)
        number = self.number[start]
        # Rounding must not cut the annulus short.
        slack = 1e-9 * (norm + 1)
        reach = np.sqrt(best.astype(float)) + slack
        low, high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        for step in [s * side for s in range(1, k) for side in (1, -1)]:
            at = start + step
            rows = np.flatnonzero((at >= low) & (at < high))
            rows = rows[np.abs(self.norms[at[rows]] - norm[rows]) <= reach[rows]]
            if not len(rows):
                continue
            at = at[rows]
            d, new = ((x[rows] - self.entries[at]) ** 2).sum(axis=1), self.number[at]
            better = (d < best[rows]) | ((d == best[rows]) & (new < number[rows]))
            rows = rows[better]
            best[rows], number[rows] = d[better], new[better]
            reach[rows] = np.sqrt(best[rows].astype(float)) + slack[rows]
        return number, best


def padded(vectors: list | np.ndarray, length: int) -> np.ndarray:
    """Rows of whole numbers, cut into parts: (rows, PARTS, width)."""
    width = -(-length // PARTS)
    out = np.zeros((len(vectors), PARTS * width), np.int64)
    if length:
        out[:, :length] = vectors
    return out.reshape(len(vectors), PARTS, width)


def _slices(batch: pa.RecordBatch, column: int, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time: the rows, which have the right length, and these as parts."""
    step = max(1, CELLS // max(1, length))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        v = part.column(column)
        fits = v.value_lengths().to_numpy(zero_copy_only=False) == length
        yield part, fits, padded(v.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(int(fits.sum()), length), length)


def _sums(vectors: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """part, entry, place, n, total: of the parts that go to each entry, from each task."""

    def run(batches):
        own = [Codebook(b) for b in books]
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, _, x in _slices(batch, 0, length):
                for p, book in enumerate(own):
                    number, _ = book.nearest(x[:, p])
                    # Whole numbers below 2^53: exact.
                    total[p] += ((number == np.arange(books.shape[1])[:, None]).astype(float) @ x[:, p].astype(float)).astype(np.int64)
                    n[p] += np.bincount(number, minlength=books.shape[1])
        part, entry, place = (a.ravel() for a in np.indices(books.shape))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (part, entry, place, np.repeat(n.ravel(), books.shape[2]), total.ravel())], names=["part", "entry", "place", "n", "total"])

    return vectors.select("v").mapInArrow(trimmed(run), "part long, entry long, place long, n long, total long")


def moved(vectors: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    """Codebooks with each entry at the mean, rounded down, of the parts that are nearest to it."""
    sums = _sums(vectors, books, length).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    out = books.copy()
    with small_batches(vectors.sparkSession):
        for r in sums.filter("n > 0").collect():
            out[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fitted(vectors: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, int]:
    """Kept rows of ``vectors`` as whole numbers (vec_id, v, label), the codebooks (part, entry, component), and the vectors' length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(-MOST)), F.lit(MOST)) * SCALE).cast("int"))
    kept = scratch.keep(vectors.filter(F.col("embedding").isNotNull() & finite).select("vec_id", whole.alias("v"), "label"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*order).limit(1).collect()
    length = len(first[0]["v"]) if first else 0
    start = [r["v"] for r in kept.filter(F.size("v") == length).orderBy(*order).limit(ENTRIES).collect()]
    books = padded(start, length).transpose(1, 0, 2)
    for _ in range(rounds if start else 0):
        books = moved(kept, books, length)
    return kept, books, length


def encoded(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code (numbers of entries in the order of parts, two hexadecimal digits each), error
    (squared distances, summed), codebooks_sha256 of each kept row of ``vectors`` (vec_id, embedding, label)."""
    scratch = Scratch(vectors.sparkSession, "codes")
    kept, books, length = fitted(vectors, scratch, rounds)
    schema = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        own = [Codebook(b) for b in books]
        for batch in batches:
            for part, fits, x in _slices(batch, 2, length):
                code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(fits), np.int64)
                for p, book in enumerate(own):
                    number, d = book.nearest(x[:, p])
                    code[:, p], error[fits] = number, error[fits] + d
                text, codes = code.tobytes().hex(), np.full(len(fits), None, object)
                codes[fits] = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(error, pa.int64(), mask=~fits)], names=schema.names)

    found = scratch.keep(kept.select("vec_id", "label", "v").mapInArrow(trimmed(run), schema))
    return found.withColumn("codebooks_sha256", F.lit(digest(books)))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error: errors summed over equal labels, nulls together (at 2^63 - 1 it stops)."""
    key = [F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label_text")]
    total = F.coalesce(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    sums = codes.groupBy(*key).agg(F.least(total, F.lit((1 << 63) - 1).cast("decimal(30,0)")).cast("long").alias("label_error"))
    return joined(codes.select("*", *key), sums, ["no_label", "label_text"], Scratch(codes.sparkSession, "labels")).drop("no_label", "label_text")
