"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of output, and bytes of input behind them, after which an Arrow batch is handed back to the JVM.
OUT_ROWS, OUT_BYTES = 4096, 4 << 20
#: Bytes of an Arrow batch on the way to Python.
BATCH_BYTES = 8 << 20


def fresh(df: DataFrame, n: int = 0) -> str:
    """A column name that ``df`` doesn't have (another for each ``n``)."""
    have, k = {c.lower() for c in df.columns}, n
    while f"_sightline_{k}" in have:
        k += 1000
    return f"_sightline_{k}"


#: Characters of text that are worked on together.
CHARS = 1 << 18
#: By byte: lower case, and whether it is of a word; and multipliers for the places in a word.
LOW = np.arange(256, dtype=np.uint8) + 32 * np.isin(np.arange(256), np.arange(65, 91)).astype(np.uint8)
WORD = ~np.isin(np.arange(256), [32, *range(9, 14)])
_TERMS = LOW.astype(np.uint64) + np.uint64(1)
_PLACES = np.random.default_rng(31).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (of what is not ASCII white space), A-Z lowered, and where each begins."""
    codes = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(WORD[codes])
    if not len(at):
        return np.zeros(0, np.uint64), at
    start = np.flatnonzero(np.append(True, at[1:] - at[:-1] > 1))
    lengths = np.diff(np.append(start, len(at)))
    place = np.arange(len(at), dtype=np.int32)
    place -= np.repeat(start.astype(np.int32), lengths)
    term = _TERMS[codes[at]]
    if lengths.max() > 256:
        term *= _PLACES[place & 255]
        term += (place >> 8).astype(np.uint64)
    else:
        term *= _PLACES[place]
    h = np.add.reduceat(term, start)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32)), at[start]


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` names it. Where the setting is absent a temporary folder
    stands in for it on one machine (tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="sightline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def _with(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries that run inside hand ``BATCH_BYTES`` at once to Python, since executors and workers hold several batches each."""
    return _with(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffled_once(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries that are made and run inside delete their shuffle files when they end. Else those stay until the driver happens
    to collect its garbage. Each must be run only once."""
    return _with(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Scratch:
    """Tables of one job in the shared folder: they cut lineage and survive lost executors.

    What a job returns may still read some of them, so they stay until
    ``clean_up`` or until the folder is emptied; what nothing reads any more is dropped at once.
    """

    def __init__(self, spark: SparkSession, name: str, row_group: int | None = None):
        """``row_group`` bounds what a writing task holds of a table in memory (bytes)."""
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.options = {"parquet.block.size": str(row_group)} if row_group else {}
        _roots.append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with small_batches(self.spark):
            df.write.options(**self.options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in dfs:
            _delete(self.spark, df._scratch_path)

    def drop_all(self) -> None:
        """Delete all tables, once nothing reads any of them."""
        _delete(self.spark, self.root)
        if self.root in _roots:
            _roots.remove(self.root)


#: Rows of a table, and bytes of their text, that are broadcast as a whole; a key with more than one in HOT_SHARE rows is hot.
BROADCAST_ROWS, BROADCAST_BYTES, HOT_SHARE = 100_000, 8 << 20, 1000


def joined(rows: DataFrame, table: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each key once, where some keys may hold a large part of the rows.

    A small table is broadcast. Of a larger one only the keys with over one in ``HOT_SHARE`` of the
    rows are, less than ``HOT_SHARE`` by their definition; the other keys meet by a shuffle, none with more than that share.
    """
    length = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in table.columns), F.lit(0))
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
    if size["n"] <= BROADCAST_ROWS and 4 * size["bytes"] <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key)
    rows = scratch.keep(rows)
    counts = rows.groupBy(*key).agg(F.count("*").alias("_of_key"))
    hot = scratch.keep(counts.filter(F.col("_of_key") > F.lit(rows.count() / HOT_SHARE)).select(*key))
    some = table.join(F.broadcast(hot), key)
    return rows.join(F.broadcast(some), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


#: Folders of all jobs of this process.
_roots: list[str] = []


def clean_up(spark: SparkSession) -> None:
    """Delete the tables of all jobs so far; their results must have been written or read by then."""
    while _roots:
        _delete(spark, _roots.pop())


def trim() -> None:
    """Give memory that is free in this process back to the system: Arrow's pool, and the C library's where it can (glibc)."""
    pa.default_memory_pool().release_unused()
    if found := getattr(ctypes.CDLL(None), "malloc_trim", None):
        found(0)


def rested(spark: SparkSession) -> None:
    """Have the driver and the executors collect garbage, between stages of a long job.

    A Java heap grows to its limit with the garbage of large shuffles, and stays there beside the Python workers of the
    stages that follow; a full collection gives back what it frees, of classes and buffers outside the heap as well.
    There are as many tasks as cores, so idle executors all have some.
    """
    spark.sparkContext._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches; at the end of the task its memory goes back to the system.

    Spark keeps workers for later tasks, and several of them to an executor. A worker holds on to what
    the buffers of its largest batches took, 40 to 110 MB each, unless it is told to give that up.
    """

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def map_batches(df: DataFrame, schema: T.StructType, make: Callable[[], Callable[[dict[str, list]], list[tuple]]], slice_rows: int = 256) -> DataFrame:
    """Run Python over ``df`` in Arrow batches, whole rows at a time.

    ``make()`` is called once in each task and returns a function from columns
    (name to list) to output rows. Slices are small in rows and bytes, and so is what is
    gathered before it is handed back: memory follows the longest texts and not
    the batch size of the session.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, rows, held = make(), [], 0
        for batch in batches:
            step = max(1, min(slice_rows, OUT_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows += work(part.to_pydict())
                held += part.nbytes
                if len(rows) >= OUT_ROWS or held >= OUT_BYTES:
                    yield to_batch(rows, arrow)
                    rows, held = [], 0
        if rows:
            yield to_batch(rows, arrow)

    return df.mapInArrow(trimmed(run), schema)


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)


#: Tasks whose sums meet in one task, before all do.
LEVEL = 256
SUMS = T.StructType([T.StructField("block", T.LongType()), T.StructField("sums", T.BinaryType())])
_LEVELS = T.StructType([T.StructField("group", T.LongType()), *SUMS.fields])


def summed(parts: DataFrame, dtype: np.dtype) -> list[tuple[int, np.ndarray]]:
    """(block, sum) over the arrays of ``dtype`` that tasks hand over as rows of ``SUMS``, the sums in the order of blocks.

    Sums are added in two levels, ``LEVEL`` tasks together first, by tasks that read the rows of a
    block one after the other: they hold one sum, and batches of ``BATCH_BYTES``. Rows come in the order
    of the tasks that made them, and so the sums are the same in every run over the same partitions.
    Shuffle files go with the query: they are as large for a small table as for a large one, and jobs make several sums.
    """
    wide = np.int64 if np.issubdtype(dtype, np.integer) else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return to_batch([(*at, total.astype(dtype).tobytes())], arrow)

        arrow, at, total = to_arrow_schema(_LEVELS), None, None
        for batch in batches:
            for group, block, sums in zip(*(batch.column(k) for k in range(3)), strict=True):
                own = np.frombuffer(sums.as_buffer(), dtype)
                if at != (key := (group.as_py(), block.as_py())):
                    if at is not None:
                        yield out()
                    at, total = key, np.zeros(len(own), wide)
                total += own
        if at is not None:
            yield out()

    def level(rows: DataFrame, group: Column) -> DataFrame:
        some = rows.select(group.cast("long").alias("group"), "block", "sums", F.col("task"))
        return some.repartition("group", "block").sortWithinPartitions("group", "block", "task").select("group", "block", "sums").mapInArrow(trimmed(run), _LEVELS)

    first = level(parts.select("block", "sums", F.spark_partition_id().alias("task")), F.floor(F.col("task") / LEVEL))
    with small_batches(parts.sparkSession), shuffled_once(parts.sparkSession):
        found = level(first.withColumnRenamed("group", "task"), F.lit(0)).select("block", "sums").collect()
    return [(r["block"], np.frombuffer(r["sums"], dtype)) for r in sorted(found, key=lambda r: r["block"])]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
