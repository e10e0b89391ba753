"""Label splits and bounded training samples for the classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trimmed


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """A null id is in no fold, and so not held out."""
    return F.coalesce(remainder(doc_id, folds) == fold, F.lit(False))


#: Bytes of encoded training documents, beside the bound on rows that each classifier names.
TRAIN_BYTES = 128 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """doc_id, text, label of the documents of at most ``rows`` labels outside the held-out fold.

    The bound applies to the labels, by a hash of doc_id, and so the sample is
    the same in every run; it also bounds what is broadcast. Documents that repeat an
    id, and long ones, are bounded by ``fitted``. Labels that are
    null, or of null ids, are not used; an id labelled twice takes the larger.
    """
    some = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def fitted(encoded: DataFrame, fit: Callable[[list[tuple[int, bytes, int]]], object], rows: int):
    """What ``fit`` makes of (doc_id, data, label) in ascending order, in one task of an executor.

    ``encoded`` has these columns. Its rows are taken by a hash of doc_id until ``rows`` of them or
    ``TRAIN_BYTES`` of data are reached, so the task's memory is bounded, and the driver sees the model alone.
    """
    most = TRAIN_BYTES

    def run(batches):
        own, held = [], 0
        for batch in batches:
            for i, data, label in zip(*(batch.column(k) for k in range(3)), strict=True):
                if len(own) < rows and held < most:
                    own.append((i.as_py(), data.as_py(), label.as_py()))
                    held += len(own[-1][1])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(own)))], pa.binary())], names=["model"])

    key = F.xxhash64("doc_id")
    one = encoded.select("doc_id", encoded.columns[1], "label").repartition(1).sortWithinPartitions(key, *encoded.columns)
    with small_batches(encoded.sparkSession):
        found = one.mapInArrow(trimmed(run), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])
