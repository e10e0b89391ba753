import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sightline.llm import bwt_dedup, common, decontam, near_copies
from sightline.llm.common import BATCH_BYTES, LEVEL, SUMS, Scratch, rested, summed, trimmed

ROOT = Path(__file__).resolve().parents[2]

#: In a process of its own: MB that it holds before, after a task, and after a trimmed task.
ALONE = """
import os
from pathlib import Path
from sightline.llm.common import trimmed

def held():
    return int(Path("/proc/self/smaps_rollup").read_text().split("Pss_Anon:")[1].split()[0]) / 1024

kept = []

def run(batches):
    for batch in batches:
        parts = [os.urandom(100_000) for _ in range(1200)]  # below the size from which the C library maps memory
        kept.append(os.urandom(100_000))  # stands behind them, so that the heap's end can't just be cut off
        yield len(parts)

found = [held()]
for f in (run, trimmed(run)):
    assert list(f(iter([1]))) == [1200]
    found.append(held())
print(*found)
"""


def test_tasks_give_memory_back():
    """What many buffers of middle size took goes back to the system when a task has ended, though some others stay."""
    said = subprocess.run([sys.executable, "-c", ALONE], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    before, plain, after = map(float, said.split())
    assert plain - before > 80 and after - before < 40


def test_stages_give_memory_back(spark, monkeypatch):
    """The Python steps of the pipeline's large stages end so."""
    wrapped = []
    for module in (bwt_dedup, decontam, near_copies):
        monkeypatch.setattr(module, "trimmed", lambda run, own=module: wrapped.append(own) or trimmed(run))
    docs = spark.createDataFrame([(i, "w" * 300 + f" some text {i % 2} " * 30) for i in range(6)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "some words that are in no text at all")], "item_id long, text string")
    bwt_dedup.without_repeats(docs).collect()
    near_copies.one_of_each(docs).collect()
    decontam.without_contaminated(docs, benchmark).collect()
    assert {bwt_dedup, decontam, near_copies} == set(wrapped)


def test_batches_are_small_inside_kept_queries(spark):
    """Tables are written from batches of few bytes, and the session is left as it was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = spark.range(0, 4000, 1, 1).select(F.expr("repeat('w', 10000)").alias("text"))
    found = [r.n for r in Scratch(spark, "memory").keep(docs.mapInArrow(sizes, "n long")).collect()]
    assert sum(found) > 4000 * 10_000 and max(found) < 2 * BATCH_BYTES
    assert spark.conf.get(key) == before


def test_sums_are_streamed(spark):
    """Sums of 600 tasks, in both levels, equal those of one pass; a task of the sum never holds the rows of a block together."""
    n = 600
    assert n > 2 * LEVEL

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for block in range(3):
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([(np.arange(5) * (i + block)).tobytes()], pa.binary())], names=SUMS.names)

    found = summed(spark.range(0, n, 1, n).mapInArrow(run, SUMS), np.dtype(np.int64))
    assert [b for b, _ in found] == [0, 1, 2]
    for block, own in found:
        assert own.tolist() == [k * sum(i + block for i in range(n)) for k in range(5)]
    assert summed(spark.range(0).mapInArrow(run, SUMS), np.dtype(np.int64)) == []


def _collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_executors_rest(spark):
    """A full collection by the driver, and one by tasks, which share its process here."""
    before = _collections(spark)
    rested(spark)
    assert _collections(spark) >= before + 2


def test_stages_start_from_rest(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "rested", lambda s: calls.append(s))
    docs = spark.createDataFrame([(i, f"some text {i} " * 30, "s", 0) for i in range(3)], "doc_id long, text string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001")
        assert len(calls) == k + 1


def test_arrow_memory_goes_back(monkeypatch):
    """At a task's end, also what Arrow's pool keeps for later buffers."""
    asked = []

    class Pool:
        def release_unused(self):
            asked.append(1)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert list(trimmed(lambda batches: iter([1]))(iter([]))) == [1] and asked == [1]
