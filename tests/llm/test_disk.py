import random
import time
from pathlib import Path

from sightline.llm import decontam, near_copies
from sightline.llm.common import shared_dir

from .conftest import sentence


def shuffled(spark):
    """Names of the shuffle files that are there."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}


def test_sums_leave_no_shuffle_files_behind(spark, frame, monkeypatch):
    """The files of each sum of the fit go with it: otherwise those of all three stand on disk at once."""
    rng = random.Random(7)
    docs, benchmark = frame([sentence(rng, 60) for _ in range(12)]), frame([sentence(rng, 20) for _ in range(3)]).withColumnRenamed("doc_id", "item_id")
    plain, left = decontam.summed, []

    def watched(parts, dtype):
        before, found, until = shuffled(spark), plain(parts, dtype), time.time() + 5
        while shuffled(spark) - before and time.time() < until:  # Spark deletes them in the background
            time.sleep(0.1)
        left.append(len(shuffled(spark) - before))
        return found

    monkeypatch.setattr(decontam, "summed", watched)
    decontam.contaminated(docs, benchmark).collect()
    assert left == [0, 0, 0]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_linking_leaves_no_tables_behind(spark, frame):
    """Once near copies are classed, the tables of their links are gone, and the result doesn't read them."""
    rng = random.Random(8)
    texts = [sentence(rng, 60) for _ in range(6)]
    texts += [" ".join([*t.split()[:-1], "changed"]) for t in texts]
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("near_copies*/*"))
    kept = near_copies.one_of_each(frame(texts))
    assert {r["doc_id"] for r in kept.collect()} == set(range(6))
    assert len(set(shared.glob("near_copies*/*")) - before) <= 7
