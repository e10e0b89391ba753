"""Session defaults for scripts, tests and benchmarks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; clusters bring their own.

    Joins whose partitions all turn out to be small are hashed instead of sorted.
    """
    builder = SparkSession.builder.master(master).appName("sightline").config("spark.sql.shuffle.partitions", shuffle_partitions)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m", "spark.ui.enabled": "false", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for Python functions that run there."""
    here = Path(__file__).parent
    file = Path(tempfile.mkdtemp()) / f"{here.name}-{os.getpid()}.zip"
    with zipfile.ZipFile(file, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(file))
