"""Numbers and prefix sums over ranges against plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import windows
from sightline.operators.running import numbered, running
from sightline.sources.series import CsvOptions, from_csv, points


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None, f"s{k % 40}"]), k if k % 9 else None, rng.randint(0, 5)) for k in range(600)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, k long, x long").repartition(5)


def key(k):
    return k is not None, k or 0


def test_groups_over_many_ranges(spark, table):
    rows, df = table
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(df, ["k"], "n", "g").collect()
        sums = running(df, ["k", "g"], {"n": F.lit(1), "s": F.col("x")}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r.g == g), key=lambda r: r.n)
        assert [r.n for r in own] == list(range(sum(r[0] == g for r in rows)))
        assert [key(r.k) for r in own] == sorted(key(r.k) for r in own)
    assert sorted(r.n for r in sums) == list(range(600))
    total = 0
    for r in sorted(sums, key=lambda r: r.n):
        assert r.s == total
        total += r.x


def test_empty_and_repeated_rows(spark, table):
    _, df = table
    assert numbered(df.limit(0), ["k"], "n").collect() == []
    same = spark.createDataFrame([("a", 1, 1)] * 50, "g string, k long, x long")
    assert sorted(r.n for r in numbered(same, ["k"], "n", "g").collect()) == list(range(50))


def test_long_points(table):
    _, df = table
    short, long = (points(df.filter("k is not null"), "g", "k", "x", long=k).orderBy("series_id", "idx").collect() for k in (False, True))
    assert short == long
    one = points(df.filter("k is not null"), None, "k", "x").orderBy("idx").collect()
    assert [r.idx for r in one] == list(range(len(one))) and {r.series_id for r in one} == {"0"}


def test_no_single_task(spark, table):
    _, df = table
    series = points(df.filter("k is not null"), "g", "k", "x")
    for made in (windows.sliding(series, 4, 2), windows.split(windows.sliding(series, 4, 2), "series", 0.5, 0.25), points(df, None, "k", "x")):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        # Scalar subqueries and sums may meet in one task, rows may not.
        assert "Window" not in plan or "hashpartitioning" in plan
        assert not any("Window" in line and "SinglePartition" in nxt for line, nxt in zip(plan.splitlines(), plan.splitlines()[1:], strict=False))


def test_csv_of_many_files_and_blocks(spark, tmp_path):
    """Lines keep the order of files and of their places, over several tasks."""
    n = 0
    for name in ("b.csv", "a.csv", "c.csv"):
        (tmp_path / name).write_text("".join(f"{k},{k if k % 5 else ''}\n" for k in range(n, n + 300)) + "\n")
        n += 300
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = from_csv(spark, str(tmp_path), CsvOptions(has_header=False)).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [*range(300, 600), *range(300), *range(600, 900)]
    assert [r.t for r in got] == want and [r.idx for r in got] == list(range(900))
    assert [r.value for r in got] == [k if k % 5 else None for k in want]


def test_numbers_of_a_table_need_no_window(spark):
    """Ranges are sorted once, as they are written."""
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("v")).repartition(5)
    found = numbered(df, ["k"], "n")
    assert "Window" not in found._jdf.queryExecution().analyzed().toString()
    assert all(r.n == r.k for r in found.collect()) and found.count() == 1000
    assert found.schema["n"].dataType.simpleString() == "bigint"
    assert numbered(df.filter("k < 0"), ["k"], "n").count() == 0
