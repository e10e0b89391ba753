"""Row numbers and prefix sums over a whole table, in order, without a single task.

Rows go to ranges of the order key, which are written once. Each range is summed, the
driver adds the sums of the ranges before it (a row for each partition), and rows are numbered within
their range on that. Numbers of a whole table need no second sort: they follow the rows' places in sorted ranges. A group (a series) may fill many ranges, or lie with many others in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored

PART = "_range_no"


def running(df: DataFrame, order: list[str], sums: dict[str, Column], by: str | None = None) -> DataFrame:
    """``df`` with the sum of each column of ``sums`` over all rows before a row (of its group ``by``), as long.

    Rows of equal keys are put in the order of a hash of their columns; rows alike in everything stay in one range.
    """
    names, group = list(sums), [by] if by else []
    tie = "_range_tie"
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    rows = df.select("*", *(c.cast("long").alias(f"_add_{k}") for k, c in sums.items()), F.xxhash64(*plain).alias(tie))
    keys = [*group, *order, tie]
    rows = stored(rows.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id()), "ranges")
    totals = rows.groupBy(PART, *group).agg(*(F.sum(f"_add_{k}").alias(k) for k in names))
    ends = totals.groupBy(PART).agg(F.min(F.struct(*group, *names)).alias("first"), F.max(F.struct(*group, *names)).alias("last"))
    starts, before, key = [], [0] * len(names), None
    for r in sorted(ends.collect(), key=lambda r: r[PART]):
        first, last = r["first"], r["last"]
        if by and key != (first[by],):
            before = [0] * len(names)
        starts.append((r[PART], *([first[by]] if by else []), *before))
        same = not by or first[by] == last[by]
        before = [(b if same else 0) + last[k] for b, k in zip(before, names, strict=True)]
        key = (last[by],) if by else None
    fields = [T.StructField(PART, T.IntegerType()), *([T.StructField("_first_group", df.schema[by].dataType)] if by else []), *(T.StructField(f"_before_{k}", T.LongType()) for k in names)]
    known = df.sparkSession.createDataFrame(starts, T.StructType(fields))
    w = Window.partitionBy(PART, *group).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.col(by).eqNullSafe(F.col("_first_group")) if by else F.lit(True)
    local = rows.select("*", *(F.coalesce(F.sum(f"_add_{k}").over(w), F.lit(0)).alias(f"_local_{k}") for k in names))
    both = local.join(F.broadcast(known), PART)  # one row for each partition
    return both.select(*df.columns, *((F.col(f"_local_{k}") + F.when(carried, F.col(f"_before_{k}")).otherwise(0)).cast("long").alias(k) for k in names))


def numbered(df: DataFrame, order: list[str], into: str, by: str | None = None) -> DataFrame:
    """``df`` with the number of each row, from 0, in all of it or in its group."""
    if by:
        return running(df, order, {into: F.lit(1)}, by)
    # Ranges are sorted as they are written: a row's place in its range needs no window over it.
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    keys = [*order, "_range_tie"]
    rows = df.select("*", F.xxhash64(*plain).alias("_range_tie")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(rows.select(*df.columns, F.monotonically_increasing_id().alias("_place")), "ranges")
    place, part = F.col("_place"), F.shiftright("_place", 33)
    starts, before = [], 0
    for part_no, n in sorted(map(tuple, rows.groupBy(part.alias(PART)).count().collect())):
        starts.append((part_no, before - (part_no << 33)))
        before += n
    known = df.sparkSession.createDataFrame(starts, f"{PART} long, _shift long")
    both = rows.withColumn(PART, part).join(F.broadcast(known), PART)  # one row for each partition
    return both.select(*df.columns, (place + F.col("_shift")).alias(into))
