"""Registered queries and their SQL oracles.

A query takes (spark, sf_dir) and covers the whole table; its oracle is DuckDB
SQL over the same tables. Derived doubles are rounded to six places on both
sides, since sums are taken in another order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, impute, signal, vector
from ..functions import sql as sqlfns
from ..operators import clustering, community, compare, degree, matrix, motifs, paths, trees, visibility, windows
from ..operators.graph import VisibilityGraph, of_edges
from ..operators.statistics import graph_statistics
from ..sources import generators, sinks
from ..scratch import shared_dir
from ..sources.series import CsvOptions, _lines_to_points, from_csv, points, to_arrays
from . import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# SQL that several oracles start with.
S = "s as (select user_id as series_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, value as v from events)"
GAP = "s as (select user_id as series_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, case when event_id % 7 = 0 then null else value end as v from events)"
_BETWEEN = "over (partition by series_id, src order by dst rows between unbounded preceding and 1 preceding)"
PAIRS = "p as (select a.series_id, a.idx as src, b.idx as dst, a.v as va, b.v as vb, (b.v - a.v) / (b.idx - a.idx) as slope from s a join s b on a.series_id = b.series_id and a.idx < b.idx)"
NVG = f"{S}, {PAIRS}, q as (select *, max(slope) {_BETWEEN} as most from p), e as (select series_id, src, dst, va, vb, 1.0::double as weight from q where most is null or slope > most)"
HVG = f"{S}, {PAIRS}, q as (select *, max(vb) {_BETWEEN} as most from p), e as (select series_id, src, dst, va, vb, 1.0::double as weight from q where most is null or most < least(va, vb))"
LINKS = "l as (select series_id, src as node, dst as nb from e union all select series_id, dst, src from e)"
DEG = f"{LINKS}, d as (select s.series_id, s.idx as node, count(l.nb) as degree from s left join l on s.series_id = l.series_id and s.idx = l.node group by all)"
TRI = "t as (select x.series_id, x.src as a, x.dst as b, y.dst as c from e x join e y on x.series_id = y.series_id and x.dst = y.src join e z on x.series_id = z.series_id and x.src = z.src and y.dst = z.dst)"
CC = f"{NVG}, {DEG}, {TRI}, k as (select series_id, node, count(*) as links from (select series_id, unnest([a, b, c]) as node from t) group by all), n as (select d.series_id, d.node, coalesce(links, 0) as links, degree * (degree - 1) / 2.0 as triples, case when degree < 2 then 0.0 else coalesce(links, 0) / (degree * (degree - 1) / 2.0) end as cc from d left join k on d.series_id = k.series_id and d.node = k.node)"
DIST = (
    f"recursive {NVG}, {LINKS}, h(series_id, s, t, hops) using key (series_id, s, t) as (select series_id, idx, idx, 0 from s union "
    "select h.series_id, h.s, l.nb, min(h.hops + 1) from h join l on h.series_id = l.series_id and h.t = l.node left join recurring.h r on r.series_id = h.series_id and r.s = h.s and r.t = l.nb where r.hops is null group by all)"
)

SIGMA = (
    f"recursive {NVG}, {LINKS}, h(series_id, s, t, hops, sig) using key (series_id, s, t) as (select series_id, idx, idx, 0, 1.0::double from s union "
    "select h.series_id, h.s, l.nb, min(h.hops + 1), sum(h.sig) from h join l on h.series_id = l.series_id and h.t = l.node left join recurring.h r on r.series_id = h.series_id and r.s = h.s and r.t = l.nb where r.hops is null group by all), "
    "n as (select series_id, count(*) as n from s group by 1)"
)
_THROUGH = "from h a join h b on a.series_id = b.series_id and a.t = b.s join h c on a.series_id = c.series_id and a.s = c.s and b.t = c.t where a.hops > 0 and b.hops > 0 and a.hops + b.hops = c.hops group by all"


def _between(part: str) -> str:
    return f"with {SIGMA}, x as (select a.series_id, a.t as node, sum({part}) as x {_THROUGH}) select s.series_id, s.idx as node, round(coalesce(x, 0) / ((n - 1) * (n - 2)), 6) as betweenness from s join n on s.series_id = n.series_id left join x on s.series_id = x.series_id and s.idx = x.node"


# A. Sources and generators.
@query("series_index", f"with {S} select series_id, idx, v as value from s")
def _(spark, sf):
    return tables.events(spark, sf).select("series_id", "idx", "value")


@query("series_lengths", f"with {GAP} select series_id, count(*) as n, count(v) as n_valid from s group by 1")
def _(spark, sf):
    return tables.gapped(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"))


@query("series_arrays", f"with {GAP} select series_id, array_to_string(list(round(v, 2)::decimal(18,2)::varchar order by idx) filter (v is not null), ',') as line from s group by 1")
def _(spark, sf):
    a = to_arrays(tables.gapped(spark, sf), keep_missing=False)
    return a.select("series_id", F.array_join(F.transform("values", lambda x: F.round(x, 2).cast("decimal(18,2)").cast("string")), ",").alias("line"))


@query("csv_series", "select row_number() over (order by event_id) - 1 as idx, event_id::double as t, case when event_id % 7 = 0 then null else value end as value from events")
def _(spark, sf):
    """Lines of a CSV file, made of ``events``, read as one series."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    value = F.when(F.col("event_id") % 7 == 0, "NA").otherwise(F.col("value").cast("string"))
    lines = df.select(F.col("event_id").alias("n"), F.concat_ws(";", F.lit("x"), F.col("event_id").cast("string"), value).alias("line"))
    return _lines_to_points(lines, CsvOptions(False, 1, 2, ";", "NA"), "0").select("idx", "t", "value")


@query("csv_file", "select row_number() over (order by event_id) - 1 as idx, event_id::double as t, case when event_id % 7 = 0 then null else value end as value from events")
def _(spark, sf):
    """The same from files: written in ranges of event_id, read in the order of their names and places."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    line = F.concat_ws(";", F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("value").cast("string")))
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    df.repartitionByRange("event_id").sortWithinPartitions("event_id").select(line.alias("line")).write.text(folder)
    return from_csv(spark, folder, CsvOptions(False, 0, 1, ";", "")).select("idx", "t", "value")


def _generated(name: str, value: str, make: Callable[[DataFrame], DataFrame], before: str = "", join: str = "") -> None:
    """A signal made on the samples of each series of ``events``, and what it leaves of them."""
    sql = f"with {before}{S}, n as (select series_id, count(*) as n from s group by 1), g as (select s.series_id, s.idx, s.v, {value} as g from s join n on s.series_id = n.series_id {join}) select series_id, idx, round(g, 6) as value, round(v - g, 6) as rest from g"

    def run(spark, sf):
        series = tables.events(spark, sf)
        both = make(series).select("series_id", "idx", F.col("value").alias("g")).join(series.select("series_id", "idx", "value"), ["series_id", "idx"])
        return both.select("series_id", "idx", r6("g").alias("value"), r6(F.col("value") - F.col("g")).alias("rest"))

    query(f"gen_{name}", sql)(run)


_LEVELS = [1.5, -2.0, 4.25]
_generated("sine_wave", "2 * sin(2 * pi() * 3 * s.idx / n)", lambda s: generators.on(s, lambda i, n: generators.sine(i, n, 3, 2)))
_generated("multi_frequency", "sin(2 * pi() * s.idx / n) + sin(2 * pi() * 7 * s.idx / n)", lambda s: generators.on(s, lambda i, n: generators.frequencies(i, n, [1, 7])))
_generated("sawtooth", "(s.idx % 7) / 7", lambda s: generators.on(s, lambda i, n: generators.saw(i, 7)))
_generated("square_wave", "case when (s.idx // 5) % 2 = 0 then 1.0::double else -1.0 end", lambda s: generators.on(s, lambda i, n: generators.square(i, 10)))
_generated("step_function", f"({_LEVELS}::double[])[least(s.idx // greatest(n // 3, 1), 2) + 1]", lambda s: generators.on(s, lambda i, n: generators.steps(i, n, _LEVELS)))
_generated("random_walk", "case when s.idx % 2 = 0 then -1.0::double else 0.0 end", lambda s: generators.on(s, lambda i, n: generators.walk(i, 42)))
_generated(
    "logistic_map", "x.v", lambda s: generators.logistic_on(s.groupBy("series_id").agg(F.count("*").alias("n")), 3.2, 0.2),
    "recursive x(idx, v) as (select 0::bigint, 0.2::double union all select idx + 1, 3.2 * v * (1 - v) from x where idx < 999), ", "join x on x.idx = s.idx",
)
_generated(
    "trend_with_noise", "0.1 * s.idx + (st / 18446744073709551616.0 - 0.5) * 2", lambda s: generators.noisy_trend(s, 0.1, 2.0, 42, 1 << 10),
    "recursive x(idx, st) as (select 0::bigint, (42::hugeint * 1664525 + 1013904223) % 18446744073709551616 union all select idx + 1, (((st // 4294967296) * 1664525 % 4294967296) * 4294967296 + (st % 4294967296) * 1664525 + 1013904223) % 18446744073709551616 from x where idx < 999), ",
    "join x on x.idx = s.idx",
)

# C. Imputation.
_W = "over (partition by series_id order by idx {})"
_PREV, _NEXT = _W.format("rows between unbounded preceding and 1 preceding"), _W.format("rows between 1 following and unbounded following")
_LAST, _FIRST = f"last_value(v ignore nulls) {_PREV}", f"first_value(v ignore nulls) {_NEXT}"
_IMPUTED = {
    "linear": f"(({_LAST}) + ({_FIRST})) / 2",
    "ffill": _LAST,
    "bfill": _FIRST,
    "mean3": f"avg(v) {_W.format('rows between 1 preceding and 1 following')}",
    "median5": f"median(v) {_W.format('rows between 2 preceding and 2 following')}",
    "zero": "0.0::double",
}
for _name, _sql in _IMPUTED.items():
    query(f"impute_{_name}", f"with {GAP} select series_id, idx, round(coalesce(v, {_sql}), 6) as value from s")(lambda spark, sf, k=_name: impute.impute(tables.gapped(spark, sf), k, strict=False).select("series_id", "idx", r6("value").alias("value")))


@query("impute_nearest", f"with {GAP}, n as (select *, last_value(case when v is not null then idx end ignore nulls) {_PREV} as a, first_value(case when v is not null then idx end ignore nulls) {_NEXT} as b, {_LAST} as va, {_FIRST} as vb from s) select series_id, idx, round(coalesce(v, case when a is null then vb when b is null or idx - a <= b - idx then va else vb end), 6) as value from n")
def _(spark, sf):
    return impute.impute(tables.gapped(spark, sf), "nearest", strict=False).select("series_id", "idx", r6("value").alias("value"))


@query("impute_chain", f"with {GAP} select series_id, idx, round(coalesce(v, {_IMPUTED['linear']}, {_LAST}, {_FIRST}), 6) as value from s")
def _(spark, sf):
    chain = impute.Missing("linear").with_fallback("ffill").with_fallback("bfill")
    return impute.impute(tables.gapped(spark, sf), chain).select("series_id", "idx", r6("value").alias("value"))


# D. Windows and splits.
_WINDOWS = f"{GAP}, n as (select series_id, count(*) as n from s group by 1), f as (select series_id, row_number() over (order by series_id) - 1 as series_no, coalesce(sum(greatest((n - 8) // 4 + 1, 0)) over (order by series_id rows between unbounded preceding and 1 preceding), 0) as first from n), w as (select (first + a.idx // 4)::bigint as window_no, a.series_id, series_no, a.idx as window_start, count(b.v) as valid, round(coalesce(sum(b.v), 0), 6) as total from s a join n on a.series_id = n.series_id join f on a.series_id = f.series_id join s b on a.series_id = b.series_id and b.idx between a.idx and a.idx + 7 where a.idx % 4 = 0 and a.idx + 8 <= n.n group by all)"


def _windows(spark, sf):
    return windows.sliding(tables.gapped(spark, sf), 8, 4)


@query("sliding_windows", f"with {_WINDOWS}, x as (select series_id, idx, list(v) filter (v is not null) {_W.format('rows between current row and 7 following')} as l from s) select w.window_no, w.series_id, w.series_no, w.window_start, w.total, 8::bigint as steps, coalesce(round(l[1], 6), 0) as first_value from w join x on w.series_id = x.series_id and w.window_start = x.idx")
def _(spark, sf):
    w = F.get("window", F.lit(0))
    return _windows(spark, sf).select("window_no", "series_id", "series_no", "window_start", r6(vector.total(w)).alias("total"), F.size(w).cast("long").alias("steps"), r6(F.get(w, F.lit(0))).alias("first_value"))


_SPLIT = "case when {0} < {1} then 'train' when {0} < {1} + {2} then 'val' else 'test' end as split"
_KEYS = ["window_no", "series_id", "window_start"]


@query("split_time", f"with {_WINDOWS}, c as (select count(*) as c from w) select window_no, series_id, window_start, {_SPLIT.format('window_no', 'floor(c * 0.7)', 'floor(c * 0.15)')} from w, c")
def _(spark, sf):
    return windows.split(_windows(spark, sf), "time", 0.7, 0.15).select(*_KEYS, "split")


@query("split_series", f"with {_WINDOWS}, o as (select series_no, row_number() over (order by (series_no::hugeint * 2654435761) % 4294967296, series_no) - 1 as rank, count(*) over () as c from (select distinct series_no from w)) select window_no, series_id, window_start, {_SPLIT.format('rank', 'floor(c * 0.7)', 'floor(c * 0.15)')} from w join o on w.series_no = o.series_no")
def _(spark, sf):
    return windows.split(_windows(spark, sf), "series", 0.7, 0.15).select(*_KEYS, "split")


@query("split_rolling", f"with {_WINDOWS} select window_no, series_id, window_start, {_SPLIT.format('window_no', '100', '50')} from w")
def _(spark, sf):
    return windows.split(_windows(spark, sf), "rolling", 100, 50).select(*_KEYS, "split")


@query("window_batches", f"with {_WINDOWS} select window_no // 32 as batch, count(*) as windows, round(sum(total), 3) as total from w group by 1")
def _(spark, sf):
    b = windows.batches(_windows(spark, sf), 32).withColumn("total", vector.total(F.transform("input", lambda x: F.round(x.cast("double"), 2))))
    return b.groupBy("batch").agg(F.count("*").alias("windows"), F.round(F.sum("total"), 3).alias("total"))


# E. Edges.
@query("nvg_edges", f"with {NVG} select series_id, src, dst, weight from e")
def _(spark, sf):
    return visibility.natural(tables.events(spark, sf))


@query("hvg_edges", f"with {HVG} select series_id, src, dst, weight from e")
def _(spark, sf):
    return visibility.horizontal(tables.events(spark, sf))


@query("hvg_edges_reference_mode", f"with {S}, x as (select *, lead(v) over (partition by series_id order by idx) as nx from s), y as (select *, coalesce(sum(case when v > nx then 0 else 1 end) over (partition by series_id order by idx rows between unbounded preceding and 1 preceding), 0) as run from x) select series_id, idx as src, idx + 1 as dst, 1.0::double as weight from y where nx is not null union all select a.series_id, a.idx, b.idx + 1, 1.0 from y a join y b on a.series_id = b.series_id and a.run = b.run and b.idx > a.idx where b.nx is not null and a.nx < b.nx")
def _(spark, sf):
    return visibility.horizontal(tables.events(spark, sf), mode="reference")


for _name, _sql in {"absdiff": "abs(vb - va)", "distance": "(dst - src)::double", "geomean": "sqrt(abs(va * vb))", "normdiff": "abs(vb - va) / (abs(va) + abs(vb) + 1e-10)"}.items():
    query(f"nvg_edges_weighted_{_name}", f"with {NVG} select series_id, src, dst, round({_sql}, 6) as weight from e")(lambda spark, sf, k=_name: visibility.natural(tables.events(spark, sf), k).withColumn("weight", r6("weight")))


@query("nvg_edges_kernel", ORACLES["nvg_edges"])
def _(spark, sf):
    return visibility.natural(tables.events(spark, sf), strategy="kernel")


@query("hvg_edges_kernel", ORACLES["hvg_edges"])
def _(spark, sf):
    return visibility.horizontal(tables.events(spark, sf), strategy="kernel")


for _kind, _build in {"nvg": visibility.natural, "hvg": visibility.horizontal}.items():
    query(f"{_kind}_edges_sql", ORACLES[f"{_kind}_edges"])(lambda spark, sf, build=_build: build(tables.events(spark, sf), strategy="sql"))

# One long series. No sample sees past one of the greatest value, so the oracle's pairs stay between these.
_QUANTITIES = "s as materialized (select row_number() over (order by l_orderkey, l_linenumber, l_quantity, l_partkey) - 1 as idx, l_quantity::double as v from lineitem), m as materialized (select *, sum(case when v = (select max(v) from s) then 1 else 0 end) over (order by idx) as k, v = (select max(v) from s) as top from s)"
_LONG_PAIRS = "p as (select a.idx as src, b.idx as dst, (b.v - a.v) / (b.idx - a.idx) as slope from m a join m b on b.k = a.k and b.idx > a.idx union all select a.idx, b.idx, (b.v - a.v) / (b.idx - a.idx) from m a join m b on b.top and b.k = a.k + 1)"


@query("nvg_edges_long", f"with {_QUANTITIES}, {_LONG_PAIRS}, q as (select *, max(slope) over (partition by src order by dst rows between unbounded preceding and 1 preceding) as most from p) select src, dst, 1.0::double as weight from q where most is null or slope > most")
def _(spark, sf):
    """All quantities of ``lineitem`` as one series, in spans."""
    series = points(spark.read.parquet(f"{sf}/lineitem.parquet"), None, ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey"], "l_quantity")
    return visibility.natural(series, strategy="long").select("src", "dst", "weight")


@query("hvg_edges_long", "with s as materialized (select row_number() over (order by o_orderkey) - 1 as idx, o_totalprice::double as v from orders), r as (select a.idx as src, min(b.idx) as dst from s a join s b on b.idx > a.idx and b.v >= a.v group by 1), l as (select max(a.idx) as src, b.idx as dst from s a join s b on a.idx < b.idx and a.v >= b.v group by 2) select src, dst from r union all select src, dst from l join s a on l.src = a.idx join s b on l.dst = b.idx where a.v > b.v")
def _(spark, sf):
    """All prices of ``orders`` as one series, in spans."""
    series = points(spark.read.parquet(f"{sf}/orders.parquet"), None, "o_orderkey", "o_totalprice")
    return visibility.horizontal(series, strategy="long").select("src", "dst")


_DAILY = "s as (select o_orderpriority as series_id, row_number() over (partition by o_orderpriority order by day) - 1 as idx, revenue as v from (select o_orderpriority, o_orderdate::date as day, round(sum(o_totalprice), 2) as revenue from orders group by all))"


@query("nvg_edges_daily_revenue", f"with {NVG.replace(S, _DAILY)} select series_id, count(*) as edges, sum(src)::bigint as src_sum, sum(dst)::bigint as dst_sum from e group by 1")
def _(spark, sf):
    e = visibility.natural(tables.prices(spark, sf))
    return e.groupBy("series_id").agg(F.count("*").alias("edges"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"))


@query("visibility_edges_udtf", f"with {HVG} select series_id, src, dst from e")
def _(spark, sf):
    """The table function of SQL over one array for each series."""
    sqlfns.register(spark)
    to_arrays(tables.events(spark, sf)).createOrReplaceTempView("series_arrays")
    return spark.sql("select series_id, e.src, e.dst from series_arrays, lateral visibility_edges(values, 'horizontal') e")


@query("visibility_pairs_sql", f"with {NVG} select series_id, src, dst from e")
def _(spark, sf):
    """The same in SQL by batches of series."""
    sqlfns.register(spark)
    to_arrays(tables.events(spark, sf)).createOrReplaceTempView("series_arrays")
    return spark.sql("select series_id, inline(visibility_pairs(values, 'natural')) from series_arrays")


# F. Accessors.
@query("nvg_degree", f"with {NVG}, {DEG} select series_id, node, degree from d")
def _(spark, sf):
    return tables.natural(spark, sf).degrees()


@query("nvg_degree_directed", f"with {NVG} select s.series_id, s.idx as node, count(e.dst) as degree from s left join e on s.series_id = e.series_id and s.idx = e.src group by all")
def _(spark, sf):
    g = tables.natural(spark, sf)
    return VisibilityGraph(g.nodes, g.edges, directed=True).degrees()


@query("nvg_neighbors", f"with {NVG} select series_id, src as node, dst as neighbor, weight from e union all select series_id, dst, src, weight from e")
def _(spark, sf):
    return tables.natural(spark, sf).links()


@query("nvg_neighbors_of_node", f"with {NVG}, {LINKS} select series_id, nb as neighbor from l where node = 10")
def _(spark, sf):
    return tables.natural(spark, sf).neighbors(10).select("series_id", "neighbor")


@query("nvg_has_edge", f"with {NVG} select s.series_id, count(e.src) > 0 as has_edge from (select distinct series_id from s) s left join e on s.series_id = e.series_id and src = 3 and dst = 7 group by 1")
def _(spark, sf):
    return tables.natural(spark, sf).has_edge(7, 3)


@query("nvg_adjacency", f"with {NVG} select series_id, src as row, dst as col, weight from e")
def _(spark, sf):
    return tables.natural(spark, sf).adjacency()


@query("nvg_adjacency_rows", f"with {NVG} select a.series_id, a.idx as row, string_agg(case when e.src is null then '0' else '1' end, '' order by b.idx) as line from s a join s b on a.series_id = b.series_id left join e on e.series_id = a.series_id and ((e.src = a.idx and e.dst = b.idx) or (e.src = b.idx and e.dst = a.idx)) group by 1, 2")
def _(spark, sf):
    rows = tables.natural(spark, sf).adjacency_rows(symmetric=True)
    return rows.select("series_id", "row", F.array_join(F.transform("entries", lambda x: x.cast("int").cast("string")), "").alias("line"))


@query("graph_counts", f"with {NVG}, n as (select series_id, count(*) as node_count from s group by 1), m as (select series_id, count(*) as edge_count from e group by 1) select n.series_id, node_count, coalesce(edge_count, 0) as edge_count from n left join m on n.series_id = m.series_id")
def _(spark, sf):
    return tables.natural(spark, sf).counts()


# G. Features.
_Y = "coalesce(v, 0)"
_O = "(partition by series_id order by idx)"
_LEAD, _LAG = f"lead({_Y}) over {_O}", f"lag({_Y}) over {_O}"
_FEATURES = {
    "delta_forward": f"{_LEAD} - {_Y}",
    "delta_backward": f"{_Y} - {_LAG}",
    "delta_symmetric": f"({_LEAD} - {_LAG}) / 2",
    "local_slope": f"({_LEAD} - {_LAG}) / 2",
    "acceleration": f"{_LEAD} - 2 * {_Y} + {_LAG}",
    "local_mean": f"avg({_Y}) {_W.format('rows between 1 preceding and 1 following')}",
    "local_variance": f"var_pop({_Y}) {_W.format('rows between 1 preceding and 1 following')}",
    "is_local_max": f"case when {_Y} > {_LAG} and {_Y} > {_LEAD} then 1.0::double else 0.0 end",
    "is_local_min": f"case when {_Y} < {_LAG} and {_Y} < {_LEAD} then 1.0::double else 0.0 end",
    "z_score": f"case when count(*) over (partition by series_id) < 2 then null when stddev_pop({_Y}) over (partition by series_id) <= 1e-10 then 0.0 else ({_Y} - avg({_Y}) over (partition by series_id)) / stddev_pop({_Y}) over (partition by series_id) end",
}


def _feature(name: str) -> Query:
    return lambda spark, sf: features.FeatureSet().add_builtin(name).compute(tables.gapped(spark, sf)).withColumn(name, r6(name))


for _name, _sql in _FEATURES.items():
    query(f"feat_{_name}", f"with {GAP} select series_id, idx as node, round({_sql}, 6) as {_name} from s")(_feature(_name))


@query("feat_all_wide", f"with {GAP} select series_id, idx as node, " + ", ".join(f"round({s}, 6) as {k}" for k, s in _FEATURES.items()) + " from s")
def _(spark, sf):
    found = features.all_builtin().compute(tables.gapped(spark, sf))
    return found.select("series_id", "node", *(r6(k).alias(k) for k in features.BUILTIN))


@query("feat_custom", f"with {GAP}, f as (select *, coalesce(v, {_LAST}) as y from s) select series_id, idx as node, round(y - avg(y) over (partition by series_id order by idx rows between 4 preceding and current row), 6) as above_trail from f")
def _(spark, sf):
    own = features.FeatureSet().with_missing_data_strategy("ffill").add_function("above_trail", lambda y, w: y - F.avg(y).over(w.rowsBetween(-4, 0)))
    return own.compute(tables.gapped(spark, sf)).withColumn("above_trail", r6("above_trail"))


@query("feat_counts", f"with {GAP}, f as (select series_id, {_FEATURES['delta_forward']} as a, {_FEATURES['delta_backward']} as b from s) select series_id, count(a) + count(b) as features from f group by 1")
def _(spark, sf):
    found = features.as_map(features.FeatureSet().add_builtin("delta_forward").add_builtin("delta_backward").compute(tables.gapped(spark, sf)))
    return found.groupBy("series_id").agg(F.sum(F.size("features")).alias("features"))


# H. Degrees.
@query("degree_stats", f"with {NVG}, {DEG} select series_id, count(*) as node_count, round(avg(degree), 6) as average_degree, min(degree) as min_degree, max(degree) as max_degree, round(var_pop(degree), 6) as degree_variance, round(stddev_pop(degree), 6) as degree_std_dev from d group by 1")
def _(spark, sf):
    d = degree.degree_stats(tables.natural(spark, sf))
    return d.select("series_id", "node_count", r6("average_degree").alias("average_degree"), "min_degree", "max_degree", r6("degree_variance").alias("degree_variance"), r6("degree_std_dev").alias("degree_std_dev"))


@query("top_nodes_by_degree", f"with {NVG}, {DEG} select series_id, node, degree from d order by degree desc, series_id, node limit 10")
def _(spark, sf):
    return tables.natural(spark, sf).degrees().orderBy(F.desc("degree"), "series_id", "node").limit(10)


@query("degree_distribution", f"with {NVG}, {DEG} select series_id, degree, count(*) as nodes from d group by 1, 2")
def _(spark, sf):
    return degree.degree_distribution(tables.natural(spark, sf))


@query("degree_histogram", f"with {NVG}, {DEG}, m as (select series_id, unnest(range(max(degree) + 1)) as degree from d group by 1) select m.series_id, m.degree, count(d.node) as nodes from m left join d on m.series_id = d.series_id and m.degree = d.degree group by 1, 2")
def _(spark, sf):
    return degree.degree_histogram(tables.natural(spark, sf))


@query("degree_entropy", f"with {NVG}, {DEG}, c as (select series_id, degree, count(*) as c from d group by 1, 2), z as (select series_id, c / sum(c) over (partition by series_id) as z from c) select series_id, round(-sum(z * log2(z)), 6) as degree_entropy from z group by 1")
def _(spark, sf):
    return degree.degree_entropy(tables.natural(spark, sf)).select("series_id", r6("degree_entropy").alias("degree_entropy"))


@query("degree_centrality", f"with {NVG}, {DEG} select series_id, node, round(degree / (count(*) over (partition by series_id) - 1), 6) as degree_centrality from d")
def _(spark, sf):
    return degree.degree_centrality(tables.natural(spark, sf)).withColumn("degree_centrality", r6("degree_centrality"))


@query("density", f"with {NVG}, n as (select series_id, count(*) as n from s group by 1), m as (select series_id, count(*) as m from e group by 1) select n.series_id, round(m / (n * (n - 1) / 2), 6) as density from n join m on n.series_id = m.series_id")
def _(spark, sf):
    return degree.density(tables.natural(spark, sf)).withColumn("density", r6("density"))


_ASSORT = "x as (select e.series_id, a.degree as a, b.degree as b from e join d a on e.series_id = a.series_id and e.src = a.node join d b on e.series_id = b.series_id and e.dst = b.node), y as (select series_id, avg(a * b) - pow(avg((a + b) / 2), 2) as num, avg((a * a + b * b) / 2) - pow(avg((a + b) / 2), 2) as den from x group by 1)"


@query("assortativity", f"with {NVG}, {DEG}, {_ASSORT} select series_id, round(case when abs(den) < 1e-10 then 0 else num / den end, 6) as assortativity from y")
def _(spark, sf):
    return degree.assortativity(tables.natural(spark, sf)).withColumn("assortativity", r6("assortativity"))


# I. Clustering.
@query("triangles", f"with {NVG}, m as materialized (select series_id, src, dst from e), w as materialized (select x.series_id, x.src as a, x.dst as b, y.dst as c from m x join m y on x.series_id = y.series_id and x.dst = y.src) select w.series_id, a, b, c from w join m on w.series_id = m.series_id and w.a = m.src and w.c = m.dst")
def _(spark, sf):
    return clustering.triangles(tables.natural(spark, sf))


@query("clustering_node", f"with {CC} select series_id, node, round(cc, 6) as clustering from n")
def _(spark, sf):
    return clustering.node_clustering(tables.natural(spark, sf)).select("series_id", "node", r6("clustering").alias("clustering"))


@query("clustering_graph", f"with {CC} select series_id, round(avg(cc), 6) as average_clustering, round(sum(links) / sum(triples), 6) as global_clustering from n group by 1")
def _(spark, sf):
    c = clustering.clustering(tables.natural(spark, sf))
    return c.select("series_id", r6("average_clustering").alias("average_clustering"), r6("global_clustering").alias("global_clustering"))


# J. Paths.
@query("apsp", f"with {DIST} select series_id, s as source, t as target, hops from h")
def _(spark, sf):
    return paths.distances(tables.natural(spark, sf))


@query("shortest_path_length", f"with {DIST} select series_id, hops from h where s = 2 and t = 40")
def _(spark, sf):
    return paths.shortest_path_length(tables.natural(spark, sf), 2, 40).filter("hops is not null")


_PATHS = "ec as (select series_id, s, max(hops) as ecc from h group by 1, 2), pt as (select h.series_id, round(avg(hops) filter (s < t), 6) as average_path_length, max(hops)::bigint as diameter from h group by 1), ra as (select series_id, min(ecc)::bigint as radius from ec group by 1)"


@query("path_stats", f"with {DIST}, {_PATHS} select pt.series_id, average_path_length, diameter, radius, true as is_connected from pt join ra on pt.series_id = ra.series_id")
def _(spark, sf):
    p = paths.path_stats(paths.node_paths(tables.natural(spark, sf), betweenness=False))
    return p.withColumn("average_path_length", r6("average_path_length"))


@query("components", f"with {S} select series_id, idx as node, 0::bigint as component from s")
def _(spark, sf):
    return paths.connected_components(tables.natural(spark, sf))


@query("components_of_blocks", f"with {S}, n as (select series_id, count(*) as n from s group by 1) select s.series_id, idx as node, idx // 7 as component from s join n on s.series_id = n.series_id where idx % 7 > 0 or idx + 1 < n")
def _(spark, sf):
    """Of a graph in pieces: edges that stay within seven samples."""
    return paths.connected_components(of_edges(tables.natural(spark, sf).edges.filter("src div 7 = dst div 7")))


@query("component_stats_of_blocks", f"with {S}, n as (select series_id, count(*) as n from s group by 1), c as (select s.series_id, idx // 7 as c, count(*) as k from s join n on s.series_id = n.series_id where idx % 7 > 0 or idx + 1 < n group by 1, 2) select series_id, count(*) as num_components, max(k) as largest_component_size from c group by 1")
def _(spark, sf):
    return paths.component_stats(of_edges(tables.natural(spark, sf).edges.filter("src div 7 = dst div 7")))


@query("component_stats", f"with {S} select series_id, 1::bigint as num_components, count(*) as largest_component_size from s group by 1")
def _(spark, sf):
    return paths.component_stats(tables.natural(spark, sf))


# K. Centrality.
@query("closeness", f"with {DIST} select series_id, s as node, round(case when sum(hops) > 0 then count(*) filter (hops > 0) / sum(hops) else 0 end, 6) as closeness from h group by 1, 2")
def _(spark, sf):
    return paths.closeness(paths.node_paths(tables.natural(spark, sf), betweenness=False)).withColumn("closeness", r6("closeness"))


@query("betweenness", _between("a.sig * b.sig / c.sig"))
def _(spark, sf):
    return paths.betweenness(tables.natural(spark, sf)).withColumn("betweenness", r6("betweenness"))


@query("betweenness_reference_mode", _between("a.sig / c.sig"))
def _(spark, sf):
    return paths.betweenness(tables.natural(spark, sf), "reference").withColumn("betweenness", r6("betweenness"))


# A graph of one long series, searched from every hundredth sample.
_BALANCES = "s as (select '0' as series_id, row_number() over (order by c_custkey) - 1 as idx, c_acctbal::double as v from customer)"
_FROM = DIST.replace(S, _BALANCES).replace("select series_id, idx, idx, 0 from s", "select series_id, idx, idx, 0 from s where idx % 100 = 0")


def _balances(spark: SparkSession, sf: str) -> VisibilityGraph:
    series = points(spark.read.parquet(f"{sf}/customer.parquet"), None, "c_custkey", "c_acctbal")
    return VisibilityGraph.from_series(series).with_strategy("long").natural_visibility()


@query("distances_long", f"with {_FROM} select s as source, t as target, hops from h")
def _(spark, sf):
    g = _balances(spark, sf)
    return paths.distances_from(g, g.nodes.filter("node % 100 = 0").select("series_id", F.col("node").alias("source"))).drop("series_id")


@query("closeness_long", f"with {_FROM} select s as node, max(hops)::bigint as eccentricity, count(*) filter (hops > 0) as reached, round(count(*) filter (hops > 0) / sum(hops), 6) as closeness from h group by 1")
def _(spark, sf):
    g = _balances(spark, sf)
    sums = paths.sums_from(g, g.nodes.filter("node % 100 = 0").select("series_id", F.col("node").alias("source")))
    return sums.join(paths.closeness(sums), ["series_id", "node"]).select("node", "eccentricity", "reached", r6("closeness").alias("closeness"))


# L. Communities.
def _communities(graph: str, nodes: str) -> str:
    """The rounds of local moving, one after the other; ``nodes`` names the table of all (series_id, node)."""
    moves = f"""{graph}, lk as materialized (select series_id, src as node, dst as nb, 1 as w from e union all select series_id, dst, src, 1 from e),
c0_0 as materialized (select series_id, node, node as c, count(*) as d from lk group by all), m2 as materialized (select series_id, count(*) as m2 from lk group by 1)"""
    for level, (links, rounds) in enumerate(zip(("lk", "fl"), community.ROUNDS, strict=True)):
        for k in range(rounds):
            s, turn = f"c{level}_{k}", f"% {community.COLOURS} = {k % community.COLOURS}"
            moves += f""", t{level}_{k} as (select series_id, node, c, sum(w) as t from (select l.series_id, l.node, s.c, l.w from {links} l join {s} s on s.series_id = l.series_id and s.node = l.nb where l.node {turn} union all select series_id, node, c, 0 from {s} where node {turn}) group by all),
t{level}_{k}b as (select t.series_id, t.node, max({{g: (m2 * t.t - o.d * (z.d - case when t.c = o.c then o.d else 0 end))::bigint, own: t.c = o.c, n: -t.c}}) as b from t{level}_{k} t join (select series_id, c, sum(d) as d from {s} group by all) z on z.series_id = t.series_id and z.c = t.c join {s} o on o.series_id = t.series_id and o.node = t.node join m2 on m2.series_id = t.series_id group by all),
c{level}_{k + 1} as materialized (select s.series_id, s.node, coalesce(-b.n, s.c) as c, s.d from {s} s left join t{level}_{k}b t on t.series_id = s.series_id and t.node = s.node)"""
        last = f"c{level}_{rounds}"
        moves += f""", r{level} as materialized (select series_id, c, row_number() over (partition by series_id order by f) - 1 as r, d from (select series_id, c, min(node) as f, sum(d)::bigint as d from {last} group by 1, 2)), n{level} as materialized (select s.series_id, s.node, r from {last} s join r{level} r on r.series_id = s.series_id and r.c = s.c)"""
        if level == 0:
            moves += ", fl as materialized (select l.series_id, a.r as node, b.r as nb, count(*) as w from lk l join n0 a on a.series_id = l.series_id and a.node = l.node join n0 b on b.series_id = l.series_id and b.node = l.nb where a.r <> b.r group by all), c1_0 as materialized (select series_id, r as node, r as c, d from r0)"
    return f"{moves}, k as materialized (select x.series_id, x.node, coalesce(n1.r, 0) as community from {nodes} x left join n0 on n0.series_id = x.series_id and n0.node = x.node left join n1 on n1.series_id = x.series_id and n1.node = n0.r)"


_K = f"with {_communities(NVG, '(select series_id, idx as node from s)')}"


@query("communities", f"{_K} select series_id, node, community from k")
def _(spark, sf):
    return community.detect_communities(tables.natural(spark, sf))


@query("community_sizes", f"{_K} select series_id, community, count(*) as size from k group by all")
def _(spark, sf):
    return community.community_sizes(community.detect_communities(tables.natural(spark, sf)))


@query("community_counts", f"{_K} select series_id, count(distinct community) as communities from k group by 1")
def _(spark, sf):
    return community.community_sizes(community.detect_communities(tables.natural(spark, sf))).groupBy("series_id").agg(F.count("*").alias("communities"))


_DAYS_S = "s as (select '0' as series_id, row_number() over (order by day) - 1 as idx, revenue as v from (select o_orderdate::date as day, round(sum(o_totalprice), 2) as revenue from orders group by all))"


@query("communities_long", f"with {_communities(NVG.replace(S, _DAYS_S), '(select series_id, idx as node from s)')} select node, community from k")
def _(spark, sf):
    """Of the days of ``orders`` as one series and one graph, over all tasks."""
    g = VisibilityGraph.from_series(tables.days(spark, sf)).with_strategy("long").natural_visibility()
    return community.detect_communities(g, strategy="long").select("node", "community")


_BLOCKS = f"with {NVG}, {DEG}, m as (select series_id, count(*) as m from e group by 1), i as (select series_id, src // 10 as c, count(*) as i from e where src // 10 = dst // 10 group by 1, 2), g as (select series_id, node // 10 as c, sum(degree) as d from d group by 1, 2) select g.series_id, round(sum({{}} * m * coalesce(i, 0) - d * d)::double / (4 * max(m) * max(m)), 6) as modularity from g join m on g.series_id = m.series_id left join i on g.series_id = i.series_id and g.c = i.c group by 1"


def _modularity(variant: str) -> Query:
    def run(spark, sf):
        g = tables.natural(spark, sf)
        blocks = g.nodes.select("series_id", "node", F.floor(F.col("node") / 10).alias("community"))
        return community.modularity(g, blocks, variant).withColumn("modularity", r6("modularity"))

    return run


query("modularity_of_time_blocks", _BLOCKS.format("2"))(_modularity("reference"))
query("modularity_of_time_blocks_standard", _BLOCKS.format("4"))(_modularity("standard"))

# M. Motifs.
_M3 = f"{CC}, z as (select n.series_id, count(*) as n, (sum(d.degree) / 2)::bigint as e, sum(n.triples)::bigint as w, (sum(n.links) / 3)::bigint as t from n join d on n.series_id = d.series_id and n.node = d.node group by 1), y as (select series_id, n, t, w - 3 * t as two, e * (n - 2) - 2 * (w - 3 * t) - 3 * t as one, n * (n - 1) * (n - 2) // 6 as total from z), x as (select series_id, unnest(['empty', 'fork', 'four_edges', 'complete_triangle']) as motif, unnest([0, 1, 2, 3]) as n_edges, unnest([total - one - two - t, one, two, t])::bigint as count, total::bigint as total from y)"


@query("motifs3", f"with {_M3} select series_id, motif, n_edges, count, total from x")
def _(spark, sf):
    return motifs.motifs3(tables.natural(spark, sf))


@query("motif_frequencies", f"with {_M3} select series_id, motif, round(count * 100 / total, 6) as percent from x")
def _(spark, sf):
    return motifs.frequencies(motifs.motifs3(tables.natural(spark, sf))).withColumn("percent", r6("percent"))


@query("motif_summary", f"with {_M3}, tl as (select series_id, count, n_edges, motif || ': ' || count || ' (' || ((count::hugeint * 10000 // greatest(total, 1)) // 100) || '.' || lpad(((count::hugeint * 10000 // greatest(total, 1)) % 100)::varchar, 2, '0') || '%)' as line from x) select series_id, string_agg(line, chr(10) order by count desc, n_edges) as text from tl group by 1")
def _(spark, sf):
    return motifs.summary(motifs.motifs3(tables.natural(spark, sf)))


@query("motif_most_frequent", f"with {_M3} select series_id, arg_max(motif, count * 10 + n_edges) as motif, max(count) as count from x group by 1")
def _(spark, sf):
    return motifs.most_frequent(motifs.motifs3(tables.natural(spark, sf)))


# By pairs of nodes and a third one: bit masks of neighbours tell how many fourth ones make so many edges.
_CLASSES = ["excl - (xor(a.m, b.m) & excl) - (a.m & b.m & excl)", "xor(a.m, b.m) & excl", "a.m & b.m & excl"]
_M4 = f"""with {NVG}, {LINKS}, n as (select series_id, count(*) as n from s group by 1), adj as materialized (select s.series_id, s.idx, n, coalesce(bit_or(1::hugeint << l.nb::int), 0::hugeint) as m from s join n on s.series_id = n.series_id left join l on l.series_id = s.series_id and l.node = s.idx group by all),
two as materialized (select a.series_id, a.idx as i, b.idx as j, (a.m >> b.idx::int) & 1 as e, a.m as am, b.m as bm, {", ".join(f"{c.replace('excl', '(((1::hugeint << a.n::int) - 1) - (1::hugeint << a.idx::int) - (1::hugeint << b.idx::int))')} as c{q}" for q, c in enumerate(_CLASSES))} from adj a join adj b on a.series_id = b.series_id and a.idx < b.idx),
three as (select t.series_id, e + p as base, {", ".join(f"sum(bit_count(c{q} & m)) as s{q}1, sum(bit_count(c{q}) - bit_count(c{q} & m) - case when p = {q} then 1 else 0 end) as s{q}0" for q in range(3))} from (select t.series_id, e, c0, c1, c2, c.m, ((am >> c.idx::int) & 1) + ((bm >> c.idx::int) & 1) as p from two t join adj c on c.series_id = t.series_id and c.idx <> i and c.idx <> j) t group by all),
four as (select series_id, unnest([{", ".join(f"base + {q + x}" for q in range(3) for x in range(2))}]) as n_edges, unnest([{", ".join(f"s{q}{x}" for q in range(3) for x in range(2))}]) as c from three),
names as (select unnest(range(7))::int as n_edges, unnest({list(motifs.FOUR)}) as motif)"""


@query("motifs4", f"{_M4} select n.series_id, motif, names.n_edges, coalesce(sum(c) // 12, 0)::bigint as count, (n.n * (n.n - 1) * (n.n - 2) * (n.n - 3) // 24)::bigint as total from n join names on n.n > 1 left join four on four.series_id = n.series_id and four.n_edges = names.n_edges group by all")
def _(spark, sf):
    return motifs.motifs4(tables.natural(spark, sf))


def _swaps(replicas: int, seed: int = 0) -> str:
    key, same = "series_id, rep", "{0}.series_id = {1}.series_id and {0}.rep = {1}.rep"
    out = f"e0 as materialized (select series_id, rep, src, dst from e, (select unnest(range({replicas})) as rep))"
    p, f = motifs.PRIME, motifs.FACTORS
    for k in range(motifs.SWAPS):
        x = f"(src * {f[0]} + dst * {f[1]} + {k * f[2] + seed * f[4]} + rep * {f[3]}) % {p}"
        out += f""", o{k} as materialized (select *, row_number() over (partition by {key} order by h, src, dst) - 1 as p from (select {key}, src, dst, (y * y % {p}) * x % {p} as h from (select *, x * x % {p} as y from (select *, {x} as x from e{k})))),
v{k} as materialized (select {key}, p, least(a, d) as x1, greatest(a, d) as x2, least(c, b) as y1, greatest(c, b) as y2 from (select f.series_id, f.rep, f.p, f.src as a, f.dst as b, case when f.h % 2 = 1 then g.dst else g.src end as c, case when f.h % 2 = 1 then g.src else g.dst end as d from o{k} f join o{k} g on {same.format("f", "g")} and g.p = f.p + 1 where f.p % 2 = 0) where a <> c and a <> d and b <> c and b <> d),
z{k} as materialized (select v.* from v{k} v left join e{k} x on {same.format("v", "x")} and x.src = x1 and x.dst = x2 left join e{k} y on {same.format("v", "y")} and y.src = y1 and y.dst = y2 where x.src is null and y.src is null),
u{k} as materialized (select {key}, s, d from (select {key}, x1 as s, x2 as d from z{k} union all select {key}, y1, y2 from z{k}) group by all having count(*) = 1),
k{k} as materialized (select z.* from z{k} z join u{k} a on {same.format("z", "a")} and a.s = x1 and a.d = x2 join u{k} b on {same.format("z", "b")} and b.s = y1 and b.d = y2),
e{k + 1} as materialized (select o.series_id, o.rep, coalesce(a.x1, b.y1, src) as src, coalesce(a.x2, b.y2, dst) as dst from o{k} o left join k{k} a on {same.format("o", "a")} and a.p = o.p left join k{k} b on {same.format("o", "b")} and b.p = o.p - 1)"""
    last = f"e{motifs.SWAPS}"
    return f"""{out}, rt as (select x.series_id, x.rep, count(*) as t from {last} x join {last} y on {same.format("x", "y")} and x.dst = y.src join {last} z on {same.format("x", "z")} and x.src = z.src and y.dst = z.dst group by all),
rq as (select m.series_id, m.rep, coalesce(t, 0) as t from (select distinct {key} from e0) m left join rt on {same.format("m", "rt")}),
rw as (select rq.series_id, case when stddev_pop(t) > 0 then (coalesce(any_value(c), 0) - avg(t)) / stddev_pop(t) else 0 end as z from rq left join (select series_id, count(*) as c from t group by 1) o on o.series_id = rq.series_id group by 1)"""


@query("motif_significance", f"with {NVG}, {TRI}, {_swaps(5)} select series_id, unnest({list(motifs.THREE)}) as motif, unnest([round(-z, 6), round(z, 6), round(-z, 6), round(z, 6)]) as z_score from rw")
def _(spark, sf):
    return motifs.motif_significance(tables.natural(spark, sf), 5).withColumn("z_score", r6("z_score"))


# N. Batches and comparison.
_STATS = f"with {DIST}, {DEG.replace(LINKS + ', ', '')}, {TRI}, k as (select series_id, node, count(*) as links from (select series_id, unnest([a, b, c]) as node from t) group by all), n as (select d.series_id, d.node, degree, coalesce(links, 0) as links, degree * (degree - 1) / 2.0 as triples, case when degree < 2 then 0.0 else coalesce(links, 0) / (degree * (degree - 1) / 2.0) end as cc from d left join k on d.series_id = k.series_id and d.node = k.node), {_PATHS}, {_ASSORT}, c as (select series_id, count(*) as node_count, (sum(degree) / 2)::bigint as edge_count, round(avg(degree), 6) as average_degree, min(degree) as min_degree, max(degree) as max_degree, round(stddev_pop(degree), 6) as degree_std_dev, round(var_pop(degree), 6) as degree_variance, round(avg(cc), 6) as average_clustering, round(sum(links) / sum(triples), 6) as global_clustering from n group by 1), st as (select c.series_id, node_count, edge_count, false as is_directed, average_degree, min_degree, max_degree, degree_std_dev, degree_variance, average_clustering, global_clustering, average_path_length, diameter, radius, round(edge_count / (node_count * (node_count - 1) / 2), 6) as density, true as is_connected, 1::bigint as num_components, node_count as largest_component_size, round(case when abs(den) < 1e-10 then 0 else num / den end, 6) as assortativity, 0::bigint as feature_count from c join pt on c.series_id = pt.series_id join ra on c.series_id = ra.series_id join y on c.series_id = y.series_id)"


@query("graph_statistics", f"{_STATS} select * from st")
def _(spark, sf):
    stats = graph_statistics(tables.natural(spark, sf))
    return stats.select(*(r6(c).alias(c) if t == "double" else c for c, t in stats.dtypes))


@query("batch_stats", f"{_STATS} select count(*) as num_graphs, round(avg(edge_count), 6) as avg_edges, round(avg(average_clustering), 4) as avg_clustering, round(avg(average_path_length), 4) as avg_path_length, round(avg(density), 4) as avg_density from st")
def _(spark, sf):
    b = compare.batch_statistics(graph_statistics(tables.natural(spark, sf)))
    return b.select("num_graphs", r6("avg_edges").alias("avg_edges"), *(F.round(c, 4).alias(c) for c in ("avg_clustering", "avg_path_length", "avg_density")))


@query("compare_nvg_hvg", f"with {NVG}, hq as (select *, max(vb) {_BETWEEN} as hm from p), he as (select series_id, src, dst from hq where hm is null or hm < least(va, vb)), {DEG}, {TRI}, k as (select series_id, node, count(*) as links from (select series_id, unnest([a, b, c]) as node from t) group by all), hl as (select series_id, src as node, dst as nb from he union all select series_id, dst, src from he), hd as (select s.series_id, s.idx as node, count(hl.nb) as degree from s left join hl on s.series_id = hl.series_id and s.idx = hl.node group by all), ht as (select x.series_id, x.src as a, x.dst as b, y.dst as c from he x join he y on x.series_id = y.series_id and x.dst = y.src join he z on x.series_id = z.series_id and x.src = z.src and y.dst = z.dst), hk as (select series_id, node, count(*) as links from (select series_id, unnest([a, b, c]) as node from ht) group by all), n as (select d.series_id, d.degree as x, hd.degree as y, case when d.degree < 2 then 0.0 else coalesce(k.links, 0) / (d.degree * (d.degree - 1) / 2.0) end as cx, case when hd.degree < 2 then 0.0 else coalesce(hk.links, 0) / (hd.degree * (hd.degree - 1) / 2.0) end as cy from d join hd on d.series_id = hd.series_id and d.node = hd.node left join k on d.series_id = k.series_id and d.node = k.node left join hk on d.series_id = hk.series_id and d.node = hk.node) select series_id, round(sum(y) / sum(x), 6) as edge_overlap, round(corr(x, y), 6) as degree_correlation, round(abs(avg(cx) - avg(cy)), 6) as clustering_diff, round(abs(sum(x) - sum(y)) / (count(*) * (count(*) - 1)), 6) as density_diff from n group by 1")
def _(spark, sf):
    c = compare.compare_kinds(tables.events(spark, sf))
    return c.select("series_id", *(r6(x).alias(x) for x in c.columns[1:]))


@query("compare_graphs", ORACLES["compare_nvg_hvg"])
def _(spark, sf):
    """The same of two graphs that know nothing of each other."""
    c = compare.compare(tables.natural(spark, sf), tables.horizontal(spark, sf))
    return c.select("series_id", *(r6(x).alias(x) for x in c.columns[1:]))


# O. Signals.
_FFT = f"{S}, x as (select series_id, idx, list(v) {_W.format('rows between 8 preceding and 7 following')} as l from s), m as (select series_id, idx, k, sqrt(pow(list_sum(list_transform(range(len(l)), lambda n: l[n + 1] * cos(2 * pi() * k * n / 16))), 2) + pow(list_sum(list_transform(range(len(l)), lambda n: l[n + 1] * sin(2 * pi() * k * n / 16))), 2)) as mag from x, range(16) r(k))"


@query("fft_dominant", f"with {_FFT} select series_id, idx, arg_max(k, round(mag, 9) * 1000 + k * 1e-9)::int as bin from m where k between 1 and 8 group by 1, 2")
def _(spark, sf):
    found = signal.fft_windows(tables.events(spark, sf), 16)
    return found.select("series_id", "idx", signal.dominant_frequency(F.col("magnitudes")).alias("bin"))


@query("spectral_energy", f"with {_FFT} select series_id, idx, round(sum(mag * mag), 4) as energy from m where k between 1 and 4 group by 1, 2")
def _(spark, sf):
    found = signal.fft_windows(tables.events(spark, sf), 16)
    return found.select("series_id", "idx", F.round(signal.spectral_energy(F.col("magnitudes"), 1, 5), 4).alias("energy"))


_HAAR = f"{S}, h1 as (select series_id, idx // 2 as k, (max(v) filter (idx % 2 = 0) + max(v) filter (idx % 2 = 1)) / sqrt(2) as a, (max(v) filter (idx % 2 = 0) - max(v) filter (idx % 2 = 1)) / sqrt(2) as d from s group by 1, 2 having count(*) = 2)"
for _k in (2, 3):
    _HAAR += f", h{_k} as (select series_id, k // 2 as k, (max(a) filter (k % 2 = 0) + max(a) filter (k % 2 = 1)) / sqrt(2) as a, (max(a) filter (k % 2 = 0) - max(a) filter (k % 2 = 1)) / sqrt(2) as d from h{_k - 1} group by 1, h{_k - 1}.k // 2 having count(*) = 2)"


@query("haar_levels", f"with {_HAAR} " + " union all ".join(f"select series_id, {k} as level, k, round(a, 6) as approximation, round(d, 6) as detail from h{k}" for k in (1, 2, 3)))
def _(spark, sf):
    found = signal.haar_levels(tables.events(spark, sf), 3)
    return found.select("series_id", "level", "k", r6("approximation").alias("approximation"), r6("detail").alias("detail"))


@query("wavelet_energy", f"with {_HAAR} select series_id, round(sum(d * d), 2) as energy from h2 group by 1")
def _(spark, sf):
    return signal.wavelet_energy(tables.events(spark, sf), 2).select("series_id", F.round("energy", 2).alias("energy"))


def _matches(m: int) -> str:
    near = " and ".join(f"abs(a.l[{d}] - b.l[{d}]) <= 20" for d in range(1, m + 1))
    return f"(select series_id, count(*) as c from t a join t b using (series_id) where a.idx <> b.idx and a.idx < a.n - {m} and b.idx < b.n - {m} and {near} group by 1)"


@query("sample_entropy", f"with {S}, t as (select series_id, idx, count(*) over (partition by series_id) as n, list(v) {_W.format('rows between current row and 2 following')} as l from s), z as (select distinct series_id, n from t), a as {_matches(2)}, b as {_matches(3)} select z.series_id, round(case when a.c is null or b.c is null then 0 else -ln((b.c / ((n - 3) * (n - 4))) / (a.c / ((n - 2) * (n - 3)))) end, 6) as sample_entropy from z left join a on z.series_id = a.series_id left join b on z.series_id = b.series_id")
def _(spark, sf):
    return signal.sample_entropy(tables.events(spark, sf), 2, 20.0).withColumn("sample_entropy", r6("sample_entropy"))


@query("hurst", f"with {S}, x as (select *, v - avg(v) over (partition by series_id) as d from s), c as (select *, sum(d) over (partition by series_id order by idx) as c from x) select series_id, round(ln((max(c) - min(c)) / stddev_pop(v)) / ln(count(*)), 6) as hurst from c group by 1")
def _(spark, sf):
    return signal.hurst_exponent(tables.events(spark, sf)).withColumn("hurst", r6("hurst"))


# P. Vectors.
@query("vec_stats", "with x as (select vec_id, list_transform(embedding, lambda e: e::double) as e from embeddings) select vec_id, round(list_sum(e), 5) as total, round(list_avg(e), 5) as mean, round(list_var_pop(e), 5) as variance from x")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    a = F.col("embedding")
    return e.select("vec_id", *(F.round(f(a), 5).alias(k) for k, f in (("total", vector.total), ("mean", vector.mean), ("variance", vector.variance))))


@query("vec_dot_add", "select a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double * b.embedding[i]::double)), 5) as dot, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double + b.embedding[i]::double)), 5) as added from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(vector.dot(F.col("embedding"), F.col("b")), 5).alias("dot"), F.round(vector.total(vector.add(F.col("embedding"), F.col("b"))), 5).alias("added"))


# Q. Matrices.
@query("laplacian", f"with {NVG}, {DEG} select series_id, node as row, node as col, degree::double as value from d where degree > 0 union all select series_id, src, dst, -1.0 from e union all select series_id, dst, src, -1.0 from e")
def _(spark, sf):
    return matrix.laplacian(tables.natural(spark, sf))


@query("matrix_features", f"with {S}, f as (select series_id, idx as node, coalesce(lead(v) over {_O} - v, 0) as a, coalesce(lead(v) over {_O} - 2 * v + lag(v) over {_O}, 0) as b from s) select series_id, node, round(b, 6) as x0, round(a, 6) as x1 from f")
def _(spark, sf):
    own = features.FeatureSet().add_builtin("delta_forward").add_builtin("acceleration")
    g = VisibilityGraph.from_series(tables.events(spark, sf)).with_features(own).natural_visibility()
    return matrix.features(g).select("series_id", "node", *(r6(F.get("row", F.lit(k))).alias(f"x{k}") for k in range(2)))


@query("graph_energy", f"with {NVG} select series_id, round(sqrt(2.0 * count(*)), 6) as graph_energy from e group by 1")
def _(spark, sf):
    return matrix.graph_energy(tables.natural(spark, sf)).withColumn("graph_energy", r6("graph_energy"))


_POWER = "lm as materialized (select * from l), w(k, series_id, node, x) as (select 0, series_id, node, 1 / sqrt(count(*) over (partition by series_id)) from d union all select k + 1, series_id, node, y / sqrt(sum(y * y) over (partition by series_id)) from (select w.k, w.series_id, lm.nb as node, sum(w.x) as y from w join lm on w.series_id = lm.series_id and w.node = lm.node where w.k < 100 group by 1, 2, 3)), f as materialized (select * from w where k = 100)"


@query("dominant_eigenvalue", f"with recursive {NVG}, {DEG}, {_POWER} select a.series_id, round(sum(a.x * b.x), 6) as eigenvalue from f a join lm on a.series_id = lm.series_id and a.node = lm.node join f b on b.series_id = lm.series_id and b.node = lm.nb group by 1")
def _(spark, sf):
    return matrix.dominant_eigenvalue(tables.natural(spark, sf)).withColumn("eigenvalue", r6("eigenvalue"))


@query("random_walk_stationary", "with recursive " + f"{NVG}, {DEG}, w(k, series_id, node, p) as (select 0, series_id, node, 1.0::double / count(*) over (partition by series_id) from d union all select k + 1, series_id, node, p from (select w.k, w.series_id, l.nb as node, sum(w.p / d.degree) as p from w join l on w.series_id = l.series_id and w.node = l.node join d on w.series_id = d.series_id and w.node = d.node where w.k < 10 group by 1, 2, 3)) select series_id, node, round(p, 6) as probability from w where k = 10")
def _(spark, sf):
    return matrix.random_walk_stationary(tables.natural(spark, sf), 10).withColumn("probability", r6("probability"))


# R. Trees and orders.
@query("dijkstra_from_0", f"with {DIST} select series_id, t as node, hops::double as distance from h where s = 0")
def _(spark, sf):
    return paths.dijkstra(tables.natural(spark, sf), 0)


_WAYS = "lw as materialized (select series_id, src as node, dst as nb, abs(vb - va) as w from e union all select series_id, dst, src, abs(vb - va) from e), h(series_id, t, dist) using key (series_id, t) as (select distinct series_id, 0, 0.0::double from s union select h.series_id, lw.nb, min(h.dist + lw.w) from h join lw on h.series_id = lw.series_id and h.t = lw.node left join recurring.h r on r.series_id = h.series_id and r.t = lw.nb where r.dist is null or h.dist + lw.w < r.dist - 1e-9 group by all)"


@query("dijkstra_weighted", f"with recursive {NVG}, {_WAYS} select series_id, t as node, round(dist, 6) as distance from h")
def _(spark, sf):
    g = VisibilityGraph.from_series(tables.events(spark, sf)).with_weight("absdiff").natural_visibility()
    return paths.dijkstra(g, 0).withColumn("distance", r6("distance"))


@query("lightest_edges", f"with {NVG}, n as (select series_id, count(*) as n from s group by 1), r as (select series_id, src, dst, round(abs(vb - va), 6) as weight, row_number() over (partition by series_id order by abs(vb - va), src, dst) as k from e) select r.series_id, src, dst, weight from r join n on r.series_id = n.series_id where k <= n - 1")
def _(spark, sf):
    g = VisibilityGraph.from_series(tables.events(spark, sf)).with_weight("absdiff").natural_visibility()
    return trees.lightest_edges(g).withColumn("weight", r6("weight"))


# An edge is in the tree where no way between its ends keeps to lighter edges.
_RANKED = "rk as materialized (select series_id, src, dst, abs(vb - va) as w, row_number() over (partition by series_id order by abs(vb - va), src, dst) as r from e), lw as materialized (select series_id, src as node, dst as nb, r from rk union all select series_id, dst, src, r from rk), h(series_id, s, t, r) using key (series_id, s, t) as (select series_id, idx, idx, 0 from s union select h.series_id, h.s, lw.nb, min(greatest(h.r, lw.r)) from h join lw on h.series_id = lw.series_id and h.t = lw.node left join recurring.h z on z.series_id = h.series_id and z.s = h.s and z.t = lw.nb where z.r is null or greatest(h.r, lw.r) < z.r group by all)"


@query("mst", f"with recursive {NVG}, {_RANKED} select rk.series_id, src, dst, round(w, 6) as weight from rk join h on h.series_id = rk.series_id and h.s = rk.src and h.t = rk.dst where h.r = rk.r")
def _(spark, sf):
    g = VisibilityGraph.from_series(tables.events(spark, sf)).with_weight("absdiff").natural_visibility()
    return trees.minimum_spanning_tree(g).withColumn("weight", r6("weight"))


@query("mst_by_joins", ORACLES["mst"])
def _(spark, sf):
    """The same over all tasks, as for graphs that are too large for one."""
    g = VisibilityGraph.from_series(tables.events(spark, sf)).with_weight("absdiff").natural_visibility()
    return trees.minimum_spanning_tree(g, strategy="long").withColumn("weight", r6("weight"))


@query("scc", f"with {S} select series_id, idx as node, idx as component from s")
def _(spark, sf):
    return trees.strongly_connected_components(tables.natural(spark, sf))


@query("topological_order", f"with {S} select series_id, idx as node, idx as position from s")
def _(spark, sf):
    return trees.topological_sort(tables.natural(spark, sf))


# B. Sinks.
@query("export_edge_list_csv", f"with {NVG} select series_id, 'source,target,weight' || chr(10) || string_agg(src || ',' || dst || ',1', chr(10) order by src, dst) as text from e group by 1")
def _(spark, sf):
    return sinks.to_edge_list_csv(tables.natural(spark, sf))


@query("export_json", f"with {NVG}, n as (select series_id, count(*) as n from s group by 1), j as (select series_id, string_agg('{{\"source\":' || src || ',\"target\":' || dst || '}}', ',' order by src, dst) as j from e group by 1) select n.series_id, '{{\"nodes\":' || n || ',\"edges\":[' || coalesce(j, '') || ']}}' as json from n left join j on n.series_id = j.series_id")
def _(spark, sf):
    return sinks.to_json(tables.natural(spark, sf), sinks.JsonOptions(include_weights=False))


_LINES = "o as (select series_id, string_agg(line, chr(10) order by part, a, b) as text from ({}) group by 1)"
_DOT = _LINES.format("select series_id, 0 as part, idx as a, 0 as b, '  ' || idx || ' [label=\"' || {} || '\"];' as line from s union all select series_id, 1, src, dst, '  ' || src || ' -- ' || dst || ';' from e")
_DOT_TEXT = "select series_id, 'graph visibility_graph {' || chr(10) || '  rankdir=LR;' || chr(10) || text || chr(10) || '}' || chr(10) as text from o"


@query("export_dot", f"with {NVG}, {_DOT.format('idx')} {_DOT_TEXT}")
def _(spark, sf):
    return sinks.to_dot(tables.natural(spark, sf))


@query("export_dot_labels", f"with {NVG}, {_DOT.format(chr(39) + 'day ' + chr(39) + ' || (idx + 1)')} {_DOT_TEXT}")
def _(spark, sf):
    return sinks.to_dot(tables.natural(spark, sf), F.concat(F.lit("day "), (F.col("node") + 1).cast("string")))


_XML = _LINES.format("select series_id, 0 as part, idx as a, 0 as b, '    <node id=\"n' || idx || '\"></node>' as line from s union all select series_id, 1, src, dst, '    <edge id=\"e' || (row_number() over (partition by series_id order by src, dst) - 1) || '\" source=\"n' || src || '\" target=\"n' || dst || '\"><data key=\"weight\">1.0</data></edge>' from e")
_XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>|<graphml xmlns="http://graphml.graphdrawing.org/xmlns">|  <key id="weight" for="edge" attr.name="weight" attr.type="double"/>|  <graph id="G" edgedefault="undirected">|'


@query("export_graphml", f"with {NVG}, {_XML} select series_id, replace('{_XML_HEAD}', '|', chr(10)) || text || replace('|  </graph>|</graphml>|', '|', chr(10)) as text from o")
def _(spark, sf):
    return sinks.to_graphml(tables.natural(spark, sf))


@query("export_adjacency_csv", f"with {NVG}, r as (select a.series_id, a.idx as row, string_agg(case when e.src is null then '0' else '1' end, ',' order by b.idx) as line from s a join s b on a.series_id = b.series_id left join e on e.series_id = a.series_id and e.src = a.idx and e.dst = b.idx group by 1, 2) select series_id, 'node,' || string_agg(row::varchar, ',' order by row) || chr(10) || string_agg(row || ',' || line, chr(10) order by row) as text from r group by 1")
def _(spark, sf):
    return sinks.to_adjacency_csv(tables.natural(spark, sf))


@query("export_npy")
def _(spark, sf):
    return sinks.to_npy(tables.natural(spark, sf))


@query("export_npy_values", f"with {NVG}, {DEG}, m as (select series_id, sum(k * (3 * src + 2 * dst + 1) + 0)::double as x from (select series_id, src, dst, row_number() over (partition by series_id order by src, dst) as k from e) group by 1), n as (select series_id, count(*) as n, sum(degree * (node + 1))::double as y from d group by 1), c as (select series_id, count(*) as c from e group by 1) select n.series_id, 128 + 24 * c as edges, 128 + 8 * n * n as adjacency, 128 + 8 * n as degrees, x as edge_digest, y as degree_digest from n join c on n.series_id = c.series_id join m on m.series_id = n.series_id")
def _(spark, sf):
    """Lengths of the files, and weighted sums of the numbers read back from them."""
    files = sinks.to_npy(tables.natural(spark, sf))
    back = files.select("series_id", *(F.octet_length(c).cast("long").alias(c) for c in ("edges", "adjacency", "degrees")), sinks.npy_values("edges").alias("e"), sinks.npy_values("degrees").alias("d"))
    weights = F.array(F.lit(3), F.lit(2), F.lit(1))
    digest = lambda values, weight: F.aggregate(F.transform(values, weight), F.lit(0.0), lambda s, x: s + x)
    edge = digest("e", lambda x, i: x * F.get(weights, i % 3) * (F.floor(i / 3) + 1))
    return back.select("series_id", "edges", "adjacency", "degrees", edge.alias("edge_digest"), digest("d", lambda x, i: x * (i + 1)).alias("degree_digest"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("files_parquet", f"with {NVG} select series_id, src as source, dst as target, weight from e")
def _(spark, sf):
    """Edges written in ranges and read back."""
    folder = _folder(spark, "edges")
    sinks.write_parquet(tables.natural(spark, sf), folder)
    return sinks.read_parquet(spark, folder)


@query("files_edges_csv", f"with {NVG} select series_id, src as source, dst as target, weight from e")
def _(spark, sf):
    g, folder = tables.natural(spark, sf), _folder(spark, "edges")
    sinks.write_edges_csv(g, folder)
    return sinks.read_csv(spark, folder, sinks.edge_list(g))


@query("files_features_csv", f"with {S} select series_id, idx as node, round(lead(v) over {_O} - v, 6) as delta_forward, case when v > lag(v) over {_O} and v > lead(v) over {_O} then 1.0::double else 0.0 end as is_local_max from s")
def _(spark, sf):
    own = features.FeatureSet().add_builtin("delta_forward").add_builtin("is_local_max")
    g, folder = VisibilityGraph.from_series(tables.events(spark, sf)).with_features(own).natural_visibility(), _folder(spark, "features")
    sinks.write_features_csv(g, folder)
    return sinks.read_csv(spark, folder, sinks.features_table(g)).withColumn("delta_forward", r6("delta_forward"))


@query("files_dot", ORACLES["export_dot"])
def _(spark, sf):
    texts, folder = sinks.to_dot(tables.natural(spark, sf)), _folder(spark, "dot")
    sinks.write_text(texts, folder)
    return sinks.read_text(spark, folder, texts)


# Of the rest: a dropped value stays missing, own imputations, windows by their numbers, with labels, and labelled batches.
@query("impute_drop", f"with {GAP} select series_id, idx, v as value from s")
def _(spark, sf):
    return impute.impute(tables.gapped(spark, sf), "drop", strict=False).select("series_id", "idx", "value")


@query("impute_custom", f"with {GAP} select series_id, idx, round(coalesce(v, (max(v) {_W.format('rows between 2 preceding and 2 following')} + min(v) {_W.format('rows between 2 preceding and 2 following')}) / 2, 0), 6) as value from s")
def _(spark, sf):
    """The middle of the range of the samples around, else zero."""
    def middle(v, w):
        near = w.rowsBetween(-2, 2)
        return (F.max(v).over(near) + F.min(v).over(near)) / 2

    return impute.impute(tables.gapped(spark, sf), impute.Missing(middle).with_fallback("zero")).select("series_id", "idx", r6("value").alias("value"))


@query("extract_windows", f"with {_WINDOWS} select window_no, series_id, window_start, total from w where exists (select * from w v where v.window_no = w.window_no * 2)")
def _(spark, sf):
    """The windows of the first half, by a table of numbers."""
    every = _windows(spark, sf)
    numbers = every.filter("window_no % 2 = 0").select(F.expr("window_no div 2").alias("window_no"))
    return windows.extract_windows(every, numbers).select("window_no", "series_id", "window_start", r6(vector.total(F.get("window", F.lit(0)))).alias("total"))


@query("window_batches_labelled", f"with {_WINDOWS}, y as (select w.window_no, w.total, b.v as label from w left join s b on b.series_id = w.series_id and b.idx = w.window_start + 8) select window_no // 32 as batch, count(*) as windows, count(label) as labelled, round(sum(label), 3) as labels from y group by 1")
def _(spark, sf):
    """Batches for training: the sample after a window is its label."""
    series = tables.gapped(spark, sf)
    every = _windows(spark, sf)
    labels = every.select("window_no", "series_id", (F.col("window_start") + 8).alias("idx")).join(series, ["series_id", "idx"]).select("window_no", F.col("value").alias("label"))
    b = windows.batches(windows.with_labels(every, labels), 32)
    return b.groupBy("batch").agg(F.count("*").alias("windows"), F.count("label").alias("labelled"), F.round(F.sum("label"), 3).alias("labels"))


@query("batch_of_two_tables", f"with {S}, {_DAYS_S.replace('s as', 'z as')}, b as (select 'events/' || series_id as series_id, idx, v from s union all select 'orders/' || series_id, idx, v from z), p as (select a.series_id, a.idx as src, b.idx as dst, a.v as va, b.v as vb, (b.v - a.v) / (b.idx - a.idx) as slope from b a join b on a.series_id = b.series_id and a.idx < b.idx), q as (select *, max(slope) {_BETWEEN} as most from p), e as (select * from q where most is null or slope > most) select series_id, count(*) as edges, sum(dst - src)::bigint as spans from e group by 1")
def _(spark, sf):
    """Series of two tables as one labelled batch."""
    both = compare.batch({"events": tables.events(spark, sf), "orders": tables.days(spark, sf)})
    return visibility.natural(both).groupBy("series_id").agg(F.count("*").alias("edges"), F.sum(F.col("dst") - F.col("src")).alias("spans"))
