"""Visibility edges of series that are too long for one task.

A series is cut into spans of SPAN samples, each a row and an array of its own. What happens within a span is
settled there; what crosses spans is settled by joins of what can be seen of a span from outside. No row and no task
holds a whole series.

Natural edges follow a binary tree over the spans. Two samples meet at the node whose left half has one and whose
right half the other, and see each other when the slope between them is above every slope from the left
sample to the rest of its half, and below every slope from what precedes it in its half to the right sample. Both
bounds grow with the half by a tangent to the upper hull of the half that joins it, so a span needs the hulls of its
siblings on the way up, about one for each doubling of the series. Samples whose tangent shows nothing new are not
seen from across; the others are candidates of the node, and pairs of these in chunks are compared. The same
tree goes on within a span down to LEAF samples.

Horizontal edges join a sample to the next one that is as high or higher, and to the last one before it that is. Most
find theirs in their span. The strict maxima from the right (or left) go to the nearest span whose maximum
reaches them, known from the spans' maxima, and there meet the maxima from the other side.

Samples that are collinear but for rounding are decided by rounding, here by both slopes and in the short kernel by those from the left
sample. Memory: a span's arrays and a hull; a hull has a few dozen points, but all samples where they are concave.
Pairs of candidates are few as well, but all pairs where samples are convex, and then all of them are edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored

SPAN, LEAF, CHUNK = 1 << 13, 128, 1024
#: Slopes that are formed together, and edges that are handed on together.
CELLS, EDGES = 1 << 20, 100_000
Points = tuple[np.ndarray, np.ndarray]


def hull(x: np.ndarray, v: np.ndarray) -> Points:
    """The upper hull of points in ascending x, without points on a line between others."""
    keep: list[tuple[int, float]] = []
    # Whole numbers are compared exactly.
    whole = len(v) > 0 and bool((v == np.rint(v)).all()) and np.abs(v).max() < 1 << 40
    for a, b in zip(x.tolist(), (v.astype(np.int64) if whole else v).tolist(), strict=True):
        while len(keep) > 1 and (keep[-1][1] - keep[-2][1]) * (a - keep[-1][0]) <= (b - keep[-1][1]) * (keep[-1][0] - keep[-2][0]):
            keep.pop()
        keep.append((a, b))
    return np.array([a for a, _ in keep], np.int64), np.array([b for _, b in keep], float)


def tangents(x: np.ndarray, v: np.ndarray, other: Points, left: bool) -> np.ndarray:
    """For each point the greatest slope to a hull on its right, or the least from one on its left (``left``)."""
    hx, hv = (a[::-1] for a in other) if left else other
    sign = -1 if left else 1

    def slope(k: np.ndarray) -> np.ndarray:
        return sign * (hv[k] - v) / (hx[k] - x)

    low, high = np.zeros(len(x), np.int64), np.full(len(x), len(hx) - 1)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        rising = slope(mid) < slope(np.minimum(mid + 1, len(hx) - 1))
        low, high = np.where(open_ & rising, mid + 1, low), np.where(open_ & ~rising, mid, high)
    return sign * slope(low)


def seen_across(lx, lv, above, rx, rv, below) -> Iterator[Points]:
    """Places (left, right) of the pairs whose slope lies between the bounds."""
    step = max(1, CELLS // max(1, len(rx)))
    for at in range(0, len(lx), step):
        part = slice(at, at + step)
        slope = (rv - lv[part, None]) / (rx - lx[part, None])
        i, j = np.nonzero((slope > above[part, None]) & (slope < below))
        if len(i):
            yield i + at, j


def _leaves(v: np.ndarray, size: int, edges: bool) -> tuple[list[Points], np.ndarray, np.ndarray]:
    """Of runs of ``size`` samples, all at once: pairs, the greatest slope to later samples of a run and the least from earlier ones."""
    runs = -(-len(v) // size)
    # One row for each place in a run; the rows past the end are not seen and see nothing.
    rows = np.append(v, np.full(runs * size - len(v), -np.inf)).reshape(runs, size).T.copy()
    above, below, pairs = np.full(rows.shape, -np.inf), np.full(rows.shape, np.inf), []
    with np.errstate(invalid="ignore"):
        for d in range(1, size):
            slope = rows[d:] - rows[:-d]
            slope /= d
            if edges:
                place, run = np.nonzero(slope > above[:-d])
                src = run * size + place
                pairs.append((src, src + d))
            np.maximum(above[:-d], slope, out=above[:-d])
            np.minimum(below[d:], slope, out=below[d:])
    return pairs, above.T.ravel()[: len(v)], below.T.ravel()[: len(v)]


def _reach(x: np.ndarray, v: np.ndarray, hulls: list[Points], size: int) -> np.ndarray:
    """``tangents`` of all samples of runs of ``size`` to the hull of the run beside theirs; a last run without one has no sense here."""
    lengths = np.array([len(hx) for hx, _ in hulls])
    begin = np.cumsum(lengths) - lengths
    hx, hv = (np.concatenate(a) for a in zip(*hulls, strict=True))
    run = (x - x[0]) // size
    other = np.minimum(run ^ 1, len(hulls) - 1)
    # Points are numbered from the nearest end of the other run's hull outwards on the right, and from its far end on the left.
    step = np.where(run & 1, -1, 1)
    start, high = np.where(run & 1, begin[other] + lengths[other] - 1, begin[other]), lengths[other] - 1
    low = np.zeros(len(x), np.int64)

    def slope(k: np.ndarray) -> np.ndarray:
        at = start + step * k
        return step * (hv[at] - v) / (hx[at] - x)

    last = high
    with np.errstate(divide="ignore", invalid="ignore"):
        while (open_ := low < high).any():
            mid = (low + high) // 2
            rising = slope(mid) < slope(np.minimum(mid + 1, last))
            low, high = np.where(open_ & rising, mid + 1, low), np.where(open_ & ~rising, mid, high)
        return step * slope(low)


def natural_within(v: np.ndarray, first: int = 0, edges: bool = True):
    """Of one array: pairs (src, dst) in pieces, the greatest slope to later samples, the least from earlier ones, the hull.

    Without ``edges`` there are no pairs. Runs of LEAF samples are settled by all their slopes, then pairs of runs are joined,
    all of a level together.
    """
    n, x, size = len(v), np.arange(first, first + len(v)), LEAF
    found, above, below = _leaves(v, size, edges)
    pairs = [(src + first, dst + first) for src, dst in found if len(src)]
    hulls = []
    for at in range(0, n, size):
        part = slice(at, at + size)
        k = np.flatnonzero(~(above[part] > below[part]))  # no other is on the hull
        hulls.append(hull(x[part][k], v[part][k]))
    while len(hulls) > 1:
        reach, run = _reach(x, v, hulls, size), np.arange(n) // size
        alone = run == (len(hulls) - 1 if len(hulls) % 2 else -1)
        right = run % 2 == 1
        out, in_ = ~right & ~alone & (reach > above), right & (reach < below)
        if edges:
            l, r = np.flatnonzero(out), np.flatnonzero(in_)
            starts = np.arange(0, len(hulls) // 2 + 1) * 2 * size
            l_at, r_at = np.searchsorted(l, starts), np.searchsorted(r, starts)
            for k in range(len(hulls) // 2):
                a, b = l[l_at[k] : l_at[k + 1]], r[r_at[k] : r_at[k + 1]]
                pairs += [(x[a][i], x[b][j]) for i, j in seen_across(x[a], v[a], above[a], x[b], v[b], below[b])]
        above[out], below[in_] = reach[out], reach[in_]
        hulls = [hull(*(np.concatenate(p) for p in zip(*hulls[k : k + 2], strict=True))) if k + 1 < len(hulls) else hulls[k] for k in range(0, len(hulls), 2)]
        size *= 2
    return pairs, above, below, hulls[0]


def _spans(s: DataFrame) -> DataFrame:
    """series_id, span, values; of s: series_id, idx, v."""
    span = F.floor(F.col("idx") / SPAN).cast("long").alias("span")
    return s.groupBy("series_id", span).agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("a")).select("series_id", "span", F.col("a.v").alias("values"))


def _schema(df: DataFrame, fields: str) -> T.StructType:
    return T.StructType([df.schema["series_id"], *T._parse_datatype_string(fields).fields])


def _mapped(df: DataFrame, fields: str, rows) -> DataFrame:
    """``rows`` makes tuples of (columns, each an array of one length or a list of arrays) of a row as Python values; the series_id is added."""
    schema = _schema(df, fields)
    names = [f.name for f in schema.fields]
    types = [pa.list_(pa.int64() if f.dataType.elementType == T.LongType() else pa.float64()) if isinstance(f.dataType, T.ArrayType) else pa.int64() if f.dataType == T.LongType() else pa.float64() for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: _value(batch.column(c), k) for c in batch.schema.names[1:]}
                for columns in rows(row):
                    n = len(columns[0])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, k))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return df.mapInArrow(run, schema)


def _value(column: pa.Array, k: int):
    x = column[k]
    if not isinstance(x, pa.ListScalar):
        return x.as_py()
    return x.as_py() if isinstance(x.values, pa.StructArray) else x.values.to_numpy(zero_copy_only=False)


def _edge_pieces(pairs, first: int, v: np.ndarray):
    """The pairs with their values, small pieces together and large ones cut."""
    held, size = [], 0

    def out():
        src, dst = (np.concatenate(x) for x in zip(*held, strict=True))
        for at in range(0, len(src), EDGES):
            a, b = src[at : at + EDGES], dst[at : at + EDGES]
            yield a, b, v[a - first], v[b - first]

    for src, dst in pairs:
        held.append((src, dst))
        size += len(src)
        if size >= EDGES:
            yield from out()
            held, size = [], 0
    if size:
        yield from out()


EDGE = "src long, dst long, va double, vb double"


def natural_pairs(s: DataFrame) -> DataFrame:
    """series_id, src, dst, va, vb of ``s`` (series_id, idx, v), natural visibility."""
    spans = stored(_spans(s), "spans")
    within = _mapped(spans, EDGE, lambda r: _edge_pieces(natural_within(r["values"], r["span"] * SPAN)[0], r["span"] * SPAN, r["values"]))

    def state(r):
        _, above, below, (hx, hv) = natural_within(r["values"], r["span"] * SPAN, edges=False)
        yield [r["span"]], [r["values"]], [above], [below], [hx], [hv]

    states = stored(_mapped(spans, "span long, v array<double>, above array<double>, below array<double>, hx array<long>, hv array<double>", state), "states")
    counts = states.groupBy("series_id").agg((F.max("span") + 1).alias("spans"))
    # Levels at which a series of so many spans has two halves.
    levels = counts.filter("spans > 1").select("series_id", "spans", F.explode(F.sequence(F.lit(0), F.ceil(F.log2("spans")).cast("int") - 1)).alias("level"))
    # The hull of every node of the tree, from the hulls of its spans: a span has one ancestor for each level.
    parts = states.select("series_id", "span", "hx", "hv").join(levels, "series_id")
    grouped = parts.groupBy("series_id", "spans", "level", F.expr("shiftright(span, level)").alias("node")).agg(F.sort_array(F.collect_list(F.struct("span", "hx", "hv"))).alias("parts"))
    merged = grouped.select("series_id", "spans", F.col("level").cast("long").alias("level"), "node", F.flatten("parts.hx").alias("hx"), F.flatten("parts.hv").alias("hv"))

    def node_hull(r):
        hx, hv = hull(r["hx"], r["hv"])
        yield [r["spans"]], [r["level"]], [r["node"]], [hx], [hv]

    hulls = _mapped(merged, "spans long, level long, node long, hx array<long>, hv array<double>", node_hull)
    # Each node's hull goes to the spans of its sibling.
    sibling, width = F.col("node").bitwiseXOR(F.lit(1)), F.expr("shiftleft(1L, cast(level as int))")
    first, last = sibling * width, F.least((sibling + 1) * width, F.col("spans")) - 1
    sent = hulls.withColumns({"first": first, "last": last}).filter("first <= last").select("series_id", F.explode(F.sequence("first", "last")).alias("span"), "level", "hx", "hv")
    sent = sent.groupBy("series_id", "span").agg(F.sort_array(F.collect_list(F.struct("level", "hx", "hv"))).alias("hulls"))

    def candidates(r):
        v, above, below, span = r["v"], r["above"].copy(), r["below"].copy(), r["span"]
        x = np.arange(span * SPAN, span * SPAN + len(v))
        for h in r["hulls"]:
            right = (span >> h["level"]) & 1
            reach = tangents(x, v, (np.array(h["hx"]), np.array(h["hv"])), bool(right))
            found = np.flatnonzero(reach < below if right else reach > above)
            for at in range(0, len(found), CHUNK):
                k = found[at : at + CHUNK]
                yield [h["level"]], [span >> (h["level"] + 1)], [right], [x[k]], [v[k]], [(below if right else above)[k]]
            if right:
                below = np.minimum(below, reach)
            else:
                above = np.maximum(above, reach)

    seen = states.select("series_id", "span", "v", "above", "below").join(sent, ["series_id", "span"])
    seen = stored(_mapped(seen, "level long, node long, side long, x array<long>, v array<double>, bound array<double>", candidates), "candidates")
    sides = [seen.filter(f"side = {k}").select("series_id", "level", "node", *(F.col(c).alias(f"{p}{c}") for c in ("x", "v", "bound"))) for k, p in enumerate("lr")]
    pairs = sides[0].join(sides[1], ["series_id", "level", "node"]).select("series_id", "lx", "lv", "lbound", "rx", "rv", "rbound")

    def cross(r):
        for i, j in seen_across(r["lx"], r["lv"], r["lbound"], r["rx"], r["rv"], r["rbound"]):
            yield r["lx"][i], r["rx"][j], r["lv"][i], r["rv"][j]

    return within.union(_mapped(pairs, EDGE, cross))


def maxima(v: np.ndarray) -> np.ndarray:
    """Places of samples above all before them."""
    most = np.maximum.accumulate(v)
    return np.flatnonzero(np.append(True, v[1:] > most[:-1]))


def horizontal_pairs(s: DataFrame) -> DataFrame:
    """The same for horizontal visibility."""
    from .visibility import horizontal_blocks

    spans = stored(_spans(s), "spans")

    def own(r):
        first = r["span"] * SPAN
        return _edge_pieces(((a + first, b + first) for a, b in horizontal_blocks(r["values"])), first, r["values"])

    def state(r):
        v, first = r["values"], r["span"] * SPAN
        left, right = maxima(v), len(v) - 1 - maxima(v[::-1])
        yield [r["span"]], [left + first], [v[left]], [right + first], [v[right]], [v.max()]

    states = stored(_mapped(spans, "span long, px array<long>, pv array<double>, qx array<long>, qv array<double>, top double", state), "states")
    tops = states.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("span", "top"))).alias("a")).select("series_id", F.col("a.top").alias("tops"))

    def route(r):
        """What finds nothing in its span goes on to the right (0) or left (1)."""
        span, tops = r["span"], r["tops"]
        for way, x, v, beyond in ((0, r["qx"], r["qv"], tops[span + 1 :]), (1, r["px"], r["pv"], tops[:span][::-1])):
            at = np.searchsorted(np.maximum.accumulate(beyond), v, "left")
            x, v, at = (a[at < len(beyond)] for a in (x, v, at))
            to = span + 1 + at if way == 0 else span - 1 - at
            for t in np.unique(to):
                yield [int(t)], [way], [x[to == t]], [v[to == t]]

    sent = _mapped(states.join(tops, "series_id"), "span long, way long, x array<long>, v array<double>", route)

    def meet(r):
        x, v = r["x"], r["v"]
        if r["way"] == 0:
            at = np.searchsorted(r["pv"], v, "left")
            yield x, r["px"][at], v, r["pv"][at]
        else:
            at = np.searchsorted(r["qv"], v, "left")
            above = r["qv"][at] > v  # equal ones are found from the left
            yield r["qx"][at][above], x[above], r["qv"][at][above], v[above]

    met = sent.join(states.drop("top"), ["series_id", "span"]).select("series_id", "way", "x", "v", "px", "pv", "qx", "qv")
    return _mapped(spans, EDGE, own).union(_mapped(met, EDGE, meet))
