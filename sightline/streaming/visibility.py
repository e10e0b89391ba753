"""Horizontal and natural visibility over streams.

Edges only point from earlier samples to the newest, so under arrival in order
every new sample emits its edges at once and no edge is taken back. The state of a series
is what a new sample can still see or be measured by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDGES = "series_id {0}, src long, dst long, weight double"


def _run(kind: str, max_points: int | None):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, at, values = state.get if state.exists else (0, [], [])
        at, values = list(at), list(values)
        src, dst = [], []
        for pdf in batches:
            for v in pdf.sort_values("t")["value"].tolist():
                if v is None or np.isnan(v):
                    raise ValueError(f"missing value in series {key[0]}; impute first")
                if kind == "horizontal":
                    while at and values[-1] < v:
                        src.append(at.pop())
                        values.pop()
                        dst.append(n)
                    if at:
                        src.append(at[-1])
                        dst.append(n)
                        if values[-1] == v:
                            at.pop()
                            values.pop()
                else:
                    # From the newest back: j is seen where the slope to it is below all nearer ones.
                    if at:
                        slope = (v - np.array(values)) / (n - np.array(at))
                        least = np.minimum.accumulate(slope[::-1])[::-1]
                        seen = np.append(slope[:-1] < least[1:], True)
                        found = np.asarray(at)[seen].tolist()
                        src += found
                        dst += [n] * len(found)
                at.append(n)
                values.append(float(v))
                n += 1
                if max_points is not None and len(at) > max_points:
                    raise ValueError(f"series {key[0]} holds more than {max_points} samples that a later one can see")
        state.update((n, at, values))
        yield pd.DataFrame({"series_id": key[0], "src": pd.Series(src, dtype="int64"), "dst": pd.Series(dst, dtype="int64"), "weight": 1.0})

    return step


def visibility_edges(stream: DataFrame, kind: str = "natural", max_points: int | None = None) -> DataFrame:
    """Edges of a stream of (series_id, t, value), appended as samples arrive.

    Samples of a series must arrive in the order of t, at least from one trigger to the
    next. A natural stream keeps all samples of a series, since a high one may see each of them;
    ``max_points``, where it is given, bounds that state with an error, and no edge is ever left out.
    """
    if kind not in ("natural", "horizontal"):
        raise ValueError(f"no kind {kind!r}; there are natural and horizontal")
    schema = EDGES.format(stream.schema["series_id"].dataType.simpleString())
    return stream.select("series_id", "t", F.col("value").cast("double").alias("value")).groupBy("series_id").applyInPandasWithState(_run(kind, max_points), schema, "n long, at array<long>, vals array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_points(stream: DataFrame, time: str, window: str, late: str = "10 minutes") -> DataFrame:
    """Sessions for the batch operators: samples of a stream by tumbling window, as
    sorted arrays, final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy("series_id", F.window(time, window).alias("window")).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), "value"))).alias("samples"))
