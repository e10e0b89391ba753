"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores. Each query is
written to a noop sink, after one small warm-up; graphs are not kept between
queries, so every query pays for its own edges. ``calibration`` is the time of a fixed loop on the same
cores, by which runs on machines of different speed can be compared.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
HEADLINES = [
    "nvg_edges", "hvg_edges", "hvg_edges_reference_mode", "nvg_edges_kernel", "nvg_degree", "degree_stats", "clustering_graph", "assortativity", "motifs3",
    "path_stats", "betweenness", "communities", "graph_statistics", "compare_nvg_hvg", "impute_chain", "feat_all_wide", "sliding_windows", "fft_dominant", "haar_levels", "sample_entropy", "hurst", "export_json",
]


def main() -> None:
    from sightline.plans import tables
    from sightline.plans.registry import QUERIES
    from sightline.session import session

    spark = session(f"local[{CPUS}]", int(CPUS), spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    small = str(Path(SF_DIR).parent / "sf0.001")
    QUERIES["nvg_degree"](spark, small if Path(small).exists() else SF_DIR).write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    spark.range(0, 200_000_000, 1, int(CPUS)).selectExpr("sum(hash(id) % 7) x").collect()
    calibration, seconds = round(time.perf_counter() - began, 3), {}
    for name in HEADLINES:
        tables.clear()
        spark.catalog.clearCache()
        began = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "calibration": calibration, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
