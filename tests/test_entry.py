"""The driver's contract, and queries against their oracles on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "nvg_edges", "hvg_edges", "hvg_edges_reference_mode", "nvg_degree", "clustering_graph", "path_stats", "betweenness", "motifs3", "feat_all_wide", "impute_chain", "split_series", "compare_nvg_hvg", "graph_statistics", "gen_trend_with_noise",
]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 15 and df.columns[0] == "series_id"


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) > 80


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    def plain(rows):
        return sorted(((tuple(0.0 if x == 0 else x for x in r)) for r in rows), key=lambda r: tuple((x is None, isinstance(x, float) and math.isnan(x), str(x)) for x in r))

    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, df.select(*columns).collect())) == plain(want)
