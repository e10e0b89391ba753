from sightline.llm import queries
from sightline.llm.simhash import fingerprint

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "decontam", "mixing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            fps = [fingerprint(r.text) for r in rows]
            assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
        before = set(ids)
    assert rows and {"doc_id", "size", "taken"} <= set(docs.columns)


def test_columns_of_any_name(spark):
    """Other columns may have the names that operators use inside."""
    more = ["_0", "_1", "_2", "_k", "_id", "_sightline_0", "_sightline_1", "_sightline_2", "r", "fp", "row"]
    text = "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 40
    docs = spark.createDataFrame([(i, t, "s", None if t is None else len(t), *(f"x{k}" for k in range(len(more)))) for i, t in ((1, text), (1, text), (None, text), (2, None), (3, ""), (4, "plain words of another kind " + text))], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in more))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and all(r["fp"] == "x9" for r in out.collect())
    assert corpus_pipeline.mixed(spark, docs, "").count() == 6


def test_run_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows; and no rows at all."""
    for k, docs in enumerate((odd, none)):
        sf = f"{tmp_path}/{k}"
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(0, 1, 0), (3, 0, 1), (None, 1, 1), (12, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, sf).collect()
        # 13 rows, of which the empty three are one class, the repeated five rows another
        assert len(rows) == (0 if k else len({r.doc_id for r in rows})) and (k or 0 < len(rows) <= 9)
        assert all(r.taken <= 3 * r["size"] for r in rows)


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
