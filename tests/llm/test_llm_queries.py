"""The registered queries on sf0.001, and the pipeline on a small folder of its own."""

import os

import duckdb
import pytest

import corpus_pipeline
from tidewater.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.sql(Q.SQL[name])
    columns = sorted(want.columns)
    df = Q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_pipeline(spark, tmp_path):
    from test_llm_operators import near_copies, prose

    item = prose(700, 30)
    texts = [prose(i, 60) for i in range(40)] + near_copies(6, 80, 1, 41) + [prose(60, 50) + " " + item, 'token = "0123456789abcdef0123456789abcdef01234567" ' + prose(61, 40), None, "", prose(62, 3000)]
    texts += [prose(i, 40) + " vileness scumbagel " + prose(i + 900, 10) for i in range(100, 140)]
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 51)) for i in range(30)] + [(i, 1, 1) for i in range(51, 81)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/out-{name}")
        docs = spark.read.parquet(f"{d}/out-{name}")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    clean = set(range(51))
    assert kept["toxicity"] == clean
    assert kept["ngram_jaccard_join"] == clean - set(range(41, 46))
    assert kept["benchmark_decontamination"] == kept["ngram_jaccard_join"] - {46}
    assert kept["secret_scans"] == kept["best_fit_packing"] == kept["benchmark_decontamination"]
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in spark.read.parquet(f"{d}/out-secret_scans").collect()}
    assert masked[47][0].startswith("[secret]") and masked[47][1] == len(masked[47][0]) and masked[1][0] == texts[1] and masked[48][0] is None
    assert corpus_pipeline.run(spark, d).count() == docs.count()
