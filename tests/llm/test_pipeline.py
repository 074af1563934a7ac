"""The pipeline on the smallest tables: every stage against what it should keep."""

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from atalaya.llm import suffixes

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
            assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "packing"]
    assert suffixes.span_report(seen["repeated_strings"]).where("n_removed > 0 and n_bytes > 400").count() == 0
    pieces = seen["packing"].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(pieces) == seen["repeated_strings"].count()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


def test_registered(spark):
    names = [n for n in queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in names if n[2].isdigit()} == {f"op{i}" for i in range(1, 11)} and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
