"""What is registered, and the stages of the pipeline on the smallest tables. Queries are compared with their SQL in ``tests/test_queries.py``."""

import re

import __spark_entry__
import corpus_pipeline
from keelson.llm.store import kept

DATA = "/root/testdata/sf0.001"


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found and all(any(re.match(f"op{n}_", q) for q in found) for n in range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = kept(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before)
        if name != "repeated_passages":
            assert all(after[i] == before[i] for i in after)
        else:
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] != before[r["doc_id"]])
        docs, before = out, after
    pieces = kept(corpus_pipeline.STAGES[-1][1](spark, docs, DATA), "packing").collect()
    assert {r["doc_id"] for r in pieces} == set(before)
