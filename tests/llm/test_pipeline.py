"""The pipeline's stages on a small table, each against what it promises."""

from __future__ import annotations

import hashlib

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.select("doc_id", "text").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns
            out = spark.createDataFrame(out.collect(), docs.schema)
            seen.append(out.select("doc_id", "text").collect())
            docs = out
        else:
            last = out.collect()
    rated, kept, exact, near, mixed = seen
    assert 0 < len(kept) < len(rated)
    by_text = {}
    for r in kept:
        by_text[r["text"]] = max(r["doc_id"], by_text.get(r["text"], -1))
    assert {(r["doc_id"], r["text"]) for r in exact} == {(i, t) for t, i in by_text.items()}
    assert {r["doc_id"] for r in near} <= {r["doc_id"] for r in exact} and {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert len(last) == len(mixed)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] for r in last)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
