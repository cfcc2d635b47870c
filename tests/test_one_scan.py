"""Statistics and postings of a query where no index is stored: one pass over the texts, no Python workers."""

from __future__ import annotations

import re

from quarry.operators import index, legs
from quarry.plans import registry

SF = "/root/testdata/sf0.001"
ROWS = [("a", 1, "The Café, the CAFÉ and the bar"), ("b", 2, None), ("a", 3, ""), ("b", 4, "!!! ?"), ("b", 5, "bar_bar cafe"), (None, 6, "other words " * 500), ("a", 7, "한국 한국")]


def _final_plan(df) -> str:
    """The plan as it was run, its `Initial Plan` left out."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _chunks(spark):
    return spark.createDataFrame(ROWS, "source string, chunk_id long, text string")


def test_term_stats_runs_no_python(spark):
    assert "EvalPython" not in _final_plan(registry.queries()["term_stats"](spark, SF))


def test_document_frequencies_equal_those_of_postings(spark):
    chunks = _chunks(spark)
    want = {r["term"]: r["df"] for r in index.term_stats(index.postings(chunks)).collect()}
    assert want["cafe"] == 2 and want["bar"] == 2 and want["한국"] == 1
    assert {r["term"]: r["df"] for r in index.document_frequencies(chunks).collect()} == want


def test_query_over_texts_tokenises_them_once(spark):
    plan = _final_plan(registry.queries()["bm25_postings_top50"](spark, SF))
    assert "EvalPython" not in plan
    assert plan.count("FileScan") == 1 and len(re.findall(r"Generate inline\(array\(struct\(t, regexp_extract_all", plan)) == 1
    assert plan.count("ReusedExchange") == 2


def test_query_index_equals_the_whole_index(spark):
    chunks, words = _chunks(spark), ["the", "cafe", "bar", "한국", "absent", "bar"]
    posted, terms, stats = index.query_index(chunks, words)
    whole = index.postings(chunks)
    columns = ["source", "chunk_id", "term", "tf_text", "tf_heading", "dl"]
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(posted.select(columns)) == rows(whole.where(whole.term.isin(words)).select(columns))
    assert rows(terms) == rows(index.term_stats(whole).where(whole.term.isin(words)))
    assert rows(stats) == rows(index.corpus_stats(chunks))
    for sources in (None, ["b"]):
        got = legs.indexed_leg(*index.query_index(chunks, words), words, sources)
        assert rows(got) == rows(legs.indexed_leg(whole, index.term_stats(whole), index.corpus_stats(chunks), words, sources))
    posted, terms, stats = index.query_index(chunks, [])
    assert posted.count() == 0 and terms.count() == 0 and stats.first()["n"] == len(ROWS)


def test_one_file_is_dealt_and_many_are_not(spark, tmp_path):
    path = str(tmp_path / "chunks")
    _chunks(spark).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    assert "REPARTITION" in _final_plan(index.dealt(one)) and sorted(r["chunk_id"] for r in index.dealt(one).collect()) == [1, 2, 3, 4, 5, 6, 7]
    _chunks(spark).repartition(7).write.mode("overwrite").parquet(path)
    many = spark.read.parquet(path)
    assert len(many.inputFiles()) >= 4 and index.dealt(many) is many
