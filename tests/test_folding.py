"""Queries reach the index in the form in which documents are stored there."""

from __future__ import annotations

import sys
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import tokens
from quarry.operators import index, legs, search
from quarry.plans import registry

SF = "/root/testdata/sf0.001"


def test_accented_batch_queries_find_their_documents(spark):
    chunks = spark.createDataFrame([("a", 1, "Der süße Käse"), ("a", 2, "plain text"), ("a", 3, "cafe noir")], "source string, chunk_id long, text string")
    queries = spark.createDataFrame([(1, "KÄSE x"), (2, "café"), (3, "süße plain")], "query_id long, text string")
    words = queries.select("query_id", tokens.query_term_column(F.col("text")).alias("words"))
    assert {(r["query_id"], r["chunk_id"]) for r in legs.batch_lexical(chunks, words).collect()} == {(1, 1), (2, 3), (3, 1), (3, 2)}


def test_batch_search_scores_folded_query_words(spark):
    """The registered SQL with the fold that documents get in its query words too (the registered one has none there)."""
    sql = registry.oracle_sql()["batch_search"]
    folded = sql.replace("regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: length(x) > 1", "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), lambda x: length(x) > 1")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = {tuple(r) for r in registry.queries()["batch_search"](spark, SF).select("query_id", "chunk_id", "score", "rank").collect()}
    assert got == set(con.execute(folded).fetchall())


SCRIPTS = {"Vietnamese": "Việt", "Korean": "한국", "Cyrillic": "Йод", "Greek": "Άλφα", "sigma": "ΟΔΟΣ", "Japanese": "ガラス", "Hindi": "हिन्दी"}


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_one_query_in_each_script(spark, form):
    rows = [("a", i, "p", f"{unicodedata.normalize('NFC' if i % 2 else 'NFD', w)}. filler") for i, w in enumerate(SCRIPTS.values())]
    rows += [("a", 50 + i, "p", "other words") for i in range(20)]
    chunks = spark.createDataFrame(rows, "source string, chunk_id long, path string, text string").cache()
    posted = index.postings(chunks).cache()
    stored = posted, index.term_stats(posted), index.corpus_stats(chunks)
    for i, w in enumerate(SCRIPTS.values()):
        query = unicodedata.normalize(form, w)
        words = tokens.query_tokens(query)
        assert [r["chunk_id"] for r in legs.lexical_leg(chunks, words).collect()] == [i], w
        assert [r["chunk_id"] for r in legs.indexed_leg(*stored, words).collect()] == [i], w
        assert [r["chunk_id"] for r in search.search(chunks, None, query).collect()] == [i], w


def test_fold_equals_strip_accents_everywhere(spark):
    """Document expression, query function and the registered SQL's fold: every character, and texts of several."""
    texts = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, sys.maxunicode + 1)] if unicodedata.category(chr(c))[0] in "LNM"]
    texts += [unicodedata.normalize(f, " ".join(SCRIPTS.values()) + " x\u1100 \u1161\u11a8 \uac00\u11a8\u1100\u1161\nend") for f in ("NFC", "NFD")]
    con = duckdb.connect()
    want = dict(con.execute("SELECT x, strip_accents(lower(x)) FROM (SELECT unnest(?::VARCHAR[]) AS x)", [texts]).fetchall())
    assert {x: tokens.fold(x) for x in texts} == want
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", tokens.folded(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == want
