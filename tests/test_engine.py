"""The search engine: registered queries against DuckDB, and the rules that SQL doesn't show."""

from __future__ import annotations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import structure, text, tokens
from quarry.operators import search, sync
from quarry.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_duckdb(spark, db, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = db.sql(registry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def rows(df):
        return sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()), key=repr)

    assert rows(got) == rows(want)


def test_queries_read():
    assert tokens.query_tokens("The x of Café_bar, the") == ["bar", "cafe", "of", "the"]
    assert tokens.query_phrases("use x-death and foo.bar x-death, plain") == [["x", "death"], ["foo", "bar"]]
    assert tokens.query_tokens("!!! ?") == [] and tokens.query_phrases("plain words") == []


def test_search_edge_rules(spark):
    chunks = spark.createDataFrame([("a", 1, "a.md", "alpha beta gamma"), ("b", 2, "b.md", "alpha foo bar"), ("a", 3, "c.md", None)], "source string, chunk_id long, path string, text string")
    assert search.search(chunks, None, "!!!").count() == 0
    assert [r["chunk_id"] for r in search.search(chunks, None, "alpha", sources=["b"]).collect()] == [2]
    assert {r["chunk_id"] for r in search.search(chunks, None, "alpha", sources=[], limit=0).collect()} == {1, 2}
    # adjacency: "foo.bar" wins over the words apart
    assert search.search(chunks, None, "foo.bar").first()["chunk_id"] == 2


def test_fusion_order(spark):
    leg = lambda ids: spark.createDataFrame(list(enumerate(ids)), "rank long, chunk_id long")
    fused = search.fuse({"phrase": leg([5]), "lexical": leg([7, 5]), "dense": leg([9, 7])}, search.WEIGHTS)
    rows = {r["chunk_id"]: (r["place"], r["score"]) for r in fused.collect()}
    assert rows[5] == (0, 3.0 / 61 + 1.0 / 62) and rows[7][0] == 1 and rows[9][0] == 2


def test_file_diff_and_plan(spark):
    old = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "c", "3")], "source string, path string, sha256 string")
    new = spark.createDataFrame([("s", "a", "1"), ("s", "b", "9"), ("s", "d", "4")], "source string, path string, sha256 string")
    assert {r["path"]: r["action"] for r in sync.file_diff(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    assert sync.counters(sync.file_diff(old, new, force=True)).first().asDict() == {"added": 1, "changed": 2, "removed": 1, "unchanged": 0}


def test_markdown_sections_and_titles():
    md = "---\ntitle: \"Guide\"\n---\n# Top\nintro\n\n```\n# not a heading\n```\n## Sub {#x}\nbody <!-- gone\nstill gone --> kept\n<Note />\nimport x\n"
    sections, title = structure.markdown_sections(md)
    assert title == "Guide" and [s.path for s in sections] == [("Top",), ("Top", "Sub")]
    assert "# not a heading" in sections[0].body and "gone" not in sections[1].body and "kept" in sections[1].body and "<Note" not in sections[1].body and "import" not in sections[1].body


def test_rst_sections():
    rst = "=====\nTitle\n=====\n\n.. toctree::\n   a\n   b\n\n.. _label:\n\nPart\n----\ntext\n"
    sections, title = structure.rst_sections(rst)
    assert title == "Title" and sections[-1].path == ("Title", "Part") and sections[-1].body.strip() == "text" and "toctree" not in sections[0].body


def test_stub_and_size():
    assert structure.split_document("short", "md")[1] == []
    body = "\n\n".join("word " * 60 for _ in range(80))
    passages = structure.split_document(body, "txt")[1]
    assert [p.ord for p in passages] == list(range(len(passages))) and all(len(p.text) <= structure.MOST for p in passages)
    line = "x" * 9000  # one line is never cut
    assert [len(p.text) for p in structure.split_document(line, "txt")[1]] == [9000]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab #\n`~-=.<!>", max_size=400), st.sampled_from(["md", "rst", "txt"]))
def test_split_never_fails(body, suffix):
    passages = structure.split_document(body, suffix)[1]
    assert [p.ord for p in passages] == list(range(len(passages)))


@given(st.text(max_size=80))
def test_normalize_is_idempotent(x):
    once = text.normalize(x)
    assert text.normalize(once) == once and text.slugify(x) and len(text.slugify(x)) <= text.SLUG_CHARS


def test_split_table(spark):
    files = spark.createDataFrame([("s", "a.md", "# T\n" + "word " * 50), ("s", "b.txt", None)], "source string, path string, text string")
    rows = structure.split_documents(files).collect()
    assert [(r["path"], r["ord"], r["heading_path"]) for r in rows] == [("a.md", 0, "T")]


def test_entry_imports_without_extras():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and "hybrid_search" in entry.oracle_sql()
