"""Ids that repeat with different texts, and columns called like the operators' own."""

from __future__ import annotations

import random

from quarry.llm import exact_dedup, minmax_dedup, mixing

A = " ".join(f"a{i}" for i in range(40))
B = " ".join(f"b{i}" for i in range(40))
CLASH = "doc_id long, text string, lang string, source string, _id string, _ID2 string, _n long, _sha string, _of string, text_sha256 string, _key string, _sum long, _rows long, _turn int, _gone long, keep_id long"
EXTRA = ("i", "j", 7, "s", "o", "t", "k", 1, 2, 3, 4, 5)


def test_one_id_is_one_document(spark):
    rows = [(5, A), (5, B), (3, B), (9, A), (9, A), (7, "single words here"), (8, ""), (8, A + " tail"), (None, A)]
    got = minmax_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(rows)
    assert found == {(5, 3, False), (3, 3, True), (9, 3, False), (7, 7, True), (8, 3, False), (None, None, True)}


def test_classes_with_one_smallest_id(spark):
    """Two classes whose smallest id is the same, each with a near copy of its own."""
    rng = random.Random(2)
    long = lambda c: [f"{c}{rng.randrange(900)}" for _ in range(120)]
    a, b = long("x"), long("y")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "end"])), (4, " ".join([*b[:-1], "end"])), (6, " ".join(long("z")))]
    got = minmax_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (4, 1), (6, 6)}


def test_clashing_columns(spark):
    rows = [(1, A, "en", "s", *EXTRA), (2, A, "en", "s", *EXTRA), (2, A, "en", "s", *EXTRA), (3, A + " more", "en", None, *EXTRA), (4, None, None, "s", *EXTRA), (None, "", None, "t", *EXTRA)]
    docs = spark.createDataFrame(rows, CLASH)
    exact = exact_dedup.drop_copies(docs)
    assert exact.columns == docs.columns and sorted(r["doc_id"] for r in exact.collect()) == [2, 3, 4]
    near = minmax_dedup.drop_near_copies(docs)
    assert near.columns == docs.columns and sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in near.collect()) == [(False, 0), (True, 1), (True, 4)]
    taken = mixing.take(docs, mixing.entropy_mix(docs))
    assert taken.columns == docs.columns and {r["doc_id"] for r in taken.collect()} <= {1, 2, 3, 4, None}


def test_index_is_probed(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([A, B, A, None, "", A])], "doc_id long, text string")
    _, folder = exact_dedup.build_index(docs, page_bytes=100)
    asked = spark.createDataFrame([(70, A), (71, B + " "), (72, None), (None, B), (70, A)], "doc_id long, text string")
    got = [tuple(r) for r in exact_dedup.probe(asked, folder).collect()]
    assert sorted(got, key=repr) == sorted([(70, 5, 3), (70, 5, 3), (71, None, None), (72, 4, 2), (None, 1, 1)], key=repr)
    slots = [r["bucket"] for r in spark.read.parquet(f"{folder}/directory").orderBy("slot").collect()]
    assert len(slots) > 1 and len(slots) & (len(slots) - 1) == 0
    assert exact_dedup.pages(docs, folder).count() == 3
    with_all = exact_dedup.exact_dedup(docs.withColumn("kept", docs["text"]).withColumn("_sha", docs["doc_id"]))
    assert with_all.columns == ["doc_id", "text", "_sha", "keep_id", "group_size", "kept", "text_sha256"]
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in with_all.collect()} == {(0, 5, 3), (1, 1, 1), (2, 5, 3), (3, 4, 2), (4, 4, 2), (5, 5, 3)}


def test_winners_keep_their_own_columns(spark):
    rows = [(1, "x", "a"), (3, "x", "b"), (2, "x", "c"), (5, None, "d"), (4, "", "e"), (None, "y", "f"), (None, "z", "g"), (7, "z", "h"), (7, "z", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(map(tuple, exact_dedup.drop_copies(docs.repartition(3), page_bytes=2).collect()), key=repr)
    assert [r for r in got if r[1] != "z"] == sorted([(3, "x", "b"), (5, None, "d"), (None, "y", "f")], key=repr)
    assert [(r[0], r[1]) for r in got if r[1] == "z"] == [(7, "z")]
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0
