"""Operators against independent solutions: the mix's rates, a rejected host, the classifier on rows it never saw."""

from __future__ import annotations

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarry.llm import bpe, mixing, quality_classifier, quality_rules

SF = "/root/testdata/sf0.01"


def solved_rates(sizes: np.ndarray, target: float, cap: int = 3) -> np.ndarray:
    """Rates of one source by plain bisection of the multiplier."""
    if not sizes.sum() or target >= cap * sizes.sum():
        return np.where(sizes > 0, float(cap), 1.0)
    low, high = -60.0, 60.0
    rate = lambda lam: np.where(sizes > 0, np.minimum(cap, np.exp(np.minimum(lam * sizes / sizes.mean(), 50))), 1.0)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if (rate(middle) * sizes).sum() < target else (low, middle)
    return rate(low)


def test_mix_meets_targets_with_the_duals_rates(spark):
    rows = mixing.op1_entropy_mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and len(by_source) > 5
    for found in by_source.values():
        target = found[0]["target"]
        assert abs(sum(r["taken"] for r in found) - target) <= 0.005 * target
        rates = solved_rates(np.array([r["size"] for r in found], float), target)
        assert np.abs(rates - [r["rate"] for r in found]).max() < 1e-4


def test_a_bad_host_takes_its_good_documents_along(spark):
    words = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(k, words(60, k), f"h{k % 6}") for k in range(300)]
    rows += [(1000 + k, words(10, k), "bad") for k in range(90)] + [(2000 + k, words(60, k), "bad") for k in range(5)]
    rows += [(3000 + k, words(10, k), "small") for k in range(2)] + [(4000, words(60, 0), None), (4001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    # shrinkage by hand: rates of short documents are drawn from a beta distribution fitted by moments
    hosts = defaultdict(lambda: [0, 0])
    for _, text, host in rows:
        hosts[host][0] += 1
        hosts[host][1] += len((text or "").split()) < quality_rules.MIN_WORDS
    n, mean = len(rows), sum(f for _, f in hosts.values()) / len(rows)
    within = mean * (1 - mean)
    between = sum(m * (f / m - mean) ** 2 for m, f in hosts.values()) / n - within * len(hosts) / n
    k = min(max(within / between - 1, 1.0), 1e6)
    rejected = {h for h, (m, f) in hosts.items() if (f + mean * k) / (m + k) > quality_rules.HOST_LIMIT}
    assert "bad" in rejected and not rejected & {f"h{k}" for k in range(6)}
    assert all(r["host_rejected"] == (host in rejected) for (doc, _, host) in rows for r in [found[doc]])
    assert all(not found[2000 + k]["base_failed"] and not found[2000 + k]["kept"] for k in range(5))
    # the registered SQL says the same
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    want = db.sql(f"SELECT doc_id, kept FROM ({quality_rules.ORACLE_SQL})").fetchall()
    assert sorted(want) == sorted((d, r["kept"]) for d, r in found.items())


def test_classifier_on_ratings_it_never_saw(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = [r["doc_id"] for r in labels.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    seen = labels.where(~labels.doc_id.isin(held))
    rows = quality_classifier.score(docs, quality_classifier.train(docs, seen)).join(labels.where(labels.doc_id.isin(held)), "doc_id").select("kept", "quality").collect()
    right = sum(r["kept"] == (r["quality"] >= 1) for r in rows)
    clean = [r["kept"] for r in rows if r["quality"] >= 1]
    assert len(rows) > 50 and right >= 0.9 * len(rows) and sum(clean) >= 0.95 * len(clean)


@pytest.mark.parametrize("long_piece", [16, 1 << 20])
def test_matrix_and_heap_merge_alike(monkeypatch, long_piece):
    import public_tokenizers as P

    encoder = bpe.loaded(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(5)
    pieces = [bytes(rng.choice(list(b"abcdest "), int(n)).tolist()) for n in rng.integers(17, 3000, 30)] + [b"a" * 2500, b" " * 2049]
    want, sizes = encoder.encode_pieces(pieces)
    monkeypatch.setattr(bpe, "LONG_PIECE", long_piece)
    found, again = encoder.encode_pieces(pieces)
    assert (found == want).all() and (again == sizes).all()
