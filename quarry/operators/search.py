"""Fusion of ranked legs and the search call."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.tokens import TOKEN, query_phrases, query_term_column, query_tokens
from quarry.operators.legs import CANDIDATES, dense_leg, indexed_leg, indexed_phrase_leg, lexical_leg, phrase_leg
from quarry.shipping import ship

#: Fixed values of the fusion.
RRF_K = 60
WEIGHTS = {"phrase": 3.0, "lexical": 1.0, "dense": 1.0}
RERANK_WEIGHTS = {"retrieval": 1.0, "rerank": 1.5}
RERANK_POOL = 40
DEFAULT_LIMIT = 8
SCORE_DIGITS = 6


def fuse(legs: dict[str, DataFrame], weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion: (chunk_id, score, place), place from 0.

    Each leg is (chunk_id, rank).  A chunk's score is the sum of weight / (k + rank + 1) in the order of ``legs``;
    equal scores keep the order of first mention: earlier leg, then better rank.
    """
    names = list(legs)
    rows = None
    for i, name in enumerate(names):
        one = legs[name].select("chunk_id", F.lit(i).alias("leg"), F.col("rank").cast("long").alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.groupBy("chunk_id").agg(*[F.min(F.when(F.col("leg") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(names))], F.min(F.struct("leg", "rank")).alias("first"))
    score: Column | None = None
    for i, name in enumerate(names):
        part = F.coalesce(F.lit(weights[name]) / (F.col(f"r{i}") + F.lit(k + 1)), F.lit(0.0))
        score = part if score is None else score + part
    order = [F.col("score").desc(), F.col("first.leg"), F.col("first.rank")]
    scored = wide.select("chunk_id", score.alias("score"), "first")
    return scored.withColumn("place", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")).select("chunk_id", "score", "place")


class HashingEmbedder:
    """Signed hashed token counts, normalised: deterministic and honest about not being semantic."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def query(self, text: str) -> list[float]:
        return _hashed_vector(tuple(query_tokens(text)), self.dim)

    def passages(self, column: Column) -> Column:
        """The embedding of a text column as array<float>; its words are folded as a query's are."""
        dim = self.dim

        def embed(words: pa.Array) -> pa.Array:
            return pa.array([_hashed_vector(x, dim) for x in words.to_pylist()], pa.list_(pa.float32()))

        if (spark := SparkSession.getActiveSession()) is not None:  # a column doesn't know its session
            ship(spark)
        return F.arrow_udf(embed, "array<float>")(query_term_column(column))


@functools.lru_cache(maxsize=1 << 16)
def _bucket(term: str) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16)


def _hashed_vector(words: Sequence[str], dim: int) -> list[float]:
    out = [0.0] * dim
    for d in map(_bucket, words):
        out[d % dim] += 1.0 if (d >> 16) % 2 == 0 else -1.0
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def overlap_scorer(query: str) -> Callable[[DataFrame], DataFrame]:
    """A deterministic stand-in for a cross-encoder: the share of the query's tokens that a passage holds."""
    words = query_tokens(query)

    def score(pool: DataFrame) -> DataFrame:
        have = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 0)
        found = sum((F.array_contains(have, w).cast("int") for w in words), F.lit(0))
        return pool.withColumn("rerank_score", found / F.lit(max(len(words), 1)))

    return score


def judged_text(chunks: DataFrame) -> Column:
    """What a re-ranker judges: the heading, a line feed, the text; just the text where there is no heading."""
    if "heading" not in chunks.columns:
        return F.col("text")
    heading = F.coalesce(F.col("heading"), F.lit(""))
    return F.when(heading == "", F.col("text")).otherwise(F.concat_ws("\n", heading, "text"))


def rerank(
    fused: DataFrame, chunks: DataFrame, scorer: Callable[[DataFrame], DataFrame], limit: int, k: int = RRF_K, pool_size: int = RERANK_POOL, weights: dict[str, float] = RERANK_WEIGHTS
) -> DataFrame:
    """Fuse the retrieval order of the first max(``pool_size``, limit) hits with a scorer's order; the fused score replaces the old one."""
    pool = fused.where(F.col("place") < max(pool_size, limit)).join(chunks.select("chunk_id", judged_text(chunks).alias("text")), "chunk_id")
    scored = scorer(pool)
    order = Window.orderBy(F.col("rerank_score").desc(), "place")
    again = scored.withColumn("rank", F.row_number().over(order) - 1)
    return fuse({"retrieval": scored.select("chunk_id", F.col("place").alias("rank")), "rerank": again.select("chunk_id", "rank")}, weights, k)


def search(
    chunks: DataFrame,
    vectors: DataFrame | None,
    query: str,
    sources: Sequence[str] | None = None,
    limit: int | None = None,
    query_vector: Sequence[float] | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    candidates: int = CANDIDATES,
    heading: bool = False,
    stored: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    weights: dict[str, float] = WEIGHTS,
    k: int = RRF_K,
    pool_size: int = RERANK_POOL,
    rerank_weights: dict[str, float] = RERANK_WEIGHTS,
) -> DataFrame:
    """Ranked hits of one query: rank, chunk_id, source, path, text, score.

    ``chunks``: source, chunk_id, path, text[, heading]; ``vectors``: source, chunk_id, embedding.  No limit or 0 means 8,
    no sources means all.  A query without a searchable token finds nothing (and no leg runs).  Identifier phrases
    add their own leg, and switch a scorer off: exact names beat judged similarity.  With ``stored`` (postings, term statistics,
    corpus statistics) the lexical and the phrase leg read those and tokenise nothing.
    """
    limit = limit or DEFAULT_LIMIT
    words, phrases = query_tokens(query), query_phrases(query)
    shape = [F.col("rank"), F.col("chunk_id"), F.col("source"), F.col("path"), F.col("text"), F.col("score")]
    if not words and not phrases:
        return chunks.limit(0).select(F.lit(0).cast("long").alias("rank"), "chunk_id", "source", "path", "text", F.lit(0.0).alias("score"))
    legs: dict[str, DataFrame] = {}
    if phrases:
        legs["phrase"] = indexed_phrase_leg(stored[0], stored[2], phrases, sources, candidates) if stored else phrase_leg(chunks, phrases, sources, candidates, heading)
    if words:
        legs["lexical"] = indexed_leg(*stored, words, sources, candidates) if stored else lexical_leg(chunks, words, sources, candidates, heading)
    if vectors is not None and query_vector is not None:
        legs["dense"] = dense_leg(vectors, query_vector, sources, candidates)
    fused = fuse(legs, weights, k)
    if scorer is not None and not phrases:
        fused = rerank(fused, chunks, scorer, limit, k, pool_size, rerank_weights)
    top = F.broadcast(fused.where(F.col("place") < limit))  # at most ``limit`` rows: hydrate late
    hits = chunks.select("chunk_id", "source", "path", "text").join(top, "chunk_id")
    return hits.withColumn("score", F.round("score", SCORE_DIGITS)).withColumn("rank", F.col("place")).select(*shape)
