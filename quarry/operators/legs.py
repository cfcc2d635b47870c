"""The three retrieval legs.  Each returns (chunk_id, score, rank) with rank from 0, best first, ties by chunk_id.

Statistics (n, document frequency, average length) are always those of the whole corpus, also when a search is
scoped to some sources: scoping restricts what is ranked, never how it is scored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.tokens import tokens
from quarry.operators.index import tokenized

#: Fixed values of the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
TEXT_WEIGHT, HEADING_WEIGHT = 1.0, 0.6
CANDIDATES = 50
#: Terms of a table of queries that are broadcast at most (some 50 MB).
MOST_BROADCAST = 1 << 20


def _scoped(df: DataFrame, sources: Sequence[str] | None) -> DataFrame:
    return df.where(F.col("source").isin(*sources)) if sources else df


def _ranked(scored: DataFrame, k: int, descending: bool = True) -> DataFrame:
    """Top k (TakeOrderedAndProject), then ranks over those k rows."""
    order = [F.col("score").desc() if descending else F.col("score").asc(), F.col("chunk_id").asc()]
    return scored.orderBy(*order).limit(k).withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def _saturate(f: Column, dl: Column, avgdl: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def _idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def spaced(t: Column) -> Column:
    """Tokens as one string with a space on either side of each (tokens hold none)."""
    return F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))


def phrase_frequency(line: Column, words: Sequence[str]) -> Column:
    """Occurrences of adjacent ``words`` in a `spaced` token string, overlapping ones too."""
    return F.regexp_count(line, F.lit(f"(?= {' '.join(words)} )"))


def score_phrases(chunks: DataFrame, phrases: Sequence[Sequence[str]], sources: Sequence[str] | None = None, heading: bool = False) -> DataFrame:
    """(chunk_id, score): BM25 of the disjunction of ``phrases`` (single words are phrases of one).

    One scan: frequencies per phrase are computed from each chunk's token arrays, the statistics come from one
    aggregation row, and only matching chunks of the wanted sources are scored.  Phrases are summed in the given
    order, so that scores don't depend on the partitioning.
    """
    tok = tokenized(chunks, heading)
    tok = tok.select("source", "chunk_id", "dl", F.inline(F.array(F.struct(spaced(F.col("t")).alias("t"), spaced(F.col("h")).alias("h")))))
    weighed = [(TEXT_WEIGHT, "t"), (HEADING_WEIGHT, "h")] if heading else [(TEXT_WEIGHT, "t")]
    f = {i: reduce(lambda x, y: x + y, [w * phrase_frequency(F.col(c), p) for w, c in weighed]) for i, p in enumerate(phrases)}
    counted = tok.select("source", "chunk_id", "dl", F.inline(F.array(F.struct(*[c.cast("double").alias(f"f{i}") for i, c in f.items()]))))
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *_frequencies(len(f)))
    return _scored(counted, stats, len(f), sources)


def _frequencies(n: int) -> list[Column]:
    return [F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"df{i}") for i in range(n)]


def _scored(counted: DataFrame, stats: DataFrame, n: int, sources: Sequence[str] | None) -> DataFrame:
    """(chunk_id, score) of the wanted sources' rows with a match; ``stats`` is one row: n, avgdl, df0, df1, ..."""
    total = F.lit(0.0)
    for i in range(n):
        total = total + F.when(F.col(f"f{i}") > 0, _idf(F.col("n"), F.col(f"df{i}")) * _saturate(F.col(f"f{i}"), F.col("dl"), F.col("avgdl"))).otherwise(F.lit(0.0))
    any_match = F.lit(False)
    for i in range(n):
        any_match = any_match | (F.col(f"f{i}") > 0)
    matched = _scoped(counted, sources).where(any_match)
    one = F.broadcast(stats)  # a single row
    return matched.join(one, F.lit(True)).select("chunk_id", total.alias("score"))


def lexical_leg(chunks: DataFrame, words: Sequence[str], sources: Sequence[str] | None = None, k: int = CANDIDATES, heading: bool = False) -> DataFrame:
    return _ranked(score_phrases(chunks, [[w] for w in words], sources, heading), k)


def phrase_leg(chunks: DataFrame, phrases: Sequence[Sequence[str]], sources: Sequence[str] | None = None, k: int = CANDIDATES, heading: bool = False) -> DataFrame:
    return _ranked(score_phrases(chunks, phrases, sources, heading), k)


def indexed_leg(postings: DataFrame, terms: DataFrame, stats: DataFrame, words: Sequence[str], sources: Sequence[str] | None = None, k: int = CANDIDATES) -> DataFrame:
    """The lexical leg over stored postings: the term filter reaches the scan, statistics are looked up."""
    hits = _scoped(postings.where(F.col("term").isin(*words)), sources)
    df = F.broadcast(terms.where(F.col("term").isin(*words)))  # at most one row for each query word
    f = TEXT_WEIGHT * F.col("tf_text") + HEADING_WEIGHT * F.col("tf_heading")
    part = _idf(F.col("n"), F.col("df")) * _saturate(f, F.col("dl"), F.col("avgdl"))
    scored = hits.join(df, "term").join(F.broadcast(stats.select("n", "avgdl")), F.lit(True)).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("term", part.alias("part")))).alias("parts"))
    return _ranked(scored.select("chunk_id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("score")), k)


def indexed_phrase_leg(postings: DataFrame, stats: DataFrame, phrases: Sequence[Sequence[str]], sources: Sequence[str] | None = None, k: int = CANDIDATES) -> DataFrame:
    """The phrase leg over stored postings: adjacency is decided by the terms' places, no text is read.

    Only the phrases' terms reach the plan; chunks are put together from their rows (a handful each).
    """
    words = sorted({w for p in phrases for w in p})
    hits = postings.where(F.col("term").isin(*words)).groupBy("source", "chunk_id", "dl")
    places = F.map_from_entries(F.collect_list(F.struct("term", F.struct(F.col("pos_text").alias("t"), F.col("pos_heading").alias("h")))))
    chunks = hits.agg(places.alias("at"))
    none = F.array().cast("array<int>")

    def count(phrase: Sequence[str], part: str) -> Column:
        at = [F.coalesce(F.try_element_at("at", F.lit(w))[part], none) for w in phrase]
        follows = lambda p: reduce(lambda x, y: x & y, [F.array_contains(a, (p + i).cast("int")) for i, a in enumerate(at[1:], 1)], F.lit(True))
        return F.size(F.filter(at[0], follows))

    f = [(TEXT_WEIGHT * count(p, "t") + HEADING_WEIGHT * count(p, "h")).cast("double").alias(f"f{i}") for i, p in enumerate(phrases)]
    counted = chunks.select("source", "chunk_id", "dl", F.inline(F.array(F.struct(*f))))
    one = stats.select("n", "avgdl").crossJoin(F.broadcast(counted.agg(*_frequencies(len(f)))))  # a single row
    return _ranked(_scored(counted, one, len(f), sources), k)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two float arrays, summed in order in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def dense_leg(vectors: DataFrame, query: Sequence[float], sources: Sequence[str] | None = None, k: int = CANDIDATES, digits: int = 9) -> DataFrame:
    """Exact nearest neighbours: every vector of the wanted partitions is compared (score = distance, rounded)."""
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    scored = _scoped(vectors, sources).select("chunk_id", F.round(distance(F.col("embedding"), q), digits).alias("score"))
    return _ranked(scored, k, descending=False)


def batch_lexical(chunks: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The lexical leg for a whole table of queries (query_id, words array): (query_id, chunk_id, score, rank).

    Tokens that some query holds are dealt by chunk once; counting them, scoring and summing by query then happen where
    they are, and each task hands on its best k chunks of a query.  The queries' terms are broadcast while there are at
    most `MOST_BROADCAST` of them, and joined by shuffles beyond.
    """
    tok = tokenized(chunks)
    stats = tok.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = queries.select("query_id", F.explode("words").alias("term"))
    small = F.broadcast if wanted.count() <= MOST_BROADCAST else lambda df: df
    terms = small(wanted.select("term").distinct())
    df = tok.select(F.explode(F.array_distinct("t")).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    held = tok.select("chunk_id", "dl", F.explode("t").alias("term")).join(terms, "term", "left_semi").repartition("chunk_id")
    posted = held.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    weighed = wanted.join(df, "term").join(F.broadcast(stats), F.lit(True)).select("query_id", "term", "avgdl", _idf(F.col("n"), F.col("df")).alias("idf"))
    part = F.col("idf") * _saturate(F.col("tf").cast("double"), F.col("dl"), F.col("avgdl"))
    scored = posted.join(small(weighed), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    best = scored.withColumn("place", place).where(F.col("place") <= k)  # compared as it is, so that tasks cut before the shuffle
    return best.select("query_id", "chunk_id", "score", (F.col("place") - 1).cast("long").alias("rank"))


__all__ = ["batch_lexical", "dense_leg", "distance", "indexed_leg", "indexed_phrase_leg", "lexical_leg", "phrase_leg", "score_phrases", "tokens"]
