"""Index tables of a chunk table (source, chunk_id, text[, heading]): postings and corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.tokens import tokens
from quarry.shipping import ship


def tokenized(chunks: DataFrame, heading: bool = False) -> DataFrame:
    """source, chunk_id, text tokens, heading tokens and dl (tokens of both plus one for the source).

    The tokens come out of a generator, which the optimiser doesn't repeat: however often later expressions use them, a
    chunk is tokenised once a scan.
    """
    head = tokens(F.col("heading")) if heading else F.array().cast("array<string>")
    cut = chunks.select("source", "chunk_id", F.inline(F.array(F.struct(tokens(F.col("text")).alias("t"), head.alias("h")))))
    return cut.withColumn("dl", (F.size("t") + F.size("h") + 1).cast("long"))


def _positions(text: pa.Array, heading: pa.Array) -> pa.Array:
    """For each chunk its different terms with their places among the tokens of the text and of the heading."""
    rows = []
    for parts in zip(text.to_pylist(), heading.to_pylist(), strict=True):
        found: dict[str, tuple[list[int], list[int]]] = {}
        for k, words in enumerate(parts):
            for i, word in enumerate(words):
                found.setdefault(word, ([], []))[k].append(i)
        rows.append([{"term": t, "pos_text": a, "pos_heading": b} for t, (a, b) in found.items()])
    return pa.array(rows, pa.list_(pa.struct([("term", pa.string()), ("pos_text", pa.list_(pa.int32())), ("pos_heading", pa.list_(pa.int32()))])))


def postings(chunks: DataFrame, heading: bool = False) -> DataFrame:
    """source, chunk_id, term, tf_text, tf_heading, pos_text, pos_heading, dl: one row for each different term of a chunk.

    A chunk's terms are counted within its row, so nothing is shuffled.  Sorted by term within files when written, so that
    a query's ``term IN (...)`` prunes row groups.
    """
    ship(chunks.sparkSession)
    counted = F.arrow_udf(_positions, "array<struct<term:string,pos_text:array<int>,pos_heading:array<int>>>")("t", "h")
    terms = tokenized(chunks, heading).select("source", "chunk_id", "dl", F.inline(counted))
    return terms.withColumns({"tf_text": F.size("pos_text").cast("long"), "tf_heading": F.size("pos_heading").cast("long")})


def term_stats(posted: DataFrame) -> DataFrame:
    """term, df over all sources."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def dealt(chunks: DataFrame) -> DataFrame:
    """The chunks as they lie or, in fewer files than there are cores, dealt by chunk: one task reads a file of one row group.

    Dealt by a hash of the id, so that a later exchange by the id itself isn't dropped as a repetition.
    """
    files = len(chunks.inputFiles())
    return chunks.repartition(F.xxhash64("chunk_id")) if 0 < files < chunks.sparkSession.sparkContext.defaultParallelism else chunks


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """`term_stats` of the texts straight from their tokens, where no postings are stored: no places are gathered, no Python runs."""
    tok = tokenized(dealt(chunks.select("source", "chunk_id", "text")))
    return term_stats(tok.select(F.explode(F.array_distinct("t")).alias("term")))


def corpus_stats(chunks: DataFrame, heading: bool = False) -> DataFrame:
    """One row: n, total_dl, avgdl over all sources."""
    return tokenized(chunks, heading).agg(F.count("*").alias("n"), F.sum("dl").alias("total_dl"), F.avg("dl").alias("avgdl"))


def query_index(chunks: DataFrame, words: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`postings` (without places), `term_stats` and `corpus_stats` of the texts for a query's words, where no index is stored.

    Every chunk is tokenised, but only the words' postings are made, within its row and without Python.  A chunk goes on as one
    array, dl and the words' frequencies: it can't be pruned differently for the three tables, so they share one exchange
    and with it one scan.
    """
    words = list(dict.fromkeys(words))
    tok = tokenized(dealt(chunks.select("source", "chunk_id", "text")))
    held = tok.select("source", "chunk_id", F.inline(F.array(F.struct("dl", F.filter("t", lambda x: x.isin(*words)).alias("t")))))
    times = lambda w: F.size(F.filter("t", lambda x: x == w)).cast("long")
    counts = F.array("dl", *map(times, words))
    by_chunk = held.select("source", "chunk_id", counts.alias("counts")).repartition("chunk_id")
    row = "array<struct<term:string,tf_text:long,tf_heading:long>>"
    found = F.array(*[F.struct(F.lit(w), F.col("counts")[i], F.lit(0)) for i, w in enumerate(words, 1)]).cast(row)
    dl = F.col("counts")[0]
    posted = by_chunk.select("source", "chunk_id", dl.alias("dl"), F.inline(F.filter(found, lambda r: r["tf_text"] > 0)))
    return posted, term_stats(posted), by_chunk.agg(F.count("*").alias("n"), F.sum(dl).alias("total_dl"), F.avg(dl).alias("avgdl"))
