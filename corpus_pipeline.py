"""Corpus preparation end to end: classify, dedupe, mix and encode the documents.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents.

In every stage null texts count as empty ones, extra columns pass through (whatever they are called) as far as the
encoder, and an empty table gives an empty table.  Rows that repeat an id: the classifier judges each alone, the two
dedup stages say in their functions which one stays, the mix takes each, the encoder encodes each.  A stage's working
tables are deleted before it returns; its decisions (ids, no texts) stay staged, as its result reads them when it is
written.  `run` deletes those too, once each stage's result has been.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, exact_dedup, minmax_dedup, mixing, quality_classifier
from quarry.llm.common import mark, release, stage

#: The stages' decisions aren't expressible in SQL (a fitted classifier, hashing with verification, a convex program).
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the rated ones among them, doesn't reject.

    Empty texts are judged like any other; a document at the limit stays.
    """
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model).where("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; of full repeats one row stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8), the smallest id.

    Texts without a word are near nothing and stay, as do rows with a null id.
    """
    return minmax_dedup.drop_near_copies(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the entropy-balanced mix takes it, up to three times or not at all.

    A null source is a source of its own; documents without a word cost nothing and are taken once.
    """
    return mixing.take(docs, mixing.entropy_mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row with their digest, and the digest of what they decode to; an empty text has no ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is staged in the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, f) in enumerate(STAGES):
        begin = mark()
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
            release(spark, begin, docs)
    return docs
