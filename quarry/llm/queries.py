"""The training-data operators as registered queries: each reads its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, exact_dedup, html_extract, minmax_dedup, mixing, quality_classifier, quality_rules, substring_dedup, token_files, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_entropy_mix": lambda s, d: mixing.op1_entropy_mix(_documents(s, d)),
        "op2_bitplane_tokens": lambda s, d: token_files.op2_bitplane_tokens(_documents(s, d), public_tokenizers.path("byte_bpe_50k.json")),
        "op3_minmax_neardup": lambda s, d: minmax_dedup.op3_minmax_neardup(_documents(s, d)),
        "op4_byte_bpe": lambda s, d: bpe.op4_byte_bpe(_documents(s, d), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "op5_toxicity": lambda s, d: toxicity.op5_toxicity(_documents(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op6_quality_rules": lambda s, d: quality_rules.op6_quality_rules(_documents(s, d)),
        "op7_quality_classifier": lambda s, d: quality_classifier.op7_quality_classifier(_documents(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op8_exact_dedup": lambda s, d: exact_dedup.op8_exact_dedup(_documents(s, d)),
        "op9_substring_dedup": lambda s, d: substring_dedup.op9_substring_dedup(_documents(s, d)),
        "op10_html_extract": lambda s, d: html_extract.op10_html_extract(_pages(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality_rules.ORACLE_SQL, "op8_exact_dedup": exact_dedup.ORACLE_SQL, "op9_substring_dedup": substring_dedup.ORACLE_SQL}
