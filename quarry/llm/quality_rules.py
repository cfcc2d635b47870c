"""Quality rules with host verdicts: rule failures aggregated by host and shrunk by an empirical beta prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.common import attach, prepare, stage

#: Fixed values of the document rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PERCENT = 100
#: A host whose shrunk failure rate of any rule is above this is rejected with all its documents.
HOST_LIMIT = 0.75
RULES = ("short", "repeat", "symbol")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_metrics(column: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text (null counts as no words)."""
    words = W.scan(column)
    buf, offsets, n = words.buf, words.offsets, len(words.counts)
    total = int(offsets[-1])
    body = buf[:total]
    chars = W.per_text(((body & 0xC0) != 0x80) & ~W._SPACE[body], offsets)
    symbols = W.per_text(_SYMBOL[body], offsets)

    # lines: between line feeds and text ends
    is_break = body == 0x0A
    inner = np.flatnonzero(is_break)
    starts = np.sort(np.concatenate([offsets[:-1], inner + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], inner]), kind="stable")
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, inner, side="right") - 1])
    doc.sort(kind="stable")
    some = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, doc = starts[some], ends[some], doc[some]
    lines = W.hash_spans(buf, starts, ends)
    order = np.lexsort((lines, doc))
    lines, line_doc = lines[order], doc[order]
    again = (lines[1:] == lines[:-1]) & (line_doc[1:] == line_doc[:-1])
    dups = np.bincount(line_doc[1:][again], minlength=n)

    # words in 3-word windows that occur at least twice in the text
    grams, doc, pos = W.windows(words, words.hashes(), 3)
    repeated = np.zeros(len(words.starts) + 3, bool)
    if len(grams):
        order = np.lexsort((grams, doc))
        same = (grams[order][1:] == grams[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(grams), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = words.first[:-1][doc[twice]] + pos[twice]
        for k in range(3):
            repeated[at + k] = True
    marked = np.concatenate([[0], np.cumsum(repeated[: len(words.starts)])])
    repeats = marked[words.first[1:]] - marked[words.first[:-1]]
    return {"n_words": words.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeats}


def document_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus the five counts (long).  Extra columns pass through; columns called like a count are replaced."""
    prepare(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col and c not in METRICS]
    schema = docs.select(*others).schema
    for name in METRICS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, batch.schema.names[-1]):
                found = text_metrics(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), *(pa.array(found[m].astype(np.int64)) for m in METRICS)], names=schema.names)

    return docs.select(*others, F.col(text_col)).mapInArrow(run, schema)


def with_rules(metrics: DataFrame) -> DataFrame:
    """The document rules: fail_short, fail_repeat (the base rules) and fail_symbol, which only counts for hosts."""
    return metrics.withColumns(
        {
            "fail_short": F.col("n_words") < MIN_WORDS,
            "fail_repeat": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
            "fail_symbol": 100 * F.col("n_symbols") > MAX_SYMBOLS_PERCENT * F.col("n_words"),
        }
    ).withColumn("base_failed", F.col("fail_short") | F.col("fail_repeat"))


def host_verdicts(ruled: DataFrame, host_col: str, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_rows, shrunk failure rate of each rule, rejected.

    For each rule the hosts' rates are taken as draws from one beta distribution whose mean m and concentration k
    come from the corpus by the method of moments (between-host variance = observed variance - binomial variance);
    the shrunk rate of a host with f failures in n documents is (f + m k) / (n + k).
    """
    hosts = ruled.groupBy(F.col(host_col).alias("_host")).agg(F.count("*").alias("n_rows"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"f_{r}") for r in RULES])
    hosts = stage(hosts, "hosts")
    totals = hosts.agg(F.sum("n_rows").alias("n"), F.count("*").alias("h"), *[F.sum(f"f_{r}").alias(r) for r in RULES]).first()
    n, h = totals["n"] or 0, totals["h"] or 0
    means = {r: (totals[r] or 0) / n if n else 0.0 for r in RULES}
    spread = hosts.agg(*[F.sum(F.col("n_rows") * F.pow(F.col(f"f_{r}") / F.col("n_rows") - F.lit(means[r]), F.lit(2.0))).alias(r) for r in RULES]).first()
    out, bad = hosts, F.lit(False)
    for r in RULES:
        m = means[r]
        within = m * (1 - m)
        between = (spread[r] or 0.0) / n - within * h / n if n else 0.0
        k = min(max(within / between - 1, 1.0), 1e6) if between > 0 else 1e6
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + F.lit(m * k)) / (F.col("n_rows") + F.lit(k)))
        bad = bad | (F.col(f"rate_{r}") > F.lit(limit))
    return out.withColumn("rejected", bad).select("_host", "n_rows", *[f"rate_{r}" for r in RULES], "rejected")


def quality_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """``docs`` without the text, plus the counts, the rules' failures, host_rejected and kept.

    kept is false for documents that fail a base rule (fewer than 50 words, or more than half of the words in repeated
    3-word windows) and for all documents of a rejected host.  Null and empty texts have no words and fail;
    a null host is a host of its own; repeated rows count once each; the limits are strict, so ties stay;
    an empty table gives an empty table.  Extra columns pass through, those called like an output are replaced.
    """
    ruled = stage(with_rules(document_metrics(docs, text_col)), "rules")
    verdicts = host_verdicts(ruled, host_col, limit)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    found = verdicts.select(key("_host").alias("_key"), F.col("rejected").alias("host_rejected"), "n_rows")
    out = attach(ruled.drop("host_rejected", "kept").withColumn("_key", key(host_col)), found, ["_key"], "n_rows").drop("_key")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op6_quality_rules(docs: DataFrame) -> DataFrame:
    return quality_rules(docs.select("doc_id", "source", "text")).select("doc_id", *METRICS, "base_failed", "kept")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, t.source, len(t.w) AS n_words, coalesce(list_sum(list_transform(t.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t.text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
      FROM t LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
d AS (SELECT *, n_words < 50 AS s, 100 * n_repeat_words > 50 * n_words AS q, 100 * n_symbols > 100 * n_words AS y FROM m),
h AS (SELECT source, count(*) AS n, sum(s::INT) AS fs, sum(q::INT) AS fq, sum(y::INT) AS fy FROM d GROUP BY source),
u AS (SELECT source, n, unnest([fs, fq, fy]) AS f, unnest([1, 2, 3]) AS rule FROM h),
e AS (SELECT rule, sum(f) / sum(n) AS mean, sum(n) AS n, count(*) AS h FROM u GROUP BY rule),
v AS (SELECT u.rule, any_value(mean) AS mean, any_value(mean * (1 - mean)) AS within, sum(u.n * (u.f / u.n - mean) ** 2) / any_value(e.n) - any_value(mean * (1 - mean) * e.h / e.n) AS between_
      FROM u JOIN e USING (rule) GROUP BY u.rule),
k AS (SELECT rule, mean, CASE WHEN between_ > 0 THEN least(greatest(within / between_ - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM v),
z AS (SELECT u.source, bool_or((u.f + mean * k) / (u.n + k) > 0.75) AS rejected FROM u JOIN k USING (rule) GROUP BY u.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (s OR q) AS base_failed, NOT (s OR q) AND NOT rejected AS kept
FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source
"""
