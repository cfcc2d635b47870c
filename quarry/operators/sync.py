"""Desired against indexed state: file differences, source plans, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_diff(indexed: DataFrame, listed: DataFrame, force: bool = False) -> DataFrame:
    """source, path, action of the full outer join of (source, path, sha256) listings.

    added, changed, removed or unchanged; with ``force`` a file that is on both sides always counts as changed.
    """
    old = indexed.select("source", "path", F.col("sha256").alias("old_sha"), F.lit(True).alias("was"))
    new = listed.select("source", "path", F.col("sha256").alias("new_sha"), F.lit(True).alias("now"))
    same = F.col("old_sha").eqNullSafe(F.col("new_sha")) & F.lit(not force)
    action = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return old.join(new, ["source", "path"], "full_outer").select("source", "path", action.alias("action"))


def counters(diff: DataFrame) -> DataFrame:
    """One row of counts by action."""
    return diff.agg(*[F.coalesce(F.sum((F.col("action") == a).cast("long")), F.lit(0)).cast("long").alias(a) for a in ("added", "changed", "removed", "unchanged")])


def source_plan(desired: DataFrame, indexed: DataFrame) -> DataFrame:
    """name, action from desired (name, config_hash, acquisition_hash) and indexed (the same, plus sync_status, legacy).

    add: not indexed; migrate: indexed before configurations were recorded; retry: the last attempt did not succeed;
    update: the way to acquire it changed; metadata: only other settings changed; unchanged; remove: no longer wanted.
    """
    d = desired.select("name", F.col("config_hash").alias("d_config"), F.col("acquisition_hash").alias("d_acquire"), F.lit(True).alias("wanted"))
    i = indexed.select("name", F.col("config_hash").alias("i_config"), F.col("acquisition_hash").alias("i_acquire"), "sync_status", "legacy", F.lit(True).alias("present"))
    action: Column = (
        F.when(F.col("wanted").isNull(), "remove")
        .when(F.col("present").isNull(), "add")
        .when(F.col("legacy"), "migrate")
        .when(F.coalesce(F.col("sync_status") != "ready", F.lit(True)), "retry")
        .when(~F.col("d_acquire").eqNullSafe(F.col("i_acquire")), "update")
        .when(~F.col("d_config").eqNullSafe(F.col("i_config")), "metadata")
        .otherwise("unchanged")
    )
    return d.join(i, "name", "full_outer").select("name", action.alias("action"))


def stale(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Keys that exist and are no longer wanted."""
    return existing.select(key).distinct().join(wanted.select(key), key, "left_anti")


def orphans(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Index rows whose chunk is gone."""
    return rows.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def reconcile(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """Sources whose numbers of chunks and of index rows differ: source, chunks, indexed."""
    a = chunks.groupBy("source").agg(F.count("*").alias("chunks"))
    b = indexed.groupBy("source").agg(F.count("*").alias("indexed"))
    both = a.join(b, "source", "full_outer").select("source", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.coalesce("indexed", F.lit(0)).cast("long").alias("indexed"))
    return both.where(F.col("chunks") != F.col("indexed"))


def problems(chunks: DataFrame, postings: DataFrame, vectors: DataFrame) -> list[str]:
    """What is wrong with an index, empty if nothing: duplicate ids, orphaned rows, counts that don't match."""
    found = []
    if not chunks.groupBy("chunk_id").count().where("count > 1").isEmpty():
        found.append("duplicate chunk ids")
    for name, rows in (("postings", postings), ("vectors", vectors)):
        if not orphans(rows, chunks).isEmpty():
            found.append(f"{name} without a chunk")
    if not reconcile(chunks, vectors).isEmpty():
        found.append("vectors and chunks differ in number")
    return found


def publish_set(kept: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    """The next snapshot's rows: those of untouched files, plus all rows of added and changed ones."""
    gone = diff.where(F.col("action").isin("changed", "removed")).select("source", "path")
    return kept.join(gone, ["source", "path"], "left_anti").unionByName(fresh, allowMissingColumns=True)
