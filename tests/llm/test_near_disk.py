"""What near-duplicate detection puts on disk: no text is shuffled that meets no other, no shuffle file outlives its query."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.llm import common, minmax_dedup


def _shuffled(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def _files(spark) -> set[str]:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}


@pytest.fixture
def large(spark):
    """As with tables too large to be broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_texts_that_meet_no_other_are_not_shuffled(spark, large):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.randrange(1 << 40):x}" for _ in range(3000))) for i in range(200)]
    rows += [(1000 + i, t + " end") for i, t in rows[:4]]
    docs = common.stage(spark.createDataFrame(rows, "doc_id long, text string"), "test-docs")
    before = _shuffled(spark)
    got = {r["doc_id"]: r["component_id"] for r in minmax_dedup.near_components(docs, 2).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert _shuffled(spark) - before < sum(len(t) for _, t in rows) / 4


def test_stage_leaves_no_shuffle_files(spark):
    before, was = _files(spark), spark.conf.get(common._CLEANUP)
    common.stage(spark.range(1000).groupBy(F.col("id") % 7).count(), "test-count")
    for _ in range(50):  # they are deleted in the background
        if not (left := _files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common._CLEANUP) == was


def test_sieve_loses_no_key(spark, monkeypatch):
    small = common.stage(spark.createDataFrame([(i * 7919 - 500_000,) for i in range(500)] + [(None,)], "key long"), "test-keys")
    big = spark.range(-500_000, 3_500_000, 13).select(F.col("id").alias("key"), F.lit("x").alias("_bits")).unionByName(small.withColumn("_bits", F.lit("y")))
    for most in (common.SIEVE_MOST, 1 << 15):
        monkeypatch.setattr(common, "SIEVE_MOST", most)
        got = common.sieve(big, small, "key")
        assert got.columns == big.columns
        assert got.where("_bits = 'y'").count() == 500
        assert got.where("_bits = 'x'").count() < 0.1 * big.count()
        assert sorted(map(tuple, got.join(small, "key").collect())) == sorted(map(tuple, big.join(small, "key").collect()))
    assert common.sieve(big, common.stage(small.limit(0), "test-keys"), "key").count() == 0
