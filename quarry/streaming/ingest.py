"""Continuous addition of text files: a file stream whose micro-batches go through the hash difference.

A file stream sees new and rewritten files, never deletions: `operators.lifecycle.sync_index` remains the authority on those.
"""

from __future__ import annotations

import shutil
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quarry.config import Settings
from quarry.functions import text as T
from quarry.operators import lifecycle, materialize, providers, snapshot, sync

FILE = "path string, modificationTime timestamp, length long, content binary"


def _named(raw: DataFrame, folder: str, source: str) -> DataFrame:
    """The newest content of each file of a batch, by path below the folder."""
    inner = F.substring_index("path", folder.split(":", 1)[-1].rstrip("/") + "/", -1)
    files = raw.withColumn("path", inner).where(T.suffix(F.col("path")).isin(*T.TEXT_SUFFIXES))
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.col("modificationTime").desc(), F.sha2("content", 256)))
    files = files.withColumn("rn", newest).where("rn = 1")
    return files.select(F.lit(source).alias("source"), "path", F.col("length").alias("bytes"), "content", F.lit(None).cast("string").alias("error"))


def apply_batch(spark: SparkSession, settings: Settings, files: DataFrame, source: str) -> snapshot.Index:
    """Publish a version with the added and changed files of ``files``; bad files are left out.

    Replaying a batch changes nothing, since its files' digests are in the index by then.
    """
    now = datetime.now(timezone.utc).replace(microsecond=0)
    with snapshot.locked(settings.state):
        old = snapshot.open_index(spark, settings.index)
        work = settings.state / f"work-{uuid.uuid4().hex}"
        try:
            documents = lifecycle.identified(materialize.native_documents(files)).where("error IS NULL")
            diff = sync.file_diff(old["files"], documents).where(F.col("action").isin("added", "changed"))
            fresh = lifecycle.prepared(documents.join(diff.select("source", "path"), ["source", "path"], "left_semi"))
            fresh.write.parquet(str(work / "prepared"))
            staged = spark.read.parquet(str(work / "prepared"))
            if staged.isEmpty():
                return old
            embedder = providers.embedder(settings)
            tables = lifecycle.next_tables(old, lifecycle.index_rows(staged, now, embedder), staged.select("source", "path"))
            row = spark.createDataFrame([(source, "local", "stream", "ready", "ready", now, now)], "name string, type string, origin string, sync_status string, index_status string, last_attempt_at timestamp, last_success_at timestamp")
            tables["sources"] = old["sources"].where(F.col("name") != source).unionByName(row, allowMissingColumns=True)
            return snapshot.publish(spark, settings.index, tables, {"fingerprint": lifecycle.pipeline_fingerprint(settings), "dim": embedder.dim})
        finally:
            shutil.rmtree(work, ignore_errors=True)


def ingest(spark: SparkSession, settings: Settings, folder: str, source: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Start a query that takes everything new in ``folder`` into the index and then stops."""
    raw = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def take(batch: DataFrame, _: int) -> None:
        apply_batch(spark, settings, _named(batch, folder, source), source)

    return raw.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
