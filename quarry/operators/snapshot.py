"""Versioned index snapshots in a shared folder: readers follow a pointer, writers add a version and then move it."""

from __future__ import annotations

import fcntl
import json
import os
import shutil
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import sync

POINTER = "_CURRENT"
SCHEMA_VERSION = 2

#: Columns of the stored tables.  ``postings`` is sorted by term within its files.
TABLES = {
    "sources": "name string, type string, origin string, ref string, directory string, description string, config_hash string, acquisition_hash string, revision string, "
    "sync_status string, index_status string, error string, skipped long, last_attempt_at timestamp, last_success_at timestamp",
    "files": "source string, path string, file_id long, sha256 string, title string, bytes long, indexed_at timestamp, origin_path string, origin_media_type string, section_id string, "
    "page_start int, page_end int, page_labels array<string>, extraction_methods array<string>, warnings array<string>, fingerprint string",
    "chunks": "source string, path string, file_id long, chunk_id long, ord int, heading_path string, text string, page_start int, page_end int, "
    "provenance array<struct<page:int,label:string>>, content_kinds array<string>",
    "postings": "source string, path string, chunk_id long, dl long, term string, tf_text long, tf_heading long, pos_text array<int>, pos_heading array<int>",
    "lengths": "source string, path string, chunk_id long, dl long",
    "vectors": "source string, path string, chunk_id long, embedding array<float>",
    "term_stats": "term string, df long",
    "corpus_stats": "n long, total_dl long, avgdl double",
}
BY_SOURCE = ("files", "chunks", "postings", "lengths", "vectors")


class PublishError(RuntimeError):
    """The index can't be used or published as it is."""


@dataclass(frozen=True)
class Index:
    version: int  # 0: nothing published yet
    meta: dict[str, Any]
    tables: dict[str, DataFrame]

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]


@contextmanager
def locked(state: Path) -> Iterator[None]:
    """One writer at a time; a second one gets an error at once."""
    folder = state / "locks"
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / "sync.lock", "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise PublishError("another run holds the lock") from e
        yield


def current_version(root: Path) -> int:
    try:
        return int((root / POINTER).read_text())
    except FileNotFoundError:
        return 0


def _folder(root: Path, version: int) -> Path:
    return root / f"v={version:06d}"


def open_index(spark: SparkSession, root: Path) -> Index:
    """The published index, or one of empty tables where none is.  The pointer is resolved once, so that all tables of an
    opened index belong together; an index of another schema version is refused."""
    version = current_version(root)
    if version == 0:
        return Index(0, {}, {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})
    folder = _folder(root, version)
    meta = json.loads((folder / "_meta.json").read_text(encoding="utf-8"))
    if meta.get("schema_version") != SCHEMA_VERSION:
        raise PublishError(f"index has schema version {meta.get('schema_version')}, not {SCHEMA_VERSION}: rebuild it")
    return Index(version, meta, {name: spark.read.schema(schema).parquet(str(folder / name)) for name, schema in TABLES.items()})


def _columns(spark: SparkSession, name: str) -> list[str]:
    return spark.createDataFrame([], TABLES[name]).columns


def validate(tables: dict[str, DataFrame]) -> list[str]:
    """What is wrong with a set of tables, empty if nothing."""
    found = sync.problems(tables["chunks"], tables["postings"], tables["vectors"])
    if not tables["files"].groupBy("source", "path").count().where("count > 1").isEmpty():
        found.append("duplicate files")
    if not tables["chunks"].join(tables["files"].select("file_id"), "file_id", "left_anti").isEmpty():
        found.append("chunks without a file")
    if not tables["files"].join(tables["sources"].selectExpr("name AS source"), "source", "left_anti").isEmpty():
        found.append("files without a source")
    return found


def _write(rows: DataFrame, name: str, folder: Path) -> None:
    if name == "postings":
        rows = rows.repartitionByRange("source", "term", "chunk_id").sortWithinPartitions("source", "term", "chunk_id")  # a frequent term spans ranges
    elif name == "chunks":
        rows = rows.sortWithinPartitions("source", "file_id", "ord")
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("source") if name in BY_SOURCE else writer).parquet(str(folder / name))


def publish(spark: SparkSession, root: Path, tables: dict[str, DataFrame], meta: dict[str, Any]) -> Index:
    """Write the next version, check it as written, move the pointer; the version before it is kept for open readers.

    ``tables`` has sources and the tables by source; the statistics are computed from what was written.

    Tables by source are partitioned by it, so that a search scoped to some sources reads only theirs.  A version that fails its
    checks is deleted and the pointer stays.
    """
    root.mkdir(parents=True, exist_ok=True)
    before = current_version(root)
    folder = _folder(root, before + 1)
    shutil.rmtree(folder, ignore_errors=True)  # left by a run that died
    try:
        for name in ("sources", *BY_SOURCE):
            _write(tables[name].select(*_columns(spark, name)), name, folder)
        stored = {name: spark.read.schema(TABLES[name]).parquet(str(folder / name)) for name in ("postings", "lengths")}
        _write(stored["postings"].groupBy("term").agg(F.count("*").alias("df")).sort("term"), "term_stats", folder)
        _write(stored["lengths"].agg(F.count("*").alias("n"), F.sum("dl").alias("total_dl"), F.avg("dl").alias("avgdl")), "corpus_stats", folder)
        written = {name: spark.read.schema(schema).parquet(str(folder / name)) for name, schema in TABLES.items()}
        if faults := validate(written):
            raise PublishError("; ".join(faults))
        (folder / "_meta.json").write_text(json.dumps({**meta, "schema_version": SCHEMA_VERSION}, sort_keys=True), encoding="utf-8")
        pointer = root / f"{POINTER}.next"
        pointer.write_text(str(before + 1))
        os.replace(pointer, root / POINTER)
    except BaseException:
        shutil.rmtree(folder, ignore_errors=True)
        raise
    for old in root.glob("v=*"):
        if int(old.name[2:]) < before:
            shutil.rmtree(old, ignore_errors=True)
    return Index(before + 1, meta, written)
