"""Synchronisation of the index with the registry: plan, acquire, prepare what changed, publish once."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import structure
from quarry.functions import text as T
from quarry.functions.topics import paged_passages
from quarry.operators import index as build
from quarry.operators import materialize, providers, snapshot, sync
from quarry.shipping import ship
from quarry.sources import acquire, registry

PIPELINE_VERSION = 1
ERROR_CHARS = 500
ACTIONS = ("added", "changed", "removed", "unchanged")


@dataclass
class SourceResult:
    name: str
    action: str
    status: str  # planned, ready or failed
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(ACTIONS, 0))
    skipped: int = 0
    error: str | None = None


@dataclass
class SyncResult:
    sources: list[SourceResult]
    version: int
    dry_run: bool = False

    @property
    def exit_code(self) -> int:
        return int(any(s.status == "failed" for s in self.sources))


def pipeline_fingerprint(settings: Settings) -> str:
    """Changes whenever the same files might give other rows, which makes a rebuild necessary."""
    parts = [PIPELINE_VERSION, snapshot.SCHEMA_VERSION, settings.embedder or "hashing", settings.embedding_dim, structure.TARGET, structure.MOST, structure.LEAST, structure.STUB, *T.TEXT_SUFFIXES, *T.RICH_SUFFIXES]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def redact(error: BaseException, origin: str) -> str:
    """The last line of an error without the source's origin and without credentials in URLs, at most 500 characters."""
    lines = [x for x in str(error).splitlines() if x.strip()]
    last = lines[-1] if lines else type(error).__name__
    return re.sub(r"://[^/\s@]+@", "://", last.replace(origin, "<origin>"))[:ERROR_CHARS]


_PASSAGE = "struct<ord:int,heading_path:string,text:string,page_start:int,page_end:int,provenance:array<struct<page:int,label:string>>>"


def _split(text: pa.Array, suffix: pa.Array, materialized: pa.Array, first_page: pa.Array) -> pa.Array:
    mark = pa.struct([("page", pa.int32()), ("label", pa.string())])
    passage = pa.struct([("ord", pa.int32()), ("heading_path", pa.string()), ("text", pa.string()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("provenance", pa.list_(mark))])
    rows = []
    for body, end, made, page in zip(text.to_pylist(), suffix.to_pylist(), materialized.to_pylist(), first_page.to_pylist(), strict=True):
        if made:
            title, paged = paged_passages(body or "", page)
            found = [{"ord": p.ord, "heading_path": p.heading_path, "text": p.text, "page_start": p.page_start, "page_end": p.page_end, "provenance": [{"page": n, "label": x} for n, x in p.provenance]} for p in paged]
        else:
            title, plain = structure.split_document(body or "", end or "")
            found = [{"ord": p.ord, "heading_path": p.heading_path, "text": p.text, "page_start": None, "page_end": None, "provenance": []} for p in plain]
        rows.append({"title": title, "passages": found})
    return pa.array(rows, pa.struct([("title", pa.string()), ("passages", pa.list_(passage))]))


def identified(documents: DataFrame) -> DataFrame:
    """Documents with text, error and sha256, the digest of the raw bytes and of all metadata that can be searched."""
    searchable = F.to_json(F.struct("origin_path", "origin_media_type", "section_id", "page_start", "page_end", "page_labels", "extraction_methods", "content_kinds", "heading_path", "fingerprint"))
    return acquire.decoded(documents).withColumn("sha256", F.sha2(F.concat("content", F.encode(searchable, "UTF-8")), 256))


def prepared(documents: DataFrame) -> DataFrame:
    """Identified documents split into passages; a manifest's heading path replaces the headings found in the text."""
    ship(documents.sparkSession)
    cut = documents.withColumn("cut", F.arrow_udf(_split, f"struct<title:string,passages:array<{_PASSAGE}>>")("text", T.suffix(F.col("path")), "materialized", "page_start"))
    named = F.transform("cut.passages", lambda p: F.when(F.col("materialized") & (F.coalesce("heading_path", F.lit("")) != ""), p.withField("heading_path", F.col("heading_path"))).otherwise(p))
    return cut.withColumn("title", F.col("cut.title")).withColumn("passages", named).withColumn("file_id", F.xxhash64("source", "path")).drop("cut", "content", "text")


def index_rows(documents: DataFrame, now: datetime, embedder: providers.Embedder) -> dict[str, DataFrame]:
    """All tables' rows of prepared documents."""
    ship(documents.sparkSession)
    files = documents.withColumn("indexed_at", F.lit(now))
    exploded = documents.select("source", "path", "file_id", F.explode("passages").alias("p"), F.coalesce("content_kinds", F.array().cast("array<string>")).alias("content_kinds"))
    chunks = exploded.select("source", "path", "file_id", F.xxhash64("source", "path", "p.ord").alias("chunk_id"), "p.*", "content_kinds")
    # the key travels as the source, so that the index builder's rows can be taken away by file later
    keyed = chunks.select(F.struct("source", "path").alias("source"), "chunk_id", "text", F.col("heading_path").alias("heading"))
    unkeyed = ["source.source", "source.path"]
    posted = build.postings(keyed, heading=True)
    lengths = build.tokenized(keyed, heading=True)
    passage = T.embedding_text(F.col("source"), F.col("heading_path"), F.col("text"))
    return {
        "files": files,
        "chunks": chunks,
        "postings": posted.select(*unkeyed, "chunk_id", "dl", "term", "tf_text", "tf_heading", "pos_text", "pos_heading"),
        "lengths": lengths.select(*unkeyed, "chunk_id", "dl"),
        "vectors": chunks.select("source", "path", "chunk_id", embedder.passages(passage).alias("embedding")),
    }


def next_tables(old: snapshot.Index, fresh: dict[str, DataFrame] | None, gone: DataFrame | None) -> dict[str, DataFrame]:
    """Every table's rows after ``gone`` (source, path) files are taken out and ``fresh`` rows put in."""
    out = {}
    for name in snapshot.BY_SOURCE:
        rows = old[name]
        if gone is not None:
            rows = rows.join(gone, ["source", "path"], "left_anti")
        out[name] = rows if fresh is None else rows.unionByName(fresh[name].select(*rows.columns))
    return out


def _union(frames: Iterable[DataFrame]) -> DataFrame | None:
    frames = list(frames)
    return reduce(DataFrame.unionByName, frames) if frames else None


def _source_row(s: registry.Source, before: dict[str, Any], result: SourceResult, revision: str | None, now: datetime, indexed: bool) -> dict[str, Any]:
    """A source's row after an attempt; what a failed one didn't learn stays as it was."""
    ok = result.status == "ready"
    row = {"name": s.name, "type": s.type, "origin": s.origin, "ref": s.ref, "directory": s.directory, "description": s.description, "sync_status": result.status, "error": result.error}
    row |= {"config_hash": s.config_hash if ok else before.get("config_hash"), "acquisition_hash": s.acquisition_hash if ok else before.get("acquisition_hash")}
    row |= {"revision": revision or before.get("revision"), "skipped": result.skipped if ok else before.get("skipped", 0), "index_status": "ready" if ok or indexed else "empty"}
    return row | {"last_attempt_at": now, "last_success_at": now if ok else before.get("last_success_at")}


@dataclass
class _Run:
    """One synchronisation in progress."""

    spark: SparkSession
    settings: Settings
    old: snapshot.Index
    work: Path
    progress: Callable[[str], None]

    def documents(self, source: registry.Source) -> tuple[DataFrame, acquire.Snapshot]:
        """The source's identified documents, staged in the shared folder; ValueError if any of them is bad."""
        taken = acquire.acquire(source, self.work)
        rich = materialize.materialize(self.spark, taken, self.settings.materialized, self.settings.limits)
        if bad := [r for r in rich if r["action"] == "failed"]:
            raise ValueError(f"{bad[0]['path']}: {bad[0]['error']}" + (f" (and {len(bad) - 1} more)" if len(bad) > 1 else ""))
        files = acquire.contents(self.spark, taken, self.settings.limits.rich_bytes)
        both = materialize.native_documents(files).unionByName(materialize.topic_documents(self.spark, self.settings.materialized, source.name))
        at = str(self.work / f"documents-{source.name}")
        identified(both).write.parquet(at)
        staged = self.spark.read.parquet(at)
        faults = staged.where(F.col("error").isNotNull()).orderBy("path").limit(1).collect()
        if faults:
            raise ValueError(f"{faults[0]['path']}: {faults[0]['error']}")
        return staged, taken


def sync_index(
    spark: SparkSession,
    settings: Settings,
    only: str | None = None,
    rebuild: bool = False,
    dry_run: bool = False,
    now: datetime | None = None,
    progress: Callable[[str], None] = lambda _: None,
) -> SyncResult:
    """Bring the index to what the registry asks for; one new version holds all of a run's changes.

    Any bad file rejects its source, which keeps its old rows.  A rebuild takes all sources or fails as a whole.  A dry run changes
    nothing.  Only files whose digest changed are split again.
    """
    if rebuild and only:
        raise ValueError("a rebuild takes all sources, not one")
    wanted = registry.load(settings.sources_config)
    check_folders(wanted, settings)
    old = snapshot.open_index(spark, settings.index) if not rebuild else _empty(spark, settings)
    stamp = pipeline_fingerprint(settings)
    if old.tables and old.meta and old.meta.get("fingerprint") != stamp:
        raise ValueError("the pipeline has changed since the index was built: a rebuild is needed")
    before = {r["name"]: r.asDict() for r in old["sources"].collect()}  # bounded by the registry
    known = old["sources"].select("name", "config_hash", "acquisition_hash", "sync_status", F.col("config_hash").isNull().alias("legacy"))
    # a source that never succeeded has no configuration on record, but is no old one
    known = known.withColumn("legacy", F.col("legacy") & (F.col("sync_status") == "ready"))
    plan = sorted((r["name"], r["action"]) for r in sync.source_plan(registry.as_table(spark, wanted), known).collect())
    if only is not None:
        plan = [p for p in plan if p[0] == only]
        if not plan:
            raise ValueError(f"unknown source {only}")
    if dry_run:
        return SyncResult([SourceResult(n, a, "planned") for n, a in plan], old.version, dry_run=True)
    now = now or datetime.now(timezone.utc).replace(microsecond=0)
    with snapshot.locked(settings.state):
        work = settings.state / f"work-{uuid.uuid4().hex}"
        work.mkdir(parents=True)
        try:
            return _run(_Run(spark, settings, old, work, progress), {s.name: s for s in wanted}, plan, before, now, rebuild, stamp)
        finally:
            shutil.rmtree(work, ignore_errors=True)


def _delete_inside(root: Path, name: str) -> None:
    """Delete a source's folder; a name out of the index that points elsewhere deletes nothing."""
    folder = (root / name).resolve()
    if folder.parent == root.resolve() and folder.name == name:
        shutil.rmtree(folder, ignore_errors=True)


def _empty(spark: SparkSession, settings: Settings) -> snapshot.Index:
    tables = {name: spark.createDataFrame([], schema) for name, schema in snapshot.TABLES.items()}
    return snapshot.Index(snapshot.current_version(settings.index), {}, tables)


def check_folders(sources: Iterable[registry.Source], settings: Settings) -> None:
    """Local sources and our own folders must not contain each other."""
    for s in sources:
        if s.type != "local":
            continue
        origin = Path(s.origin)
        for own in (settings.state.resolve(), settings.materialized.resolve()):
            if own == origin or own.is_relative_to(origin) or origin.is_relative_to(own):
                raise ValueError(f"source {s.name} overlaps {own}")


def _run(run: _Run, wanted: dict[str, registry.Source], plan: list[tuple[str, str]], before: dict[str, dict[str, Any]], now: datetime, rebuild: bool, stamp: str) -> SyncResult:
    spark, old = run.spark, run.old
    rows, results, fresh, gone = dict(before), [], [], []
    for i, (name, action) in enumerate(plan):
        run.progress(f"{100 * i // len(plan)}% {name}: {action}")
        result = SourceResult(name, action, "ready")
        results.append(result)
        if action == "remove":
            files = old["files"].where(F.col("source") == name).select("source", "path")
            result.counts["removed"] = files.count()
            gone.append(files)
            rows.pop(name, None)
            _delete_inside(run.settings.materialized, name)
            continue
        source, revision = wanted[name], None
        if action != "metadata":
            try:
                documents, taken = run.documents(source)
                result.skipped, revision = taken.skipped, taken.revision
                diff = sync.file_diff(old["files"].where(F.col("source") == name), documents, force=rebuild)
                result.counts = {a: int(n) for a, n in sync.counters(diff).first().asDict().items()}
                gone.append(diff.where(F.col("action").isin("changed", "removed")).select("source", "path"))
                fresh.append(documents.join(diff.where(F.col("action").isin("added", "changed")).select("source", "path"), ["source", "path"], "left_semi"))
            except (ValueError, OSError, RuntimeError) as e:
                if rebuild:
                    raise
                result.status, result.error = "failed", redact(e, source.origin)
        indexed = not old["files"].where(F.col("source") == name).isEmpty()
        rows[name] = _source_row(source, before.get(name, {}), result, revision, now, indexed)
    staged = _union(fresh)
    if staged is not None:  # split once; every table is made from the staged passages
        prepared(staged).write.parquet(str(run.work / "prepared"))
        staged = spark.read.parquet(str(run.work / "prepared"))
    embedder = providers.embedder(run.settings)
    tables = next_tables(old, index_rows(staged, now, embedder) if staged is not None else None, _union(gone))
    fields = [f.name for f in spark.createDataFrame([], snapshot.TABLES["sources"]).schema]
    tables["sources"] = spark.createDataFrame([tuple(rows[n].get(f) for f in fields) for n in sorted(rows)], snapshot.TABLES["sources"])
    published = snapshot.publish(spark, run.settings.index, tables, {"fingerprint": stamp, "dim": embedder.dim})
    run.progress("100%")
    return SyncResult(results, published.version)


def report(result: SyncResult) -> str:
    """A run as a table of fixed width."""
    head = ("source", "action", "status", *ACTIONS, "skipped")
    lines = [head] + [(s.name, s.action, s.status, *(str(s.counts[a]) for a in ACTIONS), str(s.skipped)) for s in result.sources]
    widths = [max(len(line[i]) for line in lines) for i in range(len(head))]
    out = ["  ".join(cell.ljust(w) for cell, w in zip(line, widths, strict=True)).rstrip() for line in lines]
    return "\n".join(out + [f"! {s.name}: {s.error}" for s in result.sources if s.error])
