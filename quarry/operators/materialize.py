"""Turning rich documents into topic files with manifests, and reading those back as documents."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import shutil
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Limits
from quarry.functions import text as T
from quarry.shipping import ship
from quarry.sources import manifest as M
from quarry.sources.acquire import Snapshot, contents
from quarry.sources.rich import RichError, parse

PIPELINE_VERSION = "1"
FAILURES = "_failures.json"
RESULT = "path string, action string, topics long, pages long, blocks long, ocr_pages long, warnings long, parser string, error_code string, error string"
_RESULT_TYPES = [pa.string(), pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.string()]

DOCUMENT = (
    "source string, path string, bytes long, content binary, materialized boolean, origin_path string, origin_media_type string, section_id string, page_start int, page_end int, "
    "page_labels array<string>, extraction_methods array<string>, warnings array<string>, content_kinds array<string>, heading_path string, fingerprint string, error string"
)
_LIST = pa.list_(pa.string())
_DOCUMENT_TYPES = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), *[pa.string()] * 3, *[pa.int32()] * 2, *[_LIST] * 4, *[pa.string()] * 3]


def fingerprint(suffix: str) -> str:
    """Changes whenever the same bytes might give other topic files."""
    backend = "docx-ooxml 1"
    if suffix == "pdf":
        try:
            backend = f"pypdf {importlib.metadata.version('pypdf')}"
        except importlib.metadata.PackageNotFoundError:
            backend = "pypdf missing"
    return hashlib.sha256(json.dumps([PIPELINE_VERSION, M.VERSION, suffix, backend]).encode()).hexdigest()


def _batch(rows: list[tuple[Any, ...]], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [part.split(" ")[0] for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _one(root: Path, source: str, path: str, sha256: str, content: bytes, limits: Limits, force: bool, strict: bool) -> tuple[Any, ...]:
    """Materialise one document unless its folder already holds this content by this pipeline."""
    suffix = path.rsplit(".", 1)[-1].lower()
    stamp, folder = fingerprint(suffix), M.folder_of(root, source, path)
    old: dict[str, Any] | None = None
    if folder.exists() and not force:
        try:
            old = M.read(folder)
        except M.ManifestError:
            old = None
    if old is not None and (old["origin_sha256"], old["pipeline_fingerprint"]) == (sha256, stamp) and not (strict and old["warnings"]):
        made, action = old, "unchanged"
    else:
        action = "changed" if folder.exists() else "added"
        parsed = parse(content, suffix, limits)
        if strict and parsed.warnings:
            raise RichError("strict_warnings", "; ".join(parsed.warnings))
        made, files = M.build(source, path, sha256, stamp, parsed)
        M.publish(folder, made, files)
    blocks = sum(d.get("block_count") or 0 for d in made["documents"])
    return (path, action, len(made["documents"]), made.get("page_count") or 0, blocks, len(made.get("ocr_pages", [])), len(made["warnings"]), f"{made['parser']['name']} {made['parser']['version']}", None, None)


def materialize(spark: SparkSession, snapshot: Snapshot, root: Path, limits: Limits | None = None, force: bool = False, strict: bool = False) -> list[dict[str, Any]]:
    """Materialise a snapshot's rich documents: one result for each, and for each folder removed because its document is gone.

    Executors parse and publish each document on its own, so one failure loses no other and leaves an older folder as it was; a task
    that is run again finds its finished folders unchanged.  Failures are listed in a ledger that goes when there are none.
    """
    limits = limits or Limits()
    rich = tuple(p for p in snapshot.paths if p.rsplit(".", 1)[-1].lower() in T.RICH_SUFFIXES)
    source = snapshot.source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sha256, content, error in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    if content is None:
                        raise RichError(error or "unreadable", error or "unreadable")
                    row = _one(root, source, path, sha256, content, limits, force, strict)
                except (ValueError, OSError) as e:
                    row = (path, "failed", 0, 0, 0, 0, 0, None, getattr(e, "code", "invalid"), str(e)[:500])
                yield _batch([row], _RESULT_TYPES, RESULT)

    read = contents(ship(spark), Snapshot(source, snapshot.root, snapshot.revision, rich, 0), limits.rich_bytes)
    # sorted here, as a range sort would run the parsers once more for its sample
    results = sorted((r.asDict() for r in read.select("path", "sha256", "content", "error").mapInArrow(run, RESULT).collect()), key=lambda r: r["path"]) if rich else []
    gone = [f for f in M.folders(root, source) if f.relative_to(root / source).as_posix() not in set(rich)]
    for folder in gone:
        shutil.rmtree(folder)
        results.append({"path": folder.relative_to(root / source).as_posix(), "action": "removed", "topics": 0, "pages": 0, "blocks": 0, "ocr_pages": 0, "warnings": 0, "parser": None, "error_code": None, "error": None})
    _write_failures(root / source, {r["path"]: {"code": r["error_code"], "message": r["error"]} for r in results if r["action"] == "failed"})
    return results


def _write_failures(base: Path, failures: dict[str, dict[str, str]]) -> None:
    if not failures:
        (base / FAILURES).unlink(missing_ok=True)
        return
    base.mkdir(parents=True, exist_ok=True)
    staged = base / f"{FAILURES}.next"
    staged.write_text(json.dumps(failures, sort_keys=True, ensure_ascii=False), encoding="utf-8")
    os.replace(staged, base / FAILURES)


def failures(root: Path, source: str) -> dict[str, dict[str, str]]:
    try:
        return json.loads((root / source / FAILURES).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return {}


def summary(results: list[dict[str, Any]]) -> dict[str, Any]:
    """Counters of a run's results."""
    out: dict[str, Any] = {a: sum(r["action"] == a for r in results) for a in ("added", "changed", "removed", "unchanged", "failed")}
    out |= {k: sum(r[k] for r in results) for k in ("topics", "pages", "blocks", "ocr_pages", "warnings")}
    out["parsers"] = sorted({r["parser"] for r in results if r["parser"]})
    return out


def inspect(root: Path, source: str, path: str) -> dict[str, Any]:
    """What is known of a rich document or of one of its topics.

    An original path gives its manifest (with its last failure, if it has one); the path of a topic gives its entry and Markdown; else
    the failure alone; a path that is none of these is an error.
    """
    failed = failures(root, source).get(path)
    folder = M.folder_of(root, source, path)
    if (folder / M.FILE).is_file():
        return M.read(folder) | ({"last_failure": failed} if failed else {})
    if (folder.parent / M.FILE).is_file():
        entries = [d for d in M.read(folder.parent)["documents"] if d["path"] == folder.name]
        if entries:
            return entries[0] | {"markdown": folder.read_text(encoding="utf-8")}
    if failed:
        return {"origin_path": path, "last_failure": failed}
    raise ValueError(f"nothing is known of {source}/{path}")


def topic_documents(spark: SparkSession, root: Path, source: str) -> DataFrame:
    """A row for each topic file of a source with its provenance; a folder that doesn't match its manifest is a row with an error."""
    base = root / source

    def rows_of(folder: str) -> list[tuple[Any, ...]]:
        at = Path(folder)
        origin = at.relative_to(base).as_posix()
        try:
            made = M.read(at)
        except M.ManifestError as e:
            return [(source, origin, None, None, True, origin, *[None] * 10, str(e))]
        out = []
        for d in made["documents"]:
            body = (at / d["path"]).read_bytes()
            out.append((source, f"{origin}/{d['path']}", len(body), body, True, origin, made["origin_media_type"], d["section_id"], d["page_start"], d["page_end"],
                        d["page_labels"], d["extraction_methods"], d["warnings"], d["content_kinds"], " > ".join(d["heading_path"]), made["pipeline_fingerprint"], None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                yield _batch(rows_of(folder), _DOCUMENT_TYPES, DOCUMENT)

    listed = [(str(f),) for f in M.folders(root, source)]
    spread = max(1, min(len(listed), 4 * spark.sparkContext.defaultParallelism))
    return ship(spark).createDataFrame(listed, "folder string").repartition(spread, "folder").mapInArrow(run, DOCUMENT)


def native_documents(files: DataFrame) -> DataFrame:
    """Text files as documents of the same shape (`topic_documents` is the other half of the union)."""
    nothing = {"section_id": "string", "page_start": "int", "page_end": "int", "page_labels": "array<string>", "extraction_methods": "array<string>", "warnings": "array<string>", "content_kinds": "array<string>", "heading_path": "string", "fingerprint": "string"}
    texts = files.where(T.suffix(F.col("path")).isin(*T.TEXT_SUFFIXES))
    columns = [part.split(" ")[0] for part in DOCUMENT.split(", ")]
    return texts.select("source", "path", "bytes", "content", F.lit(False).alias("materialized"), F.col("path").alias("origin_path"), T.media_type(F.col("path")).alias("origin_media_type"), *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()], "error").select(*columns)
