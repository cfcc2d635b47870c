"""The manifest beside a rich document's topic files: what was read, how, and into which files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
from pathlib import Path, PurePosixPath
from typing import Any

from quarry.functions.topics import Topic, file_name, markdown, topics_of
from quarry.sources.rich import Block, Parsed

#: Fixed values of the format.
VERSION = 1
FILE = "_manifest.json"
MOST_BYTES = 16 * 1024 * 1024
_STRINGS = {"heading_path": 100, "page_labels": 2000, "content_kinds": 100, "extraction_methods": 100, "search_aliases": 1000, "warnings": 1000}
_STRING_CHARS = 10_000
_TOP = {"manifest_version", "source", "origin_path", "origin_media_type", "origin_sha256", "parser", "pipeline_fingerprint", "warnings", "documents"}
_TOP_OPTIONAL = {"page_count", "ocr_pages"}
_DOCUMENT = {"path", "section_id", "title", "page_start", "page_end", "block_start", "block_end", "section_confidence", *_STRINGS}
_DOCUMENT_OPTIONAL = {"block_count", "content_sha256"}
_SHA = re.compile(r"[0-9a-f]{64}")


class ManifestError(ValueError):
    """A manifest, or the folder it describes, isn't as it has to be."""


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ManifestError(message)


def _is_int(value: Any, least: int) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least


def _is_text(value: Any, most: int) -> bool:
    return isinstance(value, str) and 1 <= len(value) <= most


def _keys(value: Any, required: set[str], optional: set[str], what: str) -> None:
    _need(isinstance(value, dict), f"{what} must be an object")
    _need(required <= set(value), f"{what} lacks {sorted(required - set(value))}")
    _need(set(value) <= required | optional, f"{what} has unknown {sorted(set(value) - required - optional)}")


def _texts(value: Any, most: int, what: str) -> None:
    _need(isinstance(value, list) and len(value) <= most, f"{what} must be a list of at most {most}")
    _need(all(isinstance(v, str) and len(v) <= _STRING_CHARS for v in value), f"{what} must hold strings")


def safe_relative(path: Any) -> bool:
    """A relative path with forward slashes and without hidden or dotted parts."""
    return isinstance(path, str) and path != "" and "\\" not in path and not path.startswith("/") and all(p and not p.startswith(".") for p in path.split("/"))


def _check_location(value: Any, what: str) -> tuple[int, int, int]:
    """The position as a sortable (kind, page or document index, index)."""
    _keys(value, {"page", "document_index", "index"}, set(), what)
    page, place = value["page"], value["document_index"]
    _need(page is None or _is_int(page, 1), f"{what}: page")
    _need(place is None or _is_int(place, 0), f"{what}: document_index")
    _need(page is not None or place is not None, f"{what} needs a page or a document_index")
    _need(_is_int(value["index"], 0), f"{what}: index")
    return (0, page, value["index"]) if page is not None else (1, place, value["index"])


def _check_document(d: Any, pages: int | None) -> None:
    _keys(d, _DOCUMENT, _DOCUMENT_OPTIONAL, "document")
    _need(safe_relative(d["path"]) and "/" not in d["path"] and d["path"].lower().endswith(".md"), f"unsafe path {d['path']!r}")
    _need(_is_text(d["section_id"], 200) and _is_text(d["title"], _STRING_CHARS), "section_id and title must be texts")
    for name, most in _STRINGS.items():
        _texts(d[name], most, name)
    start, end = d["page_start"], d["page_end"]
    _need((start is None) == (end is None), "a page range has two ends or none")
    if start is not None:
        _need(pages is not None, "pages in a document without pages")
        _need(_is_int(start, 1) and _is_int(end, start) and end <= pages, "page range")
    begins, ends = _check_location(d["block_start"], "block_start"), _check_location(d["block_end"], "block_end")
    _need(begins[0] == ends[0] and begins <= ends, "block range is reversed")
    count, digest, sure = d.get("block_count"), d.get("content_sha256"), d["section_confidence"]
    _need(count is None or _is_int(count, 1), "block_count")
    _need(isinstance(sure, (int, float)) and not isinstance(sure, bool) and 0 <= sure <= 1, "section_confidence")
    _need(digest is None or (isinstance(digest, str) and _SHA.fullmatch(digest) is not None), "content_sha256")


def check(m: Any) -> dict[str, Any]:
    """The manifest itself if it is valid, else ManifestError."""
    _keys(m, _TOP, _TOP_OPTIONAL, "manifest")
    _need(m["manifest_version"] == VERSION and _is_int(m["manifest_version"], VERSION), "manifest_version")
    _need(_is_text(m["source"], 200) and _is_text(m["origin_media_type"], 200) and _is_text(m["pipeline_fingerprint"], 500), "source, media type and fingerprint must be texts")
    _need(safe_relative(m["origin_path"]), "origin_path must be a safe relative path")
    _need(isinstance(m["origin_sha256"], str) and _SHA.fullmatch(m["origin_sha256"]) is not None, "origin_sha256")
    _keys(m["parser"], {"name", "version"}, set(), "parser")
    _need(all(_is_text(v, 200) for v in m["parser"].values()), "parser")
    _texts(m["warnings"], 10_000, "warnings")
    pages, scanned = m.get("page_count"), m.get("ocr_pages", [])
    _need(pages is None or _is_int(pages, 1), "page_count")
    _need(isinstance(scanned, list) and all(_is_int(p, 1) for p in scanned) and scanned == sorted(set(scanned)), "ocr_pages must be unique and in order")
    _need(not scanned or (pages is not None and scanned[-1] <= pages), "ocr_pages exceed the document")
    _need(isinstance(m["documents"], list) and len(m["documents"]) <= 20_000, "documents")
    for d in m["documents"]:
        _check_document(d, pages)
    for key in ("path", "section_id"):
        _need(len({d[key] for d in m["documents"]}) == len(m["documents"]), f"{key} is used twice")
    return m


def canonical(m: dict[str, Any]) -> bytes:
    """Sorted keys, no blanks, other scripts as they are, one line feed at the end."""
    return (json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode()


def _location(b: Block) -> dict[str, int | None]:
    return {"page": b.page, "document_index": b.index if b.page is None else None, "index": b.page_index}


def _entry(topic: Topic, body: bytes) -> dict[str, Any]:
    pages = [b.page for b in topic.blocks if b.page is not None]
    return {
        "path": file_name(topic),
        "section_id": topic.section_id,
        "title": topic.title,
        "heading_path": list(topic.heading_path),
        "page_start": min(pages, default=None),
        "page_end": max(pages, default=None),
        "page_labels": list(dict.fromkeys(b.page_label for b in topic.blocks if b.page_label)),
        "block_start": _location(topic.blocks[0]),
        "block_end": _location(topic.blocks[-1]),
        "block_count": len(topic.blocks),
        "section_confidence": topic.confidence,
        "content_kinds": sorted({b.kind for b in topic.blocks}),
        "extraction_methods": sorted({b.method for b in topic.blocks}),
        "search_aliases": [],
        "warnings": list(topic.warnings),
        "content_sha256": hashlib.sha256(body).hexdigest(),
    }


def build(source: str, origin: str, sha256: str, fingerprint: str, parsed: Parsed) -> tuple[dict[str, Any], dict[str, bytes]]:
    """(checked manifest, topic files by name) of a parsed document."""
    topics = topics_of(parsed)
    bodies = [markdown(t).encode() for t in topics]
    manifest = {
        "manifest_version": VERSION,
        "source": source,
        "origin_path": origin,
        "origin_media_type": parsed.media_type,
        "origin_sha256": sha256,
        "page_count": parsed.page_count,
        "parser": {"name": parsed.parser, "version": parsed.version},
        "pipeline_fingerprint": fingerprint,
        "warnings": list(parsed.warnings),
        "ocr_pages": sorted({b.page for b in parsed.blocks if b.method == "ocr" and b.page is not None}),
        "documents": [_entry(t, b) for t, b in zip(topics, bodies, strict=True)],
    }
    check(manifest)
    return manifest, {d["path"]: b for d, b in zip(manifest["documents"], bodies, strict=True)}


def swap(staged: Path, live: Path) -> None:
    """Put a finished folder in place of the live one; if that fails, the old one is back."""
    old = live.with_name(live.name + ".previous")
    shutil.rmtree(old, ignore_errors=True)
    if live.exists():
        live.rename(old)
    try:
        staged.rename(live)
    except OSError:
        if old.exists():
            old.rename(live)
        raise
    shutil.rmtree(old, ignore_errors=True)


def publish(folder: Path, manifest: dict[str, Any], files: dict[str, bytes]) -> None:
    """Write everything beside ``folder``, check it as a reader would, then swap it in."""
    folder.parent.mkdir(parents=True, exist_ok=True)
    staged = Path(tempfile.mkdtemp(prefix=f".{folder.name}-", dir=folder.parent))
    try:
        for name, body in files.items():
            (staged / name).write_bytes(body)
        (staged / FILE).write_bytes(canonical(manifest))
        read(staged)
        swap(staged, folder)
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def read(folder: Path) -> dict[str, Any]:
    """The checked manifest of a folder that holds exactly the listed files with the listed digests."""
    path = folder / FILE
    try:
        _need(not path.is_symlink() and path.stat().st_size <= MOST_BYTES, "the manifest is a link or too large")
        found = check(json.loads(path.read_bytes()))
    except (OSError, ValueError) as e:
        if isinstance(e, ManifestError):
            raise
        raise ManifestError(f"unreadable manifest: {e}") from e
    there = {e.name: e for e in os.scandir(folder) if e.name != FILE}
    _need(not any(e.is_symlink() or not e.is_file() for e in there.values()), "the folder holds something that is no plain file")
    _need(set(there) == {d["path"] for d in found["documents"]}, "the files differ from those listed")
    for d in found["documents"]:
        digest = hashlib.sha256((folder / d["path"]).read_bytes()).hexdigest()
        _need(d.get("content_sha256") in (None, digest), f"{d['path']} was altered")
    return found


def folder_of(root: Path, source: str, origin: str) -> Path:
    """Where a document's topics go; paths that would leave ``root`` are refused."""
    _need(safe_relative(origin), "unsafe origin path")
    return root / source / PurePosixPath(origin)


def folders(root: Path, source: str) -> list[Path]:
    """Every folder of a source that holds a manifest; links are not followed."""
    base = root / source
    return sorted(Path(at) for at, inner, names in os.walk(base) if FILE in names and not any(p.startswith(".") for p in Path(at).relative_to(base).parts))
