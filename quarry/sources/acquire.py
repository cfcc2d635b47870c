"""Acquisition: private copies of a source's eligible files, and their contents as a table."""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
import tarfile
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.shipping import ship
from quarry.sources.registry import Source

CONTENT = "source string, path string, bytes long, sha256 string, content binary, error string"
_GIT_SECONDS = 600


@dataclass(frozen=True)
class Snapshot:
    """An immutable copy of a source: its folder, the revision (git only), the files and how many were left out."""

    source: str
    root: Path
    revision: str | None
    paths: tuple[str, ...]
    skipped: int


def is_eligible(path: str, kind: str) -> bool:
    """Text formats from anywhere, rich ones from local sources only; the suffix's case doesn't matter."""
    end = PurePosixPath(path).suffix.lower().lstrip(".")
    return end in T.TEXT_SUFFIXES or (kind == "local" and end in T.RICH_SUFFIXES)


def is_hidden(path: str) -> bool:
    return any(part.startswith(".") for part in PurePosixPath(path).parts)


def walk(root: Path, kind: str) -> tuple[list[str], int]:
    """(relative paths of eligible files in order, number of skipped entries).

    Hidden entries, links and files of other formats are skipped; a skipped folder counts once and isn't entered.
    """
    found, skipped, todo = [], 0, [Path(root)]
    while todo:
        for entry in os.scandir(todo.pop()):
            relative = Path(entry.path).relative_to(root).as_posix()
            if entry.name.startswith(".") or entry.is_symlink():
                skipped += 1
            elif entry.is_dir():
                todo.append(Path(entry.path))
            elif entry.is_file() and is_eligible(relative, kind):
                found.append(relative)
            else:
                skipped += 1
    return sorted(found), skipped


@contextmanager
def _fresh_folder(parent: Path) -> Iterator[Path]:
    """A new private folder that is removed again if the block fails."""
    parent.mkdir(parents=True, exist_ok=True)
    folder = Path(tempfile.mkdtemp(prefix="snapshot-", dir=parent))
    try:
        yield folder
    except BaseException:
        shutil.rmtree(folder, ignore_errors=True)
        raise


def acquire_local(source: Source, parent: Path) -> Snapshot:
    with _fresh_folder(parent) as folder:
        paths, skipped = walk(Path(source.origin), "local")
        for p in paths:
            (folder / p).parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(Path(source.origin) / p, folder / p, follow_symlinks=False)
        return Snapshot(source.name, folder, None, tuple(paths), skipped)


def _git(*args: str, cwd: Path) -> str:
    env = os.environ | {"GIT_TERMINAL_PROMPT": "0"}
    done = subprocess.run(["git", *args], cwd=cwd, env=env, capture_output=True, text=True, timeout=_GIT_SECONDS, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout.strip()


def _unsafe(name: str) -> bool:
    return name.startswith("/") or "\\" in name or ".." in PurePosixPath(name).parts


def acquire_git(source: Source, parent: Path) -> Snapshot:
    """Eligible files of one commit: the ref is fetched without history, and exported without a checkout (so no filter or
    hook of the repository runs)."""
    with _fresh_folder(parent) as folder, tempfile.TemporaryDirectory(dir=parent, prefix="fetch-") as scratch:
        work = Path(scratch)
        _git("init", "-q", "--bare", ".", cwd=work)
        _git("fetch", "-q", "--depth", "1", "--no-tags", "--", source.origin, source.ref or "HEAD", cwd=work)
        revision = _git("rev-parse", "FETCH_HEAD^{commit}", cwd=work)
        tree = f"{revision}:{source.directory}" if source.directory else revision
        _git("archive", "--format=tar", "-o", "tree.tar", tree, cwd=work)
        paths, skipped = [], 0
        with tarfile.open(work / "tree.tar") as tar:
            for member in tar:
                if member.isdir():
                    continue
                if _unsafe(member.name):
                    raise RuntimeError(f"unsafe path in the tree: {member.name}")
                if not member.isfile() or is_hidden(member.name) or not is_eligible(member.name, "git"):
                    skipped += 1
                    continue
                (folder / member.name).parent.mkdir(parents=True, exist_ok=True)
                with tar.extractfile(member) as read, open(folder / member.name, "wb") as write:
                    shutil.copyfileobj(read, write)
                paths.append(member.name)
        return Snapshot(source.name, folder, revision, tuple(sorted(paths)), skipped)


def acquire(source: Source, parent: Path) -> Snapshot:
    return acquire_git(source, parent) if source.type == "git" else acquire_local(source, parent)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of listed files, one batch a file, so that memory holds one file at a time."""
    for batch in batches:
        for source, root, path, most in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            size, digest, content, error = None, None, None, None
            try:
                size = os.path.getsize(os.path.join(root, path))
                if size > most:
                    error = "too_large"
                else:
                    with open(os.path.join(root, path), "rb") as f:
                        content = f.read()
                    digest = hashlib.sha256(content).hexdigest()
            except OSError as e:
                error = f"unreadable: {e.strerror}"
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((source, pa.string()), (path, pa.string()), (size, pa.int64()), (digest, pa.string()), (content, pa.binary()), (error, pa.string()))],
                names=["source", "path", "bytes", "sha256", "content", "error"],
            )


def contents(spark: SparkSession, snapshot: Snapshot, most_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """source, path, bytes, sha256, content, error of a snapshot's files, read by the executors from the shared folder.

    A file over ``most_bytes``, or one that can't be read, has an error and no content.
    """
    rows = [(snapshot.source, str(snapshot.root), p, most_bytes) for p in snapshot.paths]
    listed = ship(spark).createDataFrame(rows, "source string, root string, path string, most long")
    spread = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    return listed.repartition(spread, "path").mapInArrow(_read, CONTENT)


def scan(spark: SparkSession, url: str, source: str, kind: str = "git") -> DataFrame:
    """source, path, bytes, sha256, content of a tree in remote storage, read by Spark's binary file source.

    Suffix and hidden-path predicates are applied to the listing's path, before contents are hashed.  (Spark itself passes
    over names that begin with an underscore.)
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(url)
    base = "/" + url.split("://", 1)[-1].strip("/") + "/"
    inner = F.substring_index(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), base, -1)
    named = raw.select(F.lit(source).alias("source"), inner.alias("path"), F.col("length").alias("bytes"), "content")
    kept = named.where(T.eligible(F.col("path"), F.lit(kind)) & ~F.col("path").rlike(r"(^|/)\."))
    return kept.select("source", "path", "bytes", F.sha2("content", 256).alias("sha256"), "content")


def decoded(files: DataFrame) -> DataFrame:
    """Adds text and an error for text files: strict UTF-8 without NUL bytes, anything else is an error with null text."""
    good = T.valid_text(F.col("content"))
    problem = F.when(F.col("content").isNull(), F.lit("no content")).when(~good, F.lit("not valid UTF-8 text"))
    before = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    return files.withColumn("error", F.coalesce(before, problem)).withColumn("text", F.when(good, F.col("content").cast("string")))
