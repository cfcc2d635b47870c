"""The source registry: a TOML file of desired sources, checked as a whole before anything is touched."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from collections import Counter
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from pathlib import Path, PurePosixPath
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

#: Fixed values.
NAME = re.compile(r"[a-z0-9][a-z0-9._-]*")
DEVICE_NAMES = frozenset({"con", "prn", "aux", "nul"} | {f"{port}{i}" for port in ("com", "lpt") for i in range(1, 10)})
FIELDS = {"git": {"name", "type", "description", "url", "ref", "directory"}, "local": {"name", "type", "description", "path"}}
SUFFIX = "-docs"
VERSION = 1

SCHEMA = "name string, type string, origin string, ref string, directory string, description string, config_hash string, acquisition_hash string"


class RegistryError(ValueError):
    """The registry can't be used; nothing has been changed."""


@dataclass(frozen=True)
class Source:
    name: str
    type: str
    origin: str
    ref: str | None = None
    directory: str | None = None
    description: str | None = None

    @property
    def config_hash(self) -> str:
        return _digest(asdict(self))

    @property
    def acquisition_hash(self) -> str:
        """Hash of what decides which files are read: everything but name and description."""
        return _digest({k: v for k, v in asdict(self).items() if k not in ("name", "description")})


def _digest(value: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def relative_directory(value: str) -> str:
    """A sub-directory of a checkout in canonical spelling; absolute ones, back slashes, ``.`` and ``..`` are refused."""
    parts = value.split("/")
    if not value.strip() or "\\" in value or value.startswith("/") or any(p in (".", "..") for p in parts):
        raise ValueError("directory must be a relative path inside the checkout, with forward slashes")
    return str(PurePosixPath(value))


def bare_name(folder: str) -> str:
    """A folder's source name: without a trailing ``-docs``, unless that is all there is."""
    return folder[: -len(SUFFIX)] if folder.endswith(SUFFIX) and folder != SUFFIX else folder


def _text(entry: dict[str, Any], key: str, required: bool = False) -> str | None:
    value = entry.get(key)
    if value is None and not required:
        return None
    if not isinstance(value, str) or (key != "description" and not value.strip()):
        raise ValueError(f"{key} must be a non-empty string")
    return value if key == "description" else value.strip()


def check_entry(entry: Any) -> Source:
    """The source of one table of the registry; ValueError says what is wrong with it."""
    if not isinstance(entry, dict):
        raise ValueError("must be a table")
    kind = entry.get("type")
    if kind not in FIELDS:
        raise ValueError("type must be 'git' or 'local'")
    name = _text(entry, "name", required=True)
    if not NAME.fullmatch(name) or name.endswith(".") or name.split(".")[0] in DEVICE_NAMES or name != entry["name"]:
        raise ValueError(f"name {name!r} must match {NAME.pattern}, without a dot at its end, and be no device name")
    if extra := sorted(set(entry) - FIELDS[kind]):
        raise ValueError(f"{kind} sources have no field {', '.join(extra)}")
    description = _text(entry, "description")
    if kind == "local":
        origin = Path(_text(entry, "path", required=True)).expanduser().resolve()
        if not origin.is_dir():
            raise ValueError(f"no such folder: {origin}")
        return Source(name, kind, str(origin), description=description)
    url = _text(entry, "url", required=True)
    split = urlsplit(url)
    if split.scheme in ("http", "https") and ("@" in split.netloc or split.query or split.fragment):
        raise ValueError("url must hold no credentials, query or fragment")
    directory = entry.get("directory")
    if directory is not None:
        directory = relative_directory(_text(entry, "directory"))
    return Source(name, kind, url, _text(entry, "ref"), directory, description)


def check_names(names: Iterable[str]) -> None:
    """Names have to differ, also without regard to case and to a trailing ``-docs``."""
    names = list(names)
    for key, what in ((str.casefold, "twice"), (lambda n: bare_name(n.casefold()), "with and without -docs")):
        twice = sorted(n for n, c in Counter(map(key, names)).items() if c > 1)
        if twice:
            raise ValueError(f"source {', '.join(twice)} is listed {what}")


def parse(text: str) -> list[Source]:
    """The sources of a registry's text, by name; RegistryError names the first fault."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise RegistryError(f"not TOML: {e}") from e
    if extra := sorted(set(raw) - {"version", "source"}):
        raise RegistryError(f"unknown key {', '.join(extra)}")
    if raw.get("version") != VERSION or isinstance(raw.get("version"), bool):
        raise RegistryError(f"version must be {VERSION}")
    entries = raw.get("source", [])
    if not isinstance(entries, list):
        raise RegistryError("source must be an array of tables")
    found = []
    for i, entry in enumerate(entries, 1):
        try:
            found.append(check_entry(entry))
        except ValueError as e:
            raise RegistryError(f"source {i}: {e}") from e
    try:
        check_names(s.name for s in found)
    except ValueError as e:
        raise RegistryError(str(e)) from e
    return sorted(found, key=lambda s: s.name)


def load(path: str | Path) -> list[Source]:
    try:
        return parse(Path(path).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError) as e:
        raise RegistryError(f"can't read {path}: {e}") from e


def discover(root: str | Path) -> list[Source]:
    """Sources by convention: every folder of ``root`` that isn't hidden, named without ``-docs``."""
    folders = sorted(p for p in Path(root).iterdir() if p.is_dir() and not p.name.startswith("."))
    check_names(p.name for p in folders)
    return [Source(bare_name(p.name), "local", str(p.resolve())) for p in folders]


def as_table(spark: SparkSession, sources: Iterable[Source]) -> DataFrame:
    """One row for each source with both hashes (`operators.sync.source_plan` compares them)."""
    return spark.createDataFrame([(*asdict(s).values(), s.config_hash, s.acquisition_hash) for s in sources], SCHEMA)
