"""Settings, each overridable by an environment variable ``QUARRY_<NAME>``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Limits:
    """What a rich document may cost (fixed default values)."""

    rich_bytes: int = 100 * 1024 * 1024
    pdf_pages: int = 2000
    extracted_chars: int = 20_000_000
    docx_entries: int = 10_000
    docx_expanded_bytes: int = 500 * 1024 * 1024
    processing_seconds: int = 1800


@dataclass(frozen=True)
class Settings:
    """Folders and serving options; lists are comma-separated in the environment.

    On a cluster ``state_dir`` has to be a folder that the driver and all executors share.
    """

    sources_config: str = "sources.toml"
    state_dir: str = ".quarry"
    materialized_dir: str = ""
    auth_token: str = ""
    allowed_origins: tuple[str, ...] = ()
    allowed_hosts: tuple[str, ...] = ()
    #: Providers as ``module:function`` (`operators.providers`); none: hashed words, and no re-ranking (or ``overlap``).
    embedder: str = ""
    reranker: str = ""
    query_instruction: str = ""
    embed_batch: int = 64
    embedding_dim: int = 64
    #: How hits are found and fused (default values fixed).
    candidates: int = 50
    rerank_pool: int = 40
    default_limit: int = 8
    rrf_k: int = 60
    w_phrase: float = 3.0
    w_lexical: float = 1.0
    w_dense: float = 1.0
    w_retrieval: float = 1.0
    w_rerank: float = 1.5
    limits: Limits = Limits()

    @property
    def state(self) -> Path:
        return Path(self.state_dir).absolute()

    @property
    def materialized(self) -> Path:
        return Path(self.materialized_dir).absolute() if self.materialized_dir else self.state / "materialized"

    @property
    def index(self) -> Path:
        return self.state / "index"


def _overridden(cls: type, env: dict[str, str]) -> dict[str, object]:
    found: dict[str, object] = {}
    for f in fields(cls):
        raw = env.get(f"QUARRY_{f.name.upper()}")
        if raw is None or f.name == "limits":
            continue
        if isinstance(f.default, int):
            found[f.name] = int(raw)
        elif isinstance(f.default, float):
            found[f.name] = float(raw)
        elif isinstance(f.default, tuple):
            found[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
        else:
            found[f.name] = raw
    return found


def from_environment(env: dict[str, str] | None = None) -> Settings:
    """Settings with the environment's overrides; a number that isn't one raises ValueError."""
    env = dict(os.environ) if env is None else env
    return Settings(limits=Limits(**_overridden(Limits, env)), **_overridden(Settings, env))
