"""Plug points for embedding and re-ranking models.

A model is given as ``load``, a function without arguments that may take its time and memory: it is called at the first
use in a process, on the driver and in each Python worker, and its result is kept there.  It has to be picklable (best:
a function of an installed module).  `Settings.embedder` and `Settings.reranker` name such functions as
``module:function``.
"""

from __future__ import annotations

import importlib
import threading
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators.search import HashingEmbedder, overlap_scorer
from quarry.shipping import ship

Embed = Callable[[list[str]], Sequence[Sequence[float]]]
Judge = Callable[[str, list[str]], Sequence[float]]


class Embedder(Protocol):
    """What the index and the search need of an embedding model."""

    dim: int

    def query(self, text: str) -> list[float]: ...

    def passages(self, column: Column) -> Column: ...


_MODELS: dict[str, Any] = {}
_LOCK = threading.Lock()


def loaded(name: str, load: Callable[[], Any]) -> Any:
    """The model of that name in this process, loaded once however many threads ask."""
    if name not in _MODELS:
        with _LOCK:
            if name not in _MODELS:
                _MODELS[name] = load()
    return _MODELS[name]


class ModelEmbedder:
    """An embedding model; ``instruction`` goes before queries, never before passages.

    ``load`` gives a function from texts to vectors of one width.  Null passages are embedded as empty ones; an
    infinite or wrongly sized vector is an error, as it would spoil every distance.
    """

    def __init__(self, name: str, load: Callable[[], Embed], instruction: str = "", batch: int = 64):
        if batch < 1:
            raise ValueError("a batch has one text at least")
        self.name, self.load, self.instruction, self.batch = name, load, instruction, batch
        self._dim: int | None = None

    @property
    def dim(self) -> int:
        """The vectors' width, measured by a probe."""
        if self._dim is None:
            self._dim = len(loaded(self.name, self.load)(["probe"])[0])
        return self._dim

    def query(self, text: str) -> list[float]:
        return [float(x) for x in loaded(self.name, self.load)([self.instruction + text])[0]]

    def passages(self, column: Column) -> Column:
        name, load, batch, dim = self.name, self.load, self.batch, self.dim

        def embed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = loaded(name, load)
            for part in parts:
                texts = [x or "" for x in part.to_pylist()]
                rows = [[float(x) for x in v] for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
                bad = len(rows) != len(texts) or any(len(v) != dim or not all(abs(x) < float("inf") for x in v) for v in rows)
                if bad:
                    raise ValueError(f"{name} gave no finite vector of {dim} numbers for each text")
                yield pa.array(rows, pa.list_(pa.float32()))

        # the session of the caller, as a column knows none
        if (spark := SparkSession.getActiveSession()) is not None:
            ship(spark)
        return F.arrow_udf(embed, "array<float>")(column)


def model_scorer(name: str, load: Callable[[], Judge]) -> Callable[[str], Callable[[DataFrame], DataFrame]]:
    """A re-ranking model as what `search.search` takes: for a query, a function that adds rerank_score to (…, text).

    ``load`` gives a function from a query and texts to one score each, higher is better.  At most the re-ranking pool
    is judged, a few dozen rows.
    """

    def of(query: str) -> Callable[[DataFrame], DataFrame]:
        def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = loaded(name, load)
            for part in parts:
                texts = [x or "" for x in part.to_pylist()]
                yield pa.array([float(x) for x in model(query, texts)] if texts else [], pa.float64())

        def score(pool: DataFrame) -> DataFrame:
            ship(pool.sparkSession)
            return pool.withColumn("rerank_score", F.arrow_udf(judge, "double")("text"))

        return score

    return of


def _named(reference: str) -> Callable[[], Any]:
    module, _, function = reference.partition(":")
    if not module or not function:
        raise ValueError(f"{reference!r} is not of the form module:function")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"no provider {reference}: {e}") from None


def embedder(settings: Settings) -> Embedder:
    """The configured embedding model; the hashing one where none is."""
    if not settings.embedder:
        return HashingEmbedder(settings.embedding_dim)
    return ModelEmbedder(settings.embedder, _named(settings.embedder), settings.query_instruction, settings.embed_batch)


def scorer(settings: Settings) -> Callable[[str], Callable[[DataFrame], DataFrame]] | None:
    """The configured re-ranker: none, ``overlap`` or a model."""
    if not settings.reranker:
        return None
    return overlap_scorer if settings.reranker == "overlap" else model_scorer(settings.reranker, _named(settings.reranker))


def warm_up(settings: Settings) -> dict[str, Any]:
    """Load the configured models and use each once; what they are."""
    found: dict[str, Any] = {"embedder": settings.embedder or "hashing", "dim": embedder(settings).dim}
    if settings.reranker and settings.reranker != "overlap":
        loaded(settings.reranker, _named(settings.reranker))("probe", ["probe"])
    return found | {"reranker": settings.reranker or "none"}
