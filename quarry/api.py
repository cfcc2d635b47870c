"""The read calls over a published index, as a class and as a small WSGI application."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Any
from urllib.parse import parse_qs, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.access import refuse
from quarry.config import Settings
from quarry.operators import providers, read, search, snapshot


class Library:
    """Read calls; each resolves the published version anew, so a running service sees new versions."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings
        self._open: snapshot.Index | None = None

    @property
    def index(self) -> snapshot.Index:
        version = snapshot.current_version(self.settings.index)
        if self._open is None or self._open.version != version:
            self._open = snapshot.open_index(self.spark, self.settings.index)
        return self._open

    def _known(self, index: snapshot.Index, source: str) -> str:
        names = sorted(r["name"] for r in index["sources"].select("name").collect())  # bounded by the registry
        if not names:
            raise ValueError("the index is empty: nothing has been indexed yet")
        if source not in names:
            raise ValueError(f"unknown source {source!r}; known are: {', '.join(names)}")
        return source

    def list_sources(self) -> DataFrame:
        """source, description, files, chunks, indexed_at, titles of every source."""
        i = self.index
        named = i["sources"].withColumnRenamed("name", "source")
        counted = read.list_sources(named, i["files"], i["chunks"])
        titles = read.sample_titles(i["files"])
        return named.select("source", "type", "description", "sync_status", "index_status").join(counted, "source").join(titles, "source", "left").orderBy("source")

    def totals(self) -> DataFrame:
        """One row: sources, files and chunks of the whole index."""
        i = self.index
        counted = read.list_sources(i["sources"].withColumnRenamed("name", "source"), i["files"], i["chunks"])
        return counted.agg(F.count("*").alias("sources"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))

    def search_docs(self, query: str, source: str, limit: int | None = None) -> DataFrame:
        """Hits of one source with their provenance, best first; searched and re-ranked as the settings say."""
        i, s = self.index, self.settings
        self._known(i, source)
        embedder = providers.embedder(s)
        if embedder.dim != i.meta.get("dim", embedder.dim):
            raise ValueError("the index holds vectors of another width than the configured embedder's: a rebuild is needed")
        scorer = providers.scorer(s)
        shape = {
            "scorer": scorer(query) if scorer else None, "candidates": s.candidates, "k": s.rrf_k, "pool_size": s.rerank_pool,
            "weights": {"phrase": s.w_phrase, "lexical": s.w_lexical, "dense": s.w_dense}, "rerank_weights": {"retrieval": s.w_retrieval, "rerank": s.w_rerank},
        }
        chunks = i["chunks"].withColumnRenamed("heading_path", "heading")
        hits = search.search(
            chunks, i["vectors"], query, [source], read.clamp("limit", s.default_limit if limit is None else limit), embedder.query(query), heading=True,
            stored=(i["postings"], i["term_stats"], i["corpus_stats"]), **shape
        )
        provenance = chunks.where(F.col("source") == source).select("chunk_id", F.col("heading").alias("heading_path"), "page_start", "page_end", "content_kinds")
        files = i["files"].where(F.col("source") == source).select("path", "title", "origin_path", "origin_media_type", "section_id", "page_labels", "extraction_methods")
        # at most 50 hits, so both joins broadcast them
        return files.join(F.broadcast(provenance.join(F.broadcast(hits), "chunk_id")), "path").orderBy("rank")

    def fetch_chunk(self, source: str, chunk_id: int, context: int = 1) -> DataFrame:
        i = self.index
        return read.fetch_chunk(i["chunks"], self._known(i, source), chunk_id, context)

    def fetch_doc(self, source: str, path: str, offset: int = 0, max_chars: int = 40000) -> DataFrame:
        """One page of the document's stored passages (one row; none if there is no such document)."""
        i = self.index
        self._known(i, source)
        one = read.document_text(i["chunks"].where((F.col("source") == source) & (F.col("path") == path)))
        return one.select(F.lit(source).alias("source"), F.lit(path).alias("path"), *[c.alias(n) for n, c in read.page_of(F.col("text"), offset, max_chars).items()])

    def document(self, source: str, path: str) -> str:
        """The whole text of one document."""
        i = self.index
        self._known(i, source)
        found = read.document_text(i["chunks"].where((F.col("source") == source) & (F.col("path") == path))).first()
        if found is None:
            raise ValueError(f"no document {path!r} in {source!r}")
        return found["text"]

    def health(self) -> tuple[int, dict[str, Any]]:
        """200 with counts if an index with sources is published, else 503."""
        try:
            i = self.index
            sources = i["sources"].count()
        except (snapshot.PublishError, OSError, ValueError) as e:
            return 503, {"status": "unavailable", "error": str(e)}
        return (200, {"status": "ok", "version": i.version, "sources": sources}) if sources else (503, {"status": "empty"})


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]  # read calls are bounded by their limits


def application(library: Library) -> Callable[[dict[str, Any], Callable[..., Any]], Iterable[bytes]]:
    """GET /health, /sources, /search, /chunk, /doc and /docs/{source}/{path}, answered as JSON."""
    s = library.settings

    def answer(path: str, q: dict[str, str]) -> tuple[int, Any]:
        if path == "/health":
            return library.health()
        if path == "/sources":
            return 200, {"sources": _rows(library.list_sources()), "totals": _rows(library.totals())[0]}
        if path == "/search":
            hits = _rows(library.search_docs(q["query"], q["source"], int(q["limit"]) if "limit" in q else None))
            return 200, {"hits": hits, "total": len(hits)}
        if path == "/chunk":
            return 200, {"passages": _rows(library.fetch_chunk(q["source"], int(q["chunk_id"]), int(q.get("context", 1))))}
        if path == "/doc":
            found = _rows(library.fetch_doc(q["source"], q["path"], int(q.get("offset", 0)), int(q.get("max_chars", 40000))))
            return (200, found[0]) if found else (404, {"error": "no such document"})
        if path.startswith("/docs/") and path.count("/") >= 3:
            source, inner = path[len("/docs/") :].split("/", 1)
            return 200, {"text": library.document(source, unquote(inner))}
        return 404, {"error": "no such call"}

    def app(environ: dict[str, Any], start: Callable[..., Any]) -> Iterable[bytes]:
        path = environ.get("PATH_INFO", "/")
        headers = {k[5:].replace("_", "-").lower(): v for k, v in environ.items() if k.startswith("HTTP_")}
        refusal = refuse(path, headers, s.auth_token, s.allowed_origins, s.allowed_hosts)
        extra: tuple[tuple[str, str], ...] = ()
        if refusal is not None:
            status, body, extra = refusal.status, {"error": refusal.message}, refusal.headers
        else:
            try:
                status, body = answer(path, {k: v[-1] for k, v in parse_qs(environ.get("QUERY_STRING", "")).items()})
            except KeyError as e:
                status, body = 400, {"error": f"missing {e.args[0]}"}
            except ValueError as e:
                status, body = 400, {"error": str(e)}
        raw = json.dumps(body, ensure_ascii=False, default=str).encode()
        start(f"{status} -", [("Content-Type", "application/json"), ("Content-Length", str(len(raw))), *extra])
        return [raw]

    return app
