"""Command line: sync, index, materialize, inspect, search, serve, warmup.  Exit code 1: something failed; 2: nothing could be done."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from wsgiref.simple_server import make_server

from pyspark.sql import SparkSession

from quarry import api, config
from quarry.operators import lifecycle, materialize, providers, snapshot
from quarry.sources import acquire, registry

SNIPPET = 160


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("sync", "bring the index to what the registry asks for"), ("index", "the same, by an older name")):
        c = sub.add_parser(name, help=text)
        c.add_argument("--source")
        c.add_argument("--rebuild", "--force", action="store_true")
        c.add_argument("--dry-run", action="store_true")
        c.add_argument("--quiet", action="store_true")
    c = sub.add_parser("materialize", help="turn rich documents of local sources into topic files")
    c.add_argument("--source")
    c.add_argument("--force", action="store_true")
    c.add_argument("--strict", action="store_true")
    c = sub.add_parser("inspect", help="show what is known of a rich document or a topic")
    c.add_argument("source")
    c.add_argument("path")
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("search", help="query one source")
    c.add_argument("query", nargs="+")
    c.add_argument("--source", required=True)
    c.add_argument("-n", "--limit", type=int, default=5)
    c = sub.add_parser("serve", help="answer the read calls over HTTP")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8765)
    sub.add_parser("warmup", help="load the configured models and use each once")
    return p


def _materialize(spark: SparkSession, settings: config.Settings, a: argparse.Namespace) -> int:
    sources = [s for s in registry.load(settings.sources_config) if s.type == "local" and a.source in (None, s.name)]
    if a.source and not sources:
        raise ValueError(f"no local source {a.source}")
    lifecycle.check_folders(sources, settings)
    failed = 0
    with snapshot.locked(settings.state):
        for s in sources:
            taken = acquire.acquire(s, settings.state)
            try:
                results = materialize.materialize(spark, taken, settings.materialized, settings.limits, a.force, a.strict)
            finally:
                shutil.rmtree(taken.root, ignore_errors=True)
            total = materialize.summary(results)
            failed += total["failed"]
            print(f"{s.name}: " + ", ".join(f"{k} {v}" for k, v in total.items()))
            for r in results:
                if r["action"] == "failed":
                    print(f"! {r['path']}: {r['error']}", file=sys.stderr)
    return int(failed > 0)


def _inspect(settings: config.Settings, a: argparse.Namespace) -> int:
    found = materialize.inspect(settings.materialized, a.source, a.path)
    body = None if a.json else found.pop("markdown", None)
    print(json.dumps(found, ensure_ascii=False, indent=2, sort_keys=True))
    if body is not None:
        print(f"\n---\n\n{body}", end="")
    return 0


def _search(spark: SparkSession, settings: config.Settings, a: argparse.Namespace) -> int:
    for hit in api.Library(spark, settings).search_docs(" ".join(a.query), a.source, a.limit).collect():
        print(f"{hit['rank'] + 1}. {hit['path']}  {hit['heading_path'] or ''}  {hit['score']:.6f}")
        print("   " + " ".join(hit["text"].split())[:SNIPPET])
    return 0


def run(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    try:
        settings = config.from_environment()
        if a.command == "inspect":
            return _inspect(settings, a)
        if a.command == "warmup":
            print(json.dumps(providers.warm_up(settings), sort_keys=True))
            return 0
        spark = SparkSession.builder.appName("quarry").getOrCreate()
        if a.command in ("sync", "index"):
            tell = (lambda _: None) if a.quiet else (lambda line: print(line, file=sys.stderr))
            result = lifecycle.sync_index(spark, settings, a.source, a.rebuild, a.dry_run, progress=tell)
            print(lifecycle.report(result))
            return result.exit_code
        if a.command == "materialize":
            return _materialize(spark, settings, a)
        if a.command == "search":
            return _search(spark, settings, a)
        with make_server(a.host, a.port, api.application(api.Library(spark, settings))) as server:
            server.serve_forever()
        return 0
    except (ValueError, OSError, RuntimeError) as e:
        print(str(e), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(run())
