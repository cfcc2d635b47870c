"""Embedding and re-ranking models as plug-ins, search settings, and a floor under the quality of retrieval."""

from __future__ import annotations

import sys
from dataclasses import replace

import pytest

from quarry import api, config
from quarry.__main__ import run
from quarry.operators import lifecycle, providers, search

MODEL = '''
loads = []

def embedder():
    loads.append(1)
    def embed(texts):
        return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]
    return embed

def judge():
    return lambda query, texts: [float(t.count("wanted")) for t in texts]
'''

#: query, expected path: each in words that another file has too.
GOLDEN = [
    ("how long does a message live in the queue", "queue/ttl.md"),
    ("x-dead-letter", "queue/dead.md"),
    ("retry a failed task with backoff", "tasks/retry.md"),
    ("acks_late", "tasks/acks.md"),
    ("restore a backup of the database", "db/backup.md"),
    ("create an index without locking writes", "db/index.md"),
    ("rotate the certificate of the proxy", "proxy/tls.md"),
]
FILES = {
    "queue/ttl.md": "# Message lifetime\n\nA message can live in the queue for a limited time. When the time is over the queue drops it.",
    "queue/dead.md": "# Dropped messages\n\nSet x-dead-letter to keep a message which the queue would drop. Letters of the dead exchange arrive there.",
    "tasks/retry.md": "# Retry\n\nA failed task is tried again with exponential backoff. The backoff doubles for each retry of the task.",
    "tasks/acks.md": "# Acknowledgement\n\nWith acks_late a task is acknowledged after it ran. Late acks let a message run twice.",
    "db/backup.md": "# Backup\n\nDump the database every night. To restore a backup, stop all writes and load the dump into an empty database.",
    "db/index.md": "# Index\n\nCreate an index concurrently to avoid locking writes. A plain index build locks the table of the database.",
    "proxy/tls.md": "# Certificates\n\nThe proxy reads its certificate at start. To rotate it, replace the file and reload the proxy.",
}


def test_model_embedder(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    e = providers.ModelEmbedder("test-lengths", load, instruction="query: ", batch=2)
    assert e.dim == 2
    assert e.query("abc") == [10.0, 1.0]  # the instruction is put before queries
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "abcde"), (5, "abc")], "id long, text string")
    got = {r["id"]: list(r["v"]) for r in rows.select("id", e.passages(rows["text"]).alias("v")).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0], 4: [5.0, 1.0], 5: [3.0, 1.0]}  # and not before passages
    assert rows.limit(0).select(e.passages(rows["text"])).collect() == []


@pytest.mark.parametrize("vector", [[float("nan"), 1.0], [float("inf"), 1.0], [1.0]])
def test_bad_vectors_are_refused(spark, vector):
    def load():
        return lambda texts: [[0.0, 0.0] if t == "probe" else vector for t in texts]

    e = providers.ModelEmbedder(f"test-bad-{vector}", load)
    rows = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match="gave no finite vector"):
        rows.select(e.passages(rows["text"])).collect()


def test_loaded_once():
    calls = []
    for _ in range(3):
        providers.loaded("test-once", lambda: calls.append(1) or "model")
    assert calls == [1]


def test_model_scorer_changes_the_order(spark):
    chunks = spark.createDataFrame([("a", 1, "a.md", "alpha alpha beta"), ("a", 2, "b.md", "alpha wanted")], "source string, chunk_id long, path string, text string")

    def load():
        return lambda query, texts: [float("wanted" in t) for t in texts]

    judge = providers.model_scorer("test-judge", load)
    assert search.search(chunks, None, "beta alpha").orderBy("rank").first()["chunk_id"] == 1
    assert search.search(chunks, None, "beta alpha", scorer=judge("beta alpha")).orderBy("rank").first()["chunk_id"] == 2


def test_named_providers(spark, tmp_path, monkeypatch):
    (tmp_path / "quarry_test_model.py").write_text(MODEL)
    monkeypatch.syspath_prepend(str(tmp_path))
    s = config.from_environment({"QUARRY_EMBEDDER": "quarry_test_model:embedder", "QUARRY_RERANKER": "quarry_test_model:judge", "QUARRY_W_DENSE": "0.5", "QUARRY_CANDIDATES": "7"})
    assert (s.w_dense, s.candidates) == (0.5, 7)
    assert providers.warm_up(s) == {"embedder": "quarry_test_model:embedder", "dim": 3, "reranker": "quarry_test_model:judge"}
    assert sys.modules["quarry_test_model"].loads == [1]
    for bad in ("nowhere", "quarry_test_model:absent", "no_such_module_at_all:f"):
        with pytest.raises(ValueError):
            providers.embedder(replace(s, embedder=bad))
    assert lifecycle.pipeline_fingerprint(s) != lifecycle.pipeline_fingerprint(replace(s, embedder=""))


def test_warmup_command(monkeypatch, capsys):
    monkeypatch.delenv("QUARRY_EMBEDDER", raising=False)
    monkeypatch.delenv("QUARRY_RERANKER", raising=False)
    assert run(["warmup"]) == 0
    assert '"embedder": "hashing"' in capsys.readouterr().out


def test_retrieval_floor(spark, tmp_path):
    """Mean reciprocal rank of a golden set over a published index."""
    for path, text in FILES.items():
        (tmp_path / "docs" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / path).write_text(text)
    (tmp_path / "sources.toml").write_text(f'version = 1\n\n[[source]]\nname = "m"\ntype = "local"\npath = "{tmp_path / "docs"}"\n')
    settings = config.Settings(sources_config=str(tmp_path / "sources.toml"), state_dir=str(tmp_path / "state"))
    assert lifecycle.sync_index(spark, settings).exit_code == 0
    library = api.Library(spark, settings)
    found = []
    for query, expected in GOLDEN:
        paths = [r["path"] for r in library.search_docs(query, "m", 10).collect()]
        found.append(1 / (paths.index(expected) + 1) if expected in paths else 0.0)
    assert sum(found) / len(found) >= 0.85, found
    with pytest.raises(ValueError, match="another width"):
        api.Library(spark, replace(settings, embedding_dim=32)).search_docs("message", "m")
