"""The package reaches Python workers that don't start in its folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)

CODE = """
import sys
sys.path.insert(0, sys.argv[1])  # the driver knows the package, its workers don't
from pyspark.sql import SparkSession
from quarry.functions.structure import split_documents
from quarry.operators import index, search
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
files = spark.createDataFrame([("s", "a.md", "# One" + chr(10) + "plain words of a document, long enough to be kept")], "source string, path string, text string")
chunks = split_documents(files)
assert chunks.count() == 1
assert index.term_stats(index.postings(chunks)).where("term = 'plain'").first()["df"] == 1
assert len(chunks.select(search.HashingEmbedder(8).passages(chunks["text"])).first()[0]) == 8
print("worked")
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "worked" in run.stdout, run.stderr[-2000:]
