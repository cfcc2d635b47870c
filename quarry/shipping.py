"""The package on the executors: Python functions that run there import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a Spark context (executors that join later get it too)."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", None) is None:
        package = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(package)
        path = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry-src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)
        sc._quarry_shipped = path
    return spark
