"""Sends the package to executors whose Python path lacks it."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession, root: str) -> None:
    """Add the package, zipped, to the session's Python files; once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_keystrata_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="keystrata-")
    archive = os.path.join(folder, "keystrata_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in os.walk(os.path.join(root, "keystrata")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(archive)
    context._keystrata_shipped = True


def shipped(root: str, query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark, root)
        return query(spark, sf_dir)

    return run
