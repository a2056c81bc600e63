"""Sends this package to executors that do not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_typeweave_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="typeweave-"), "typeweave.zip")
    with zipfile.ZipFile(path, "w") as made:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    made.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)
    context._typeweave_shipped = True
