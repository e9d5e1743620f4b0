"""Ships this package to executors that do not have it installed."""

from __future__ import annotations

import importlib.util
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED = "groundwell.shipped"


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once for each application."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.abspath(importlib.util.find_spec("groundwell").origin))
    path = os.path.join(tempfile.mkdtemp(prefix="groundwell-src-"), "groundwell-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("groundwell", os.path.relpath(full, root)))
    context.addPyFile(path)
    setattr(context, _SHIPPED, True)
