"""Make the package importable in Python workers, as `--py-files` would."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's source files to the executors once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="loomcast-src-"), "loomcast.zip")
    root = os.path.dirname(_PACKAGE)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(_PACKAGE):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
