"""Give the Python tasks of a session this package, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_given: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors as a zip (``addPyFile``), once per application: functions
    run in tasks are looked up by name there."""
    context = spark.sparkContext
    if context.applicationId in _given:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    archive.write(full, os.path.join(name, os.path.relpath(full, root)))
    context.addPyFile(path)
    _given.add(context.applicationId)
