"""Makes the package importable in the Python workers of every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send the package's source files along with the session's tasks, once a session."""
    context = spark.sparkContext
    if getattr(context, "_clientela_sent", None):
        return
    target = os.path.join(tempfile.mkdtemp(), "clientela_package.zip")  # read by the driver alone
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in sorted(os.walk(PACKAGE)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    context.addPyFile(target)
    context._clientela_sent = True
