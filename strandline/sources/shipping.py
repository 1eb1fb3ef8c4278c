"""Brings this package to the executors, so that a session needs no installed copy on them."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import strandline

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application. Spark itself hands the file on."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(strandline.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="strandline-"), "strandline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
