"""Lets Python workers import this package wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_sent: set[str] = set()


def _archive() -> str:
    """The package as an archive, made on the driver."""
    path = os.path.join(tempfile.mkdtemp(prefix="sieveline-"), "sieveline.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(ROOT, "sieveline")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, ROOT))
    return path


def reachable(spark: SparkSession) -> None:
    """Local workers take the driver's path; executors elsewhere are sent the package, once a context."""
    context = spark.sparkContext
    have = context.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    if not context.master.startswith("local[") and context.applicationId not in _sent:
        _sent.add(context.applicationId)
        context.addPyFile(_archive())
