"""Making this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkContext

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship() -> None:
    """Send the package to the workers of the running context, once, unless their path names it already."""
    context = SparkContext._active_spark_context
    if context is None or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if ROOT in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(ROOT, "textloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
