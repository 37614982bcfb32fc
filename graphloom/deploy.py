"""Sending the package to executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

_sent: set[str] = set()


def ship(spark) -> None:
    """Once for each application, as ``spark-submit --py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "graphloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "graphloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _sent.add(context.applicationId)
