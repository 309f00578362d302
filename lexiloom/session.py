"""What a session needs to run the library's Python on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, unless their PYTHONPATH or working folder has it."""
    context = spark.sparkContext
    seen = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    if _ROOT in seen or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    path = os.path.join(tempfile.mkdtemp(), "lexiloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(_ROOT, "lexiloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, _ROOT))
    context.addPyFile(path)
