"""The package for Python workers that cannot import it themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession, force: bool = False) -> None:
    """Send the package's sources to all executors, once for an application.

    Workers start in the driver's folder (on one machine) and with its PYTHONPATH; where either has the package nothing
    is sent unless forced.
    """
    context = spark.sparkContext
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    there = any(p and Path(p).resolve() == _ROOT.parent for p in paths)
    if context.applicationId in _shipped or there and not force:
        return
    archive = Path(tempfile.mkdtemp(prefix="planloom-")) / "planloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
