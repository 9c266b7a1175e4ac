"""Sends this package to the Python workers, for drivers that have it only on their own path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's zip file once to each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    here = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="sievework-")) / "sievework.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(str(path))
    _sent.add(context.applicationId)
