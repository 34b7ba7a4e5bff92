"""Making this package importable where tasks run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_quantloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    d = tempfile.mkdtemp(prefix="quantloom-code-")  # the driver serves the archive from here while it runs
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    stage = Path(d, "stage")
    shutil.copytree(top, stage / top.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(d, f"{top.name}-{uuid.uuid4().hex[:8]}"), "zip", stage))
    sc._quantloom_shipped = True
