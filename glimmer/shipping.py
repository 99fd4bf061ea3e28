"""Gives the package to Spark's Python workers where they couldn't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Once a context: a zip of this package goes to all workers, unless PYTHONPATH, which they get too, leads to it."""
    context = spark.sparkContext
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if getattr(context, "_glimmer_shipped", False) or os.path.realpath(ROOT.parent) in paths:
        return
    target = Path(tempfile.mkdtemp(prefix="glimmer-")) / "glimmer.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    context.addPyFile(str(target))
    context._glimmer_shipped = True
