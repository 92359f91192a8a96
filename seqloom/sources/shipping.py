"""Sends this package to the executors, so that Python workers can import it wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Once a context."""
    sc = spark.sparkContext
    if not getattr(sc, "_seqloom_shipped", False):
        package = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="seqloom-")) / "seqloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(path))
        sc._seqloom_shipped = True
    return spark
