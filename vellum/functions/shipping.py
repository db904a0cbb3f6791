"""Python functions inside tasks: the executors need this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "vellum-library.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted((root / "vellum").rglob("*.py")):
            z.write(file, file.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
