"""The package for executors that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Sends the package's modules to every executor, those that join later too; returns the archive's path."""
    package = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for module in sorted(package.rglob("*.py")):
            z.write(module, module.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    return archive
