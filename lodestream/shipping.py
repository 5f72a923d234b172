"""Getting this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once an application, so that workers need no path of their own to it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # not when this runs from the shipped archive itself
        archive = Path(tempfile.mkdtemp(prefix="spark-lodestream-")) / "lodestream.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, str(f.relative_to(package.parent)))
        context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
