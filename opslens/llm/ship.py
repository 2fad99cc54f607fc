"""Makes this package importable in Python workers, also where it is not installed on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hand the package's source files to the executors, once per application.

    Only code goes through the driver's own temporary folder; Spark serves it to the executors.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        path = os.path.join(tempfile.mkdtemp(prefix="code-"), "opslens_code.zip")
        with zipfile.ZipFile(path, "w") as bundle:
            for source in sorted((root / "opslens").rglob("*.py")):
                bundle.write(source, source.relative_to(root))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
