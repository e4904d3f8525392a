"""Brings this package to the Python workers of a session, and bounds what these get at a time."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows and bytes that one Arrow batch brings to a Python worker at most (a single longer text
#: still travels whole); what a kernel gives for them is some thirty times as much.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """Sets the size of Arrow batches for the session, where the caller hasn't."""
    given = spark.conf.getAll
    for key, value in _BATCHES.items():
        if key not in given:
            spark.conf.set(key, value)


def ship(spark: SparkSession) -> None:
    """Once an application, adds the package to the files that Spark hands to executors."""
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tokenloom-")) / "tokenloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
