"""Prepares a session: the package's sources on the executors, and Arrow batches small enough for workers with little memory."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Rows of an Arrow batch, where the session doesn't say: documents of a few KB make batches of a few MB.
BATCH_ROWS = "2000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once an application, and bounds its Arrow batches."""
    if spark.conf.get(_BATCH) == "10000":  # Spark's own default
        spark.conf.set(_BATCH, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="credal-"), "credal_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith((".py", ".json", ".csv")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("credal", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
