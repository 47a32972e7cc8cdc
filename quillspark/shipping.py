"""Sends this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()

#: Rows and bytes of an Arrow batch, at most: what a task holds twice on either side of the pipe to Python.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``; smaller settings stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> None:
    """Once for each application: the package's modules as a zip by the engine's own file distribution. Each time, the
    session's Arrow batches are bounded."""
    bound_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quillspark-"), "quillspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
