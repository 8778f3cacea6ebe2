"""Ships this package to the executors, for clusters where it isn't installed on every node."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()

#: Bytes that go to a Python worker at a time, where the session doesn't say: texts are long, and batches of the
#: default size would be held several times over.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Add the package to the job's Python files, once an application, and bound the batches that go to Python."""
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="gleaner-ship-"), "gleaner.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("gleaner", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
