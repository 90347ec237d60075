"""Make this package importable in Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows are whole documents: a thousand of them are a batch large enough, and long texts then fit in memory.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each application; keep Arrow batches small."""
    if spark.conf.get(BATCH) == "10000":  # Spark's default; a user's own setting stays
        spark.conf.set(BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.path.join(tempfile.mkdtemp(prefix="kindred-src-"), "kindred.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(os.path.join(root, "kindred")):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        spark.sparkContext.addPyFile(path)
    return spark
