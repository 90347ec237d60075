"""Intermediate tables in the shared folder: how lineage is cut so that a lost executor costs no rerun."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one where that is unset, on one machine only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir is unset on {master}: a folder that all executors share is needed")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="kindred-")
        atexit.register(shutil.rmtree, _own_scratch[app], True)
    return "file://" + _own_scratch[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the scratch folder that nothing else uses."""
    return f"{scratch_dir(spark)}/kindred/{label}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Let the driver notice which shuffles nothing refers to any more, so that their files go.

    Executors delete shuffle files only when the driver collects its garbage, which a quiet driver seldom does.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    Survives lost executors, unlike localCheckpoint, and each later action reuses the result.  ``free`` after a
    large step lets the shuffle files of finished steps go.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    if free:
        tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialise`` that no later step reads."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
