"""Shared helpers: reading tables, names that don't clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.plans.scratch import discard, materialise, new_path, scratch_dir

__all__ = ["discard", "fresh", "materialise", "new_path", "scratch_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as written by the data driver."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df`` (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
