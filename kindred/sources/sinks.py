"""Sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.strings import extract_domain_name


def write_clusters_csv(membership: DataFrame, path: str) -> None:
    """K1: cluster_id, domain, cluster_size."""
    membership.select("cluster_id", "domain", "cluster_size").write.option("header", True).mode("overwrite").csv(path)


def write_relations(relations: dict[str, DataFrame], path: str) -> None:
    """K2: each relation of a run (features, pairs, membership, metrics) as Parquet under its name."""
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_report(lines: DataFrame, path: str) -> None:
    """K3, K7: lines in order, as one text file (a report has a bounded number of lines)."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """K4: one JSON object a row."""
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """K4: rows as JSON texts."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def with_file_names(images: DataFrame, domain: str = "domain", extension: str = "jpg") -> DataFrame:
    """K5: a file name for every row: sanitised, the second of a name with _1, the third with _2 ..."""
    base = images.withColumn("base__", extract_domain_name(F.col(domain)))
    nth = F.row_number().over(Window.partitionBy("base__").orderBy(domain)) - 1
    suffix = F.when(F.col("nth__") > 0, F.concat(F.lit("_"), F.col("nth__"))).otherwise("")
    return base.withColumn("nth__", nth).withColumn("file_name", F.concat("base__", suffix, F.lit(f".{extension}"))).drop("base__", "nth__")


def export_images(images: DataFrame, folder: str, data: str = "content") -> DataFrame:
    """K5: write the bytes of each row under its file_name; returns name and size, one row a file.

    ``folder`` is any URI that Arrow can write to; a task that runs again writes the same files again.
    """
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for frame in frames:
            for name, body in zip(frame["file_name"], frame[data], strict=True):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(body or b"")
            yield pd.DataFrame({"file_name": frame["file_name"], "size_bytes": [len(b or b"") for b in frame[data]]})

    return images.select("file_name", data).mapInPandas(run, "file_name string, size_bytes long")


def write_stats(df: DataFrame, path: str) -> None:
    """K6: a statistics table as CSV."""
    df.coalesce(1).write.option("header", True).mode("overwrite").csv(path)
