"""``python -m kindred FOLDER OUT [--preset NAME] [--shards N]``: cluster a folder of images."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kindred.config import PRESETS, Config
from kindred.operators import reports
from kindred.plans import pipelines
from kindred.plans.ship import ship
from kindred.sources import sinks


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="kindred")
    p.add_argument("folder")
    p.add_argument("out")
    p.add_argument("--preset", choices=sorted(PRESETS), default="ultra_relaxed")
    p.add_argument("--shards", type=int, default=1, help="parts in which single images are merged greedily")
    a = p.parse_args(args)
    spark = ship(SparkSession.builder.getOrCreate())
    found = pipelines.run_clustering(spark, a.folder, Config.preset(a.preset)) if a.shards == 1 else pipelines.cluster_images(pipelines.readers.scan_images(spark, a.folder), Config.preset(a.preset), a.shards)
    sinks.write_relations(found, a.out)
    sinks.write_clusters_csv(found["membership"], f"{a.out}/clusters_csv")
    sizes = reports.cluster_sizes(found["membership"])
    sinks.write_report(reports.report_lines(found["metrics"], sizes), f"{a.out}/report")


if __name__ == "__main__":
    main()
