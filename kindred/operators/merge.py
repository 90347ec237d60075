"""Capped greedy merging of singletons and threshold search."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.graph import components_with_nodes


def greedy_groups(ids: list, accepts: Callable[[int, int], bool], cap: int = 20) -> list[list]:
    """Seeds in order; each takes the later free ones that it accepts, up to ``cap`` members."""
    free, out = list(range(len(ids))), []
    while free:
        seed, rest, group = free[0], [], [ids[free[0]]]
        for i in free[1:]:
            if len(group) < cap and accepts(seed, i):
                group.append(ids[i])
            else:
                rest.append(i)
        out.append(group)
        free = rest
    return out


def merge_singletons(singles: DataFrame, accepts: Callable[[dict, dict], bool], shards: int = 1, cap: int = 20, node: str = "id") -> DataFrame:
    """Greedy merging in order of id, within shards.

    One shard is the exact sequential rule and needs all singletons in one task; ``shards`` bounds what a task
    holds, at the price that members of different shards don't meet.  Returns (id, seed): the group's first id.
    """
    kind = dict(singles.dtypes)[node]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(node).to_dict("records")
        groups = greedy_groups([r[node] for r in rows], lambda i, j: accepts(rows[i], rows[j]), cap)
        return pd.DataFrame([(m, g[0]) for g in groups for m in g], columns=["id", "seed"])

    shard = F.pmod(F.xxhash64(node), F.lit(shards))
    return singles.withColumn("shard__", shard).groupBy("shard__").applyInPandas(run, f"id {kind}, seed {kind}")


def renumbered(multi: DataFrame, merged: DataFrame) -> DataFrame:
    """Clusters 1..k: those of several members first, then the merged ones, each by smallest member."""
    both = multi.select("id", "label", F.lit(0).alias("part")).unionByName(merged.select("id", F.col("seed").alias("label"), F.lit(1).alias("part")))
    labels = both.groupBy("part", "label").agg(F.count("*").alias("size"))
    number = F.row_number().over(Window.orderBy("part", "label"))
    return both.join(labels.withColumn("cluster_id", number.cast("long")), ["part", "label"]).select("cluster_id", "id", "size")


def threshold_sweep(nodes: DataFrame, pairs: DataFrame, measure: Column, thresholds: list[float], target: int, node: str = "id") -> DataFrame:
    """Number of clusters at each threshold (pairs with measure <= t), and which is closest to ``target``.

    The thresholds share one run of the components: the nodes of each are kept apart by their names.
    """
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    name = lambda c: F.concat_ws("|", F.col("t").cast("string"), F.lpad(F.col(c).cast("string"), 20, "0"))
    keyed = nodes.select(F.col(node).alias("id"), t.alias("t")).select("t", name("id").alias("id"))
    edges = pairs.withColumn("m", measure).select("id_a", "id_b", "m", t.alias("t")).filter("m <= t").select(name("id_a").alias("a"), name("id_b").alias("b"))
    labels = components_with_nodes(keyed.select("id"), edges)
    counted = labels.withColumn("t", F.split_part("id", F.lit("|"), F.lit(1)).cast("double")).groupBy("t").agg(F.count_distinct("label").alias("clusters"))
    best = counted.agg(F.min_by("t", F.struct(F.abs(F.col("clusters") - target), "t")).alias("best"))
    return counted.join(F.broadcast(best)).select(F.col("t").alias("threshold"), "clusters", (F.col("t") == F.col("best")).alias("chosen"))
