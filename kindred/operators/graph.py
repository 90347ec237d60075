"""Graph operators over edge tables: connected components without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.plans.scratch import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it.  Edges have u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, label): for each node of an edge its component's smallest node.

    Large-star and small-star steps alternate until nothing changes, which takes a number of rounds that grows
    with the logarithm of the component size.  Each round is written to the shared folder.  Loops and repeated
    edges are fine; nodes without edges don't appear; null ends are dropped.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    ends = materialise(ends.filter("x and y").drop("x", "y").distinct(), "cc-edges")  # the pairs are made once
    loops = ends.filter("u = v").select(F.col("u").alias("id"), F.col("v").alias("label"))
    state = ends.filter("u > v")
    mark = None
    for _ in range(max_rounds):
        new = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        state = materialise(_small_star(_large_star(state)), "cc-round")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = state.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(state.select(F.col("v").alias("id"), F.col("v").alias("label"))).unionByName(loops)
    return found.groupBy("id").agg(F.min("label").alias("label"))


def components_with_nodes(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """Components including the nodes without edges, which label themselves (union-find's get_components)."""
    labels = connected_components(edges, a, b)
    return nodes.select(F.col(node).alias("id")).distinct().join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def clusters(membership: DataFrame, id_col: str = "id", label: str = "label", min_size: int = 1) -> DataFrame:
    """Cluster table: number by size and then smallest member, size, members in order, representative."""
    grouped = membership.groupBy(label).agg(F.count("*").alias("size"), F.sort_array(F.collect_list(id_col)).alias("members"), F.min(id_col).alias("representative"))
    order = Window.orderBy(F.desc("size"), "representative")
    return grouped.filter(F.col("size") >= min_size).withColumn("cluster_id", F.row_number().over(order).cast("long")).select("cluster_id", "size", "members", "representative")


def single_linkage_cut(nodes: DataFrame, scored: DataFrame, max_distance: float = 0.85, node: str = "id", a: str = "a", b: str = "b", similarity: str = "similarity") -> DataFrame:
    """Flat single-linkage clusters at ``max_distance``: components of the pairs at most that far apart.

    Pairs that were never compared are at distance 1, as in the reference's sparse matrix.
    """
    near = scored.filter(F.col(similarity) >= F.lit(1 - max_distance - 1e-12))
    return components_with_nodes(nodes, near, node, a, b)
