"""Aggregate analytics and reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.plans.scratch import materialise

# Upper ends of the size buckets of both schemes, and their names.
SIZE_A = ((1, "1"), (5, "2-5"), (10, "6-10"), (20, "11-20"), (None, ">20"))
SIZE_B = ((5, "<=5"), (15, "6-15"), (50, "16-50"), (None, ">50"))


def success_rate(df: DataFrame, ok: Column) -> DataFrame:
    """A1: rows, successes and their share in per cent."""
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.round(100 * F.count_if(ok) / F.count("*"), 6).alias("rate"))


def breakdown(df: DataFrame, *keys: str, size: str | None = None, top: int | None = None) -> DataFrame:
    """A2, A3, A5: rows of each group, their share of all rows, bytes; largest first."""
    sums = [F.sum(size).alias("bytes")] if size else []
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    total = counted.agg(F.sum("n").alias("total"))
    out = counted.join(F.broadcast(total)).withColumn("pct", F.round(100 * F.col("n") / F.col("total"), 6)).drop("total")
    return out.orderBy(F.desc("n"), *keys).limit(top) if top else out


def rate_by(df: DataFrame, key: str, ok: Column) -> DataFrame:
    """A4: success rate by group."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(ok).alias("succeeded"), F.round(F.count_if(ok) / F.count("*"), 6).alias("rate"))


def cluster_sizes(membership: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return membership.groupBy(cluster).agg(F.count("*").alias("size"))


def size_stats(sizes: DataFrame) -> DataFrame:
    """Clusters, members, extremes, mean, both medians, spread, singletons and both singleton rates.

    The upper median is the element in the middle of the sorted sizes; it comes from the size histogram, so no
    list of sizes is gathered.
    """
    hist = sizes.groupBy("size").agg(F.count("*").alias("n"))
    run = Window.orderBy("size")  # one row for each distinct size
    placed = hist.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    upper = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("size")))
    lower = F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) / 2), F.col("size")))
    members, count = F.sum(F.col("size") * F.col("n")), F.sum("n")
    mean = members / count
    spread = F.sqrt(F.greatest(F.sum(F.pow(F.col("size").cast("double"), 2) * F.col("n")) / count - mean * mean, F.lit(0.0)))
    singles = F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("n"))), F.lit(0))
    return placed.agg(
        count.alias("clusters"), members.alias("members"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.round(mean, 6).alias("avg_size"),
        upper.alias("upper_median"), ((lower + upper) / 2).alias("median"), F.round(spread, 6).alias("std_size"), singles.alias("singletons"),
        F.round(singles / members, 6).alias("singletons_per_member"), F.round(singles / count, 6).alias("singletons_per_cluster"),
    )


def _bucket(size: Column, scheme) -> Column:
    out = F.when(size <= scheme[0][0], scheme[0][1])
    for top, name in scheme[1:-1]:
        out = out.when(size <= top, name)
    return out.otherwise(scheme[-1][1])


def size_histogram(sizes: DataFrame, scheme=SIZE_A) -> DataFrame:
    """Clusters by size bucket, empty buckets included, with their share."""
    sums = [F.coalesce(F.sum((_bucket(F.col("size"), scheme) == name).cast("long")), F.lit(0)).alias(str(i)) for i, (_, name) in enumerate(scheme)]
    row = sizes.agg(*sums, F.count("*").alias("total"))
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("bucket"), F.col(str(i)).alias("clusters")) for i, (_, name) in enumerate(scheme)]))
    return row.select(one.alias("b"), "total").select("b.bucket", "b.clusters", F.round(F.when(F.col("total") > 0, 100 * F.col("b.clusters") / F.col("total")), 6).alias("pct"))


def _families(membership: DataFrame, cluster: str, family: str) -> DataFrame:
    return membership.groupBy(cluster, family).agg(F.count("*").alias("n"))


def coherence_by_cluster(membership: DataFrame, cluster: str = "cluster_id", family: str = "brand") -> DataFrame:
    """Size, number of families, largest family and its share, and the label of every cluster."""
    per = _families(membership, cluster, family).groupBy(cluster).agg(
        F.sum("n").alias("size"), F.count("*").alias("families"), F.max("n").alias("largest_n"), F.min_by(family, F.struct(-F.col("n"), F.col(family))).alias("largest"),
    )
    label = F.when(F.col("families") == 1, "COHERENT").when(F.col("families") <= 3, "MOSTLY").otherwise("MIXED")
    return per.withColumn("largest_pct", F.round(100 * F.col("largest_n") / F.col("size"), 6)).withColumn("label", label)


def brand_coherence(membership: DataFrame, cluster: str = "cluster_id", family: str = "brand", share: float = 0.7) -> DataFrame:
    """A10: of the clusters with several members, those of one family or (from three members on) with a large majority."""
    per = coherence_by_cluster(membership, cluster, family)
    ok = (F.col("families") == 1) | ((F.col("size") > 2) & (F.col("largest_n") >= F.lit(share) * F.col("size")))
    several = F.col("size") > 1
    return per.agg(F.count_if(several).alias("clusters"), F.count_if(several & ok).alias("coherent"), F.round(F.when(F.count_if(several) > 0, F.count_if(several & ok) / F.count_if(several)), 6).alias("coherence"))


def coherence_totals(membership: DataFrame, cluster: str = "cluster_id", family: str = "brand") -> DataFrame:
    """Clusters of a single family (singletons count) and mixed ones."""
    per = coherence_by_cluster(membership, cluster, family)
    return per.agg(F.count_if(F.col("families") == 1).alias("coherent"), F.count_if(F.col("families") > 1).alias("mixed"))


def top_families(membership: DataFrame, cluster: str = "cluster_id", family: str = "brand", top: int = 10) -> DataFrame:
    """The largest families of each cluster with their rank."""
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), family))
    return _families(membership, cluster, family).withColumn("rank", rank).filter(F.col("rank") <= top)


def first_members(membership: DataFrame, k: int, cluster: str = "cluster_id", member: str = "id") -> DataFrame:
    """The first ``k`` members of each cluster in order."""
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(member))
    return membership.withColumn("rank", rank).filter(F.col("rank") <= k)


def cluster_means(members: DataFrame, measures: dict[str, Column], cluster: str = "cluster_id", top: int = 20) -> DataFrame:
    """Size and mean measures of the largest clusters."""
    means = [F.round(F.avg(c), 6).alias(n) for n, c in measures.items()]
    return members.groupBy(cluster).agg(F.count("*").alias("size"), *means).orderBy(F.desc("size"), cluster).limit(top)


def top_rows(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The ``k`` largest by a measure."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def cosine_top_pairs(df: DataFrame, value: str, k: int, node: str = "id", rows: int = 256) -> DataFrame:
    """The ``k`` pairs of largest cosine among all pairs, exactly: (id_a, id_b, cos).

    Vectors are packed in blocks of about ``rows``; a task keeps a running top ``k`` over its pairs of blocks.  Cosines count to
    12 digits, equal ones by id; vectors of length 0 have no cosine.  The work grows with the square of the rows.
    """
    kind = dict(df.dtypes)[node]
    kept = df.select(F.col(node).alias("id"), F.col(value).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    blocks = max(1, -(-kept.count() // rows))

    def pack(part: pa.Table) -> pa.Table:
        v = np.array(part.column("v").to_pylist(), "<f8")
        length = np.sqrt((v * v).sum(1))
        v = v[length > 0] / length[length > 0, None]
        ids = [x for x, n in zip(part.column("id").to_pylist(), length, strict=True) if n > 0]
        return pa.table({"block": part.column("block")[:1], "ids": pa.array([ids], pa.list_(part.column("id").type)), "unit": pa.array([v.tobytes()], pa.binary())})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, least = None, -np.inf  # the best of the block pairs so far, and what another pair must reach
        for batch in batches:
            for r in range(batch.num_rows):
                same, ids, others = batch.column(0)[r].as_py(), *(batch.column(c)[r].values for c in (1, 3))
                if not len(ids) or not len(others):
                    continue
                x, y = (np.frombuffer(batch.column(c)[r].as_py(), "<f8").reshape(n, -1) for c, n in ((2, len(ids)), (4, len(others))))
                cos = np.round(x @ y.T, 12)
                if same:
                    cos[np.tril_indices(len(ids))] = -np.inf  # a pair once, none with itself
                bound = max(least, np.partition(cos, -k, None)[-k]) if cos.size > k else least
                a, b = np.nonzero((cos >= bound) & (cos > -np.inf))  # with all that are equal to the last
                if not len(a):
                    continue
                p, q = ids.take(pa.array(a)), others.take(pa.array(b))
                first = pc.less(p, q)
                found = pa.table({"id_a": pc.if_else(first, p, q), "id_b": pc.if_else(first, q, p), "cos": cos[a, b]})
                top = pa.concat_tables([top, found]) if top else found
                top = top.sort_by([("cos", "descending"), ("id_a", "ascending"), ("id_b", "ascending")]).slice(0, k).combine_chunks()
                if top.num_rows == k:
                    least = top["cos"][-1].as_py()
        if top:
            yield from top.to_batches()

    packed = kept.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInArrow(pack, f"block long, ids array<{kind}>, unit binary")
    packed = materialise(packed, "vector-blocks")
    x, y = (packed.select(F.col("block").alias(f"block_{s}"), F.col("ids").alias(f"ids_{s}"), F.col("unit").alias(f"unit_{s}")) for s in "ab")
    pairs = x.join(y, F.col("block_a") <= F.col("block_b")).select((F.col("block_a") == F.col("block_b")).alias("same"), "ids_a", "unit_a", "ids_b", "unit_b")
    return top_rows(pairs.mapInArrow(best, f"id_a {kind}, id_b {kind}, cos double"), "cos", k, "id_a", "id_b")


def score_histogram(scores: DataFrame, score: Column, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Scores by bin of equal width; the last bin includes the upper end."""
    bin_ = F.least(F.floor((score - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return scores.filter(score.between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"))


def threshold_curve(scores: DataFrame, score: Column, thresholds: list[float]) -> DataFrame:
    """How many scores lie above each threshold, in one pass without repeating rows."""
    sums = scores.agg(*[F.count_if(score > t).alias(str(i)) for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(str(i)).alias("n")) for i, t in enumerate(thresholds)]))
    return sums.select(rows.alias("r")).select("r.*")


def quantiles(df: DataFrame, key: str, value: str, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact box-plot figures by group (counts of equal values are pre-aggregated)."""
    cols = [F.round(F.percentile(value, q), 6).alias(f"q{int(q * 100)}") for q in at]
    return df.groupBy(key).agg(F.min(value).alias("low"), *cols, F.max(value).alias("high"))


def correlations(df: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """Pearson correlation of each two columns; null unless there are more than ``least`` rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.count("*").alias("n"), *[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs]))
    return row.select("n", each.alias("x")).select("x.a", "x.b", F.when(F.col("n") > least, F.round("x.r", 6)).alias("r"))


def feature_distribution(members: DataFrame, value: Column, top: int = 10, bins: int = 10, cluster: str = "cluster_id") -> DataFrame:
    """A measure's histogram in each of the largest clusters (their ids are ``top`` rows: broadcast)."""
    largest = members.groupBy(cluster).agg(F.count("*").alias("size")).orderBy(F.desc("size"), cluster).limit(top).select(cluster)
    kept = members.join(F.broadcast(largest), cluster, "left_semi").withColumn("v__", value)
    low, high = F.min("v__").over(Window.partitionBy(cluster)), F.max("v__").over(Window.partitionBy(cluster))
    bin_ = F.when(high == low, 0).otherwise(F.least(F.floor((F.col("v__") - low) / ((high - low) / bins)), F.lit(bins - 1))).cast("int")
    return kept.withColumn("bin", bin_).groupBy(cluster, "bin").agg(F.count("*").alias("n"))


def nunique(membership: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Clusters and their mean size."""
    return cluster_sizes(membership, cluster).agg(F.count("*").alias("clusters"), F.round(F.avg("size"), 6).alias("mean_size"))


def dashboard(sizes: DataFrame) -> DataFrame:
    """Clusters, members, largest, singles and the share of members that are grouped."""
    members, singles = F.sum("size"), F.count_if(F.col("size") == 1)
    return sizes.agg(F.count("*").alias("clusters"), members.alias("members"), F.max("size").alias("largest"), singles.alias("singles"), F.round((members - singles) / members, 6).alias("grouped_share"))


def throughput(n: Column, seconds: Column, total: Column) -> tuple[Column, Column]:
    """Rows a second, and seconds left for the rest."""
    rate = F.when(seconds > 0, n / seconds)
    return rate, F.when(rate > 0, (total - n) / rate)


def principal_components(df: DataFrame, vector: str, dims: int, k: int = 2, node: str = "id") -> tuple[DataFrame, DataFrame]:
    """Projection on the first ``k`` principal components, and their explained variance.

    The covariance is one aggregation of dims**2 sums; only that small matrix is decomposed on the driver.
    """
    import numpy as np

    cells = [(i, j) for i in range(dims) for j in range(i, dims)]

    def partial(batches):
        import pyarrow as pa

        total = np.zeros(dims + len(cells))
        upper = np.triu_indices(dims)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, dims)
            total += np.concatenate([x.sum(0), (x.T @ x)[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["p", "v"])

    sums = df.select(vector).mapInArrow(partial, "p int, v double").groupBy("p").agg(F.sum("v").alias("s")).orderBy("p").collect()  # dims * (dims + 3) / 2 rows
    n = df.count()
    mean = np.array([r["s"] for r in sums[:dims]]) / max(n, 1)
    cov = np.zeros((dims, dims))
    for (i, j), r in zip(cells, sums[dims:], strict=True):
        cov[i, j] = cov[j, i] = (r["s"] - n * mean[i] * mean[j]) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    axes = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])  # the largest entry is positive
    weight = lambda c: F.array(*[F.lit(float(x)) for x in axes[:, c]])
    centred = F.zip_with(F.col(vector), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x.cast("double") - m)
    project = lambda c: F.aggregate(F.zip_with(centred, weight(c), lambda x, w: x * w), F.lit(0.0), lambda acc, x: acc + x)
    out = df.select(node, *[project(c).alias(f"pc{c + 1}") for c in range(k)])
    share = df.sparkSession.createDataFrame([(c + 1, float(values[o] / values.sum())) for c, o in enumerate(order)], "component int, explained double")
    return out, share


def report_lines(metrics: DataFrame, sizes: DataFrame, title: str = "Cluster report") -> DataFrame:
    """K3, K7: the text report as ordered lines."""
    heads = [F.lit(title), F.lit("=" * len(title))]
    figures = [F.concat(F.lit(f"{c.replace('_', ' ')}: "), F.col(c).cast("string")) for c in metrics.columns]
    top = metrics.select(F.posexplode(F.array(*heads, *figures)).alias("no", "line")).select(F.lit(0).alias("part"), "no", "line")
    hist = size_histogram(sizes)
    rank = reduce(lambda acc, x: acc.when(F.col("bucket") == x[1][1], x[0]), list(enumerate(SIZE_A))[1:], F.when(F.col("bucket") == SIZE_A[0][1], 0))
    body = hist.select(F.lit(1).alias("part"), rank.alias("no"), F.format_string("size %s: %d clusters (%.1f %%)", "bucket", "clusters", "pct").alias("line"))
    return top.unionByName(body).orderBy("part", "no").select("line")
