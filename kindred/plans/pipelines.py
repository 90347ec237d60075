"""The reference's entry points as declarative pipelines."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.functions import brand, fusion, image, vectors
from kindred.operators import blocking, graph, merge, reports
from kindred.plans.scratch import materialise
from kindred.sources import fetch, readers, registry


def image_features(images: DataFrame) -> DataFrame:
    """Stage 3: features, brand family and industry of every image with id, domain and content."""
    made = materialise(image.with_features(images).drop("content"), "features")
    flat = made.select(*[c for c in made.columns if c != "features"], "features.*")
    return flat.withColumn("brand_family", brand.brand_family(F.col("domain"))).withColumn("industry", brand.industry(F.col("domain")))


def _orb_match(a: pd.Series, b: pd.Series) -> pd.DataFrame:

    as_array = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(-1, 32) if x is not None and len(x) else np.zeros((0, 32), np.uint8)
    return pd.DataFrame([image.match_orb(as_array(x), as_array(y)) for x, y in zip(a, b, strict=True)], columns=["good", "ratio"])


def score_pairs(pairs: DataFrame, features: DataFrame, c: Config) -> DataFrame:
    """Stage 5: the four channels, signals and weighted similarity of candidate pairs."""
    wide = blocking.with_features(pairs, features, "id", "phash_words", "color_histogram", "orb_descriptors", "dct_hash", "brand_family", "industry")
    orb = F.pandas_udf(_orb_match, "struct<good:int,ratio:double>")("orb_descriptors_a", "orb_descriptors_b")
    wide = wide.withColumn("distance", vectors.hamming_words(F.col("phash_words_a"), F.col("phash_words_b"))).withColumn("color", vectors.l1_similarity(F.col("color_histogram_a"), F.col("color_histogram_b")))
    wide = wide.withColumn("orb", orb).withColumn("dct", 1 - vectors.hamming_bits(F.col("dct_hash_a"), F.col("dct_hash_b")) / 64.0)
    same = (F.col("brand_family_a") == F.col("brand_family_b")) & (F.col("brand_family_a") != "unknown")
    wide = wide.withColumn("same_brand", same).withColumn("same_industry", (F.col("industry_a") == F.col("industry_b")) & (F.col("industry_a") != "general"))
    signals = fusion.match_signals(c.thresholds, F.col("distance"), F.col("color"), F.col("orb.good"), F.col("same_brand"))
    scored = wide.withColumn("signals", signals)
    similarity = fusion.weighted_similarity(c, F.col("distance"), F.col("color"), F.col("orb.ratio"), F.col("dct"), F.col("same_brand"), F.col("signals"))
    return scored.select("id_a", "id_b", "distance", "color", F.col("orb.good").alias("orb_good"), F.col("orb.ratio").alias("orb"), "dct", "same_brand", "same_industry", "signals", similarity.alias("similarity"))


def accepts_singleton(c: Config) -> Callable[[dict, dict], bool]:
    """P11 on feature rows, for the sequential merge."""

    def accepts(a: dict, b: dict) -> bool:
        distance = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a["phash_words"], b["phash_words"], strict=True))
        if distance <= c.merge_phash or 1 - np.abs(np.array(a["color_histogram"]) - np.array(b["color_histogram"])).sum() / 2 >= c.merge_color:
            return True
        if (a["brand_family"] == b["brand_family"] != "unknown") or (a["industry"] == b["industry"] != "general"):
            return True
        as_array = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(-1, 32) if len(x) else np.zeros((0, 32), np.uint8)
        return image.match_orb(as_array(a["orb_descriptors"]), as_array(b["orb_descriptors"]))[1] >= c.merge_orb

    return accepts


def cluster_images(images: DataFrame, c: Config | None = None, shards: int = 1) -> dict[str, DataFrame]:
    """Entry A: images (id, domain, content) to features, pairs, membership and metrics."""
    c = c or Config()
    features = image_features(images)
    good = features.filter("valid")
    keyed = good.select("id", F.get("phash_words", F.lit(0)).alias("bucket"))
    pairs = materialise(score_pairs(blocking.candidate_pairs(keyed, "bucket", c.bucket_bits, 32), good, c), "pairs")
    cut = materialise(graph.single_linkage_cut(good, pairs, c.cut_distance, "id", "id_a", "id_b"), "cut")
    sizes = cut.groupBy("label").agg(F.count("*").alias("size"))
    singles = cut.join(sizes.filter("size = 1").select("label"), "label", "left_semi").select("id")
    merged = merge.merge_singletons(good.join(singles, "id", "left_semi").select("id", "phash_words", "color_histogram", "orb_descriptors", "brand_family", "industry"), accepts_singleton(c), shards, c.merge_cap)
    multi = cut.join(sizes.filter("size > 1").select("label"), "label", "left_semi")
    membership = materialise(merge.renumbered(multi, merged).join(good.select("id", "domain", F.col("brand_family").alias("brand")), "id").withColumnRenamed("size", "cluster_size"), "membership")
    return {"features": features, "pairs": pairs, "membership": membership, "metrics": reports.size_stats(reports.cluster_sizes(membership))}


def run_clustering(spark: SparkSession, folder: str, c: Config | None = None) -> dict[str, DataFrame]:
    """Entry A from a folder of image files."""
    return cluster_images(readers.scan_images(spark, folder), c)


def _lagged(a: pd.Series, b: pd.Series) -> pd.Series:

    return pd.Series([image.correlation_max(np.asarray(x), np.asarray(y)) for x, y in zip(a, b, strict=True)])


def _keypoints(sa: pd.Series, sb: pd.Series, oa: pd.Series, ob: pd.Series) -> pd.DataFrame:

    floats = lambda x: np.array([np.asarray(r) for r in x]).reshape(-1, 128)
    octets = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(-1, 32) if len(x) else np.zeros((0, 32), np.uint8)
    return pd.DataFrame([(image.match_sift(floats(p), floats(q)), image.match_orb(octets(r), octets(s))[1]) for p, q, r, s in zip(sa, sb, oa, ob, strict=True)], columns=["sift", "orb"])


def research_measures(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """All measures of the research path for pairs of images, and its decision."""
    names = ["phash", "fft_features", "fmt_signature", "color_aware_fmt", "saliency_weighted_fft", "hu_moments", "zernike_moments", "deep_fused_hash", "color_vector", "sift_signature", "orb_signature", "sift_descriptors", "orb_descriptors"]
    w = blocking.with_features(pairs, features, "id", *names)
    end = lambda n: (F.col(f"{n}_a"), F.col(f"{n}_b"))
    cos = lambda n: F.coalesce(vectors.cosine(*end(n)), F.lit(0.0))
    w = w.withColumn("fused_distance", vectors.hamming_vector(*end("deep_fused_hash"))).withColumn("phash_distance", vectors.hamming_bits(*end("phash")))
    points = F.pandas_udf(_keypoints, "struct<sift:double,orb:double>")
    w = w.withColumn("fmt", F.pandas_udf(_lagged, "double")("fmt_signature_a", "fmt_signature_b")).withColumn("points", points("sift_descriptors_a", "sift_descriptors_b", "orb_descriptors_a", "orb_descriptors_b"))
    w = w.withColumns({"fft": cos("fft_features"), "color_fmt": cos("color_aware_fmt"), "saliency": cos("saliency_weighted_fft"), "hu": cos("hu_moments"), "zernike": cos("zernike_moments"), "color_distance": vectors.euclidean(*end("color_vector"))})
    w = w.withColumns({"sift": F.greatest(F.col("points.sift"), cos("sift_signature")), "orb": F.greatest(F.col("points.orb"), cos("orb_signature"))})
    calibrated = fusion.calibrated_fusion(1 - F.col("fused_distance") / 64, 1 - F.col("phash_distance") / 64, F.greatest(F.lit(0.0), "fft"), F.greatest(F.lit(0.0), "hu"), F.col("color_distance"))
    w = w.withColumn("calibrated", calibrated)
    measures = {k: F.col(k) for k in ("fft", "fmt", "color_fmt", "saliency", "hu", "zernike", "sift", "orb", "calibrated")} | {"fused": F.col("fused_distance") / 64, "phash": F.col("phash_distance")}
    votes = fusion.channel_votes(measures)
    channels = [F.col(k) for k in ("fft", "fmt", "color_fmt", "saliency", "hu", "zernike", "sift", "orb")]
    return w.select(
        "id_a", "id_b", "fused_distance", "phash_distance", *[k for k in measures if k not in ("fused", "phash")], "color_distance",
        fusion.confidence(votes).alias("confidence"), fusion.decision_tree(votes, F.col("calibrated")).alias("similar"), fusion.composite_score(F.col("calibrated"), *channels).alias("score"),
    )


def cluster_research(images: DataFrame, least: float = 0.7, most_color: float = 0.20) -> dict[str, DataFrame]:
    """Entry B: research features, pairs by composite score, colour-gated components.

    It compares all pairs, as the method demands; for large inputs block first and call research_measures.
    """
    made = materialise(image.with_features(images, image.g2_features, image.G2_SCHEMA).select("id", "domain", "features.*"), "research-features")
    good = made.filter("valid")
    measured = materialise(research_measures(blocking.all_pairs(good.select("id"), "id"), good), "research-pairs")
    near = measured.filter((F.col("score") >= least) & F.col("similar"))
    edges = near.filter(fusion.color_gate(F.col("color_distance"), most_color))
    blocked = near.agg(F.count_if(~fusion.color_gate(F.col("color_distance"), most_color)).alias("blocked"))
    return {"features": made, "pairs": measured, "membership": graph.components_with_nodes(good, edges, "id", "id_a", "id_b"), "blocked": blocked}


def extract_images(sites: DataFrame, sources: DataFrame, fetcher=fetch.http_fetch, target: float = 98.0, max_tier: int = 7, least_bytes: int = 500) -> DataFrame:
    """Entry C: tiered fetching, then another try of the failures over the direct addresses if the rate is too low."""
    first = materialise(fetch.fetch_tiered(registry.requests(sites, sources, "domain", max_tier), fetcher, least_bytes), "fetched")
    rate = first.agg(100 * F.avg(F.col("success").cast("double"))).first()[0]
    if rate is None or rate >= target:
        return first
    failed = first.filter("not success").select("domain")
    probes = sites.sparkSession.createDataFrame([(i, f"probe {i}", u, {}, {}, 8, 1, "http") for i, u in enumerate(registry.PROBES)], registry.SCHEMA)
    again = fetch.fetch_tiered(registry.requests(failed, probes), fetcher, 300)
    from kindred.operators.fallback import recovered

    return recovered(first, again)


def page_candidates(pages: DataFrame, cache: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Entry D: image candidates of pages; pages that a live cache knows are answered from it."""
    from kindred.functions.html import candidates

    fresh = pages if cache is None else pages.join(readers.live_cache(cache, now).select("url"), "url", "left_anti")
    found = fresh.select("url", candidates(F.col("html"), F.col("url")).alias("candidates"), F.lit(False).alias("cached"))
    if cache is None:
        return found
    return found.unionByName(readers.live_cache(cache, now).join(pages.select("url"), "url", "left_semi").select("url", "candidates", "cached"))
