"""Scans and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.strings import cache_key

# Names of the website column, in order of preference, and what a name may contain.
WEBSITE_NAMES = ("website", "url", "domain", "site", "link")
WEBSITE_PARTS = ("web", "url", "domain")
STRICT_NAMES = ("domain", "website", "url", "site", "host")


def website_column(df: DataFrame, strict: bool = False) -> str:
    """Which column holds the sites.  Decided on the schema alone.

    ``strict`` knows only the strict list and raises if none of it is there.
    """
    if strict:
        for name in STRICT_NAMES:
            if name in df.columns:
                return name
        raise ValueError(f"no website column among {df.columns}")
    for name in WEBSITE_NAMES:
        if name in df.columns:
            return name
    return next((c for c in df.columns if any(p in c.lower() for p in WEBSITE_PARTS)), df.columns[0])


def sites(df: DataFrame, strict: bool = False) -> DataFrame:
    """The website column as ``domain``, nulls dropped."""
    return df.select(F.col(f"`{website_column(df, strict)}`").cast("string").alias("domain")).filter("domain is not null")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file with a website column, or a text file with one site a line."""
    if path.endswith((".txt", ".list")):
        return spark.read.text(path).select(F.trim("value").alias("domain")).filter("domain <> ''")
    return sites(spark.read.parquet(path))


def sample_by_hash(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), chosen by a seeded hash of the keys: the same on every run and cluster."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys or df.columns]))
    return df.orderBy(h, *(keys or df.columns)).limit(n)


def distinct_sample(df: DataFrame, n: int, column: str, seed: int = 42) -> DataFrame:
    """S3: ``n`` of the distinct values that aren't null."""
    return sample_by_hash(df.select(column).filter(F.col(column).isNotNull()).distinct(), n, column, seed=seed)


def head_sites(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` sites in a fixed order."""
    return df.filter(F.col(order).isNotNull()).orderBy(order).limit(n)


def sample_sites(spark: SparkSession) -> DataFrame:
    """A built-in list, for trying things out."""
    names = "google.com youtube.com apple.com jpmorgan.com microsoft.com ebay.com ebay.co.uk amazon.com github.com wikipedia.org example.org"
    return spark.createDataFrame([(n,) for n in names.split()], "domain string")


def with_image_names(files: DataFrame, path: Column) -> DataFrame:
    """File name, and the domain as its stem."""
    name = F.element_at(F.split(path, "/"), -1)
    return files.withColumn("filename", name).withColumn("domain", F.regexp_replace(name, r"\.[^.]*$", ""))


JPEG = r"(?i)\.jpe?g$"


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): JPEG files decoded by Spark's own image source, in the JVM, as PNG bytes; broken ones are empty."""
    found = spark.read.format("image").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").option("recursiveFileLookup", True).load(folder)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from kindred.functions.image import encode_png

        for batch in batches:
            out = []
            for h, w, n, data in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                out.append(encode_png(np.frombuffer(data, np.uint8).reshape(h, w, n)) if h > 0 and n in (1, 3, 4) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return found.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, "path string, content binary")


def scan_images(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,JPG,JPEG,png,PNG}") -> DataFrame:
    """Image files as bytes with name, domain and size; a stable id from the path.

    JPEG files come decoded, as PNG bytes.  Bytes are only read for the columns that are asked for.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    named = with_image_names(files, F.col("path"))
    rows = named.select(F.xxhash64("path").alias("id"), F.col("path").alias("filepath"), "filename", "domain", F.col("length").alias("size_bytes"), "content")
    is_jpeg, plain_path = F.col("filepath").rlike(JPEG), lambda c: F.regexp_replace(c, "^([a-z]+):/+", "$1:/")
    jpeg = rows.filter(is_jpeg).drop("content").withColumn("path__", plain_path(F.col("filepath")))
    decoded = _decoded(spark, folder).select(plain_path(F.col("path")).alias("path__"), "content")
    return rows.filter(~is_jpeg).unionByName(jpeg.join(decoded, "path__", "left").drop("path__"))


def data_size(files: DataFrame) -> DataFrame:
    """Files and bytes."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def read_clusters_csv(spark: SparkSession, path: str) -> DataFrame:
    """A cluster table written as CSV."""
    return spark.read.option("header", True).schema("cluster_id int, domain string, cluster_size int").csv(path)


def read_skip_list(spark: SparkSession, path: str) -> DataFrame:
    """Domains to skip, from a JSON configuration."""
    return spark.read.option("multiLine", True).schema("skip_problematic_domains array<string>").json(path).select(F.explode("skip_problematic_domains").alias("domain"))


def cache_hits(wanted: DataFrame, cache: DataFrame, domain: str = "domain") -> tuple[DataFrame, DataFrame]:
    """Rows that the cache answers, and those it doesn't."""
    keyed = wanted.withColumn("cache_key", cache_key(F.col(domain)))
    return keyed.join(cache.drop(domain), "cache_key"), keyed.join(cache, "cache_key", "left_anti")


def cache_rows(results: DataFrame, domain: str = "domain") -> DataFrame:
    """What goes into the cache: successes that have data."""
    return results.filter("success and data is not null").withColumn("cache_key", cache_key(F.col(domain)))


def live_cache(cache: DataFrame, now: Column | None = None, ttl_seconds: int = 86_400) -> DataFrame:
    """Entries that haven't expired, marked as cached."""
    age = F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp("written_at")
    return cache.filter(age < ttl_seconds).withColumn("cached", F.lit(True))
