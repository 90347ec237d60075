"""The thin queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import op1_tiling, op2_secrets, op3_warc, op4_sharding, op5_quality, op6_maxent, op7_jaccard, op8_bpe, op9_fingerprint, op10_html
from .common import new_path, table


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document covers to a half or more."""
    return op1_tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the spans that ownership adds."""
    return op2_secrets.secret_report(table(spark, sf_dir, "documents"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return op3_warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in 16 shards of equal bytes; the map is stored, edited and loaded again."""
    return op4_sharding.shard_documents(table(spark, sf_dir, "documents"), maps=new_path(spark, "slot-map"))[0]


def op10_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return op10_html.extract_pages(table(spark, sf_dir, "pages"))


def op5_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels that are not held out."""
    return op5_quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return op6_maxent.score_corpus(table(spark, sf_dir, "documents"))


def op7_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their four-word shingles."""
    return op7_jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to."""
    import public_tokenizers

    return op8_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return op9_fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_string_tiling, op2_secret_scan, op3_warc_archive, op4_virtual_slots, op5_quality_score, op6_hashed_maxent, op7_count_vector_join, op8_byte_bpe, op9_canonical_digest, op10_block_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": op2_secrets.oracle(), "op3_warc_archive": op3_warc.oracle(), "op7_count_vector_join": op7_jaccard.oracle(4, 85)}
