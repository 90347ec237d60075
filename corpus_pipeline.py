"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

quality classifier -> shingle-set join -> benchmark decontamination -> secret scan -> byte-level BPE
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import op1_tiling, op2_secrets, op5_quality, op7_jaccard, op8_bpe
from kindred.llm.common import materialise, table
from kindred.plans.ship import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (0.7 or more); null and empty texts are judged like any other.

    Repeated rows are judged alike; all columns stay, whatever their names; no documents give no documents.
    """
    return op5_quality.keep_good(docs, table(ship(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles: that of the smallest id.

    Null and empty texts are nobody's copies; rows without an id stay; rows that repeat an id are one document.
    """
    ship(spark)
    return op7_jaccard.keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to a half or more.

    Null and empty texts cover nothing; repeated rows are judged alike; an empty benchmark removes nothing.
    """
    return op1_tiling.decontaminate(docs, table(ship(spark), sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that aren't widely copied examples masked.

    Null texts stay null; a row is masked at the spans of its own text, also where ids repeat or are null.
    """
    return op2_secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with their digests; a null text is an empty one, without ids."""
    import public_tokenizers

    ship(spark)
    return op8_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]

#: SQL can't express the trained classifier nor the encoder; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
