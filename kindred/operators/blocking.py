"""Candidate pairs by hash blocking.  Pairs have id_a < id_b and no repeats."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.plans.scratch import materialise


def _sides(df: DataFrame, node: str, *keep: str) -> tuple[DataFrame, DataFrame]:
    cols = (node, *keep)
    return tuple(df.select(*[F.col(c).alias(f"{'id' if c == node else c}_{s}") for c in cols]) for s in "ab")


def bucket_pairs(df: DataFrame, bucket: str, node: str = "id") -> DataFrame:
    """Pairs in one bucket: an equi-join, which the planner splits where a bucket is hot."""
    a, b = _sides(df, node, bucket)
    return a.join(b, (a[f"{bucket}_a"] == b[f"{bucket}_b"]) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")


def _segments(bits: int, distance: int, rows: int) -> tuple[list[tuple[int, int]], int]:
    """Segments of a word, (first bit, bit mask) from the lowest on, and how many of them must be equal."""

    def cost(r: int) -> float:
        return comb(distance + r, r) * (1 + rows / 2 ** (bits * r / (distance + r)))

    r = min(range(1, max(2, min(6, bits - distance + 1))), key=cost)
    parts = min(distance + r, bits)
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(lo, (1 << hi) - (1 << lo)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], r


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def scheme(bits: int, distance: int, rows: int) -> list[int]:
    """The bit masks that make keys: of distance + r segments r must be equal (pigeonhole), whichever they are.

    A larger r makes longer, more selective keys but more of them: the cheapest for ``rows`` words is taken.
    All choices find the same pairs.
    """
    segments, r = _segments(bits, distance, rows)
    return [_signed(sum(c)) for c in combinations([m for _, m in segments], r)]


def _first_key(mask: Column, differ: Column, segments: list[tuple[int, int]]) -> Column:
    """Whether a shared key is the one of the lowest equal segments: every segment that it skips has a differing bit.

    A few comparisons of numbers, as this is asked for each of the many keys that near words share.
    """
    none = F.lit(0).cast("long")
    has = lambda x, m: x.bitwiseAND(F.lit(_signed(m)).cast("long")) != none
    return reduce(Column.__and__, [has(mask, m) | (F.shiftrightunsigned(mask, lo) == none) | has(differ, m) for lo, m in segments])


def _literal(masks: list[int]) -> Column:
    return F.array(*[F.lit(m).cast("long") for m in masks])


def distinct_words(df: DataFrame, word: str) -> DataFrame:
    """The words of a column, each once, as a written table: however a word is made, it is made once."""
    return materialise(df.select(F.col(word).alias("w")).distinct(), "words").filter("w is not null")


def word_candidates(words: DataFrame, others: DataFrame, masks: list[int]) -> DataFrame:
    """(wa, wb, mask): pairs of a word ``w`` of each table that share a key, once for each key.

    An equi-join on keys; a key that very many words have is split by the planner's skew join.  The planner takes a
    table of keys to be as small as that of its words, though it has a row for each mask: both sides are sorted, as
    a broadcast would go through the driver.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        k = F.explode(F.transform(_literal(masks), lambda m: F.struct(m.alias("mask"), F.col("w").bitwiseAND(m).alias("val"))))
        return df.select(F.col("w").alias(name), k.alias("k")).select(name, "k.mask", "k.val")

    return keyed(words, "wa").join(keyed(others, "wb").hint("merge"), ["mask", "val"]).select("wa", "wb", "mask")


def near_words(words: DataFrame, distance: int, bits: int = 64, others: DataFrame | None = None) -> DataFrame:
    """(wa, wb, distance): all pairs of different words at most ``distance`` bits apart; wa < wb within one table."""
    rows = max(1, words.count())
    masks = scheme(bits, distance, rows)
    found = word_candidates(words, words if others is None else others, masks).filter("wa < wb" if others is None else "wa <> wb")
    differ = F.col("wa").bitwiseXOR(F.col("wb"))
    near = found.withColumn("distance", F.bit_count(differ)).filter(F.col("distance") <= distance)
    first = _first_key(F.col("mask"), differ, _segments(bits, distance, rows)[0])
    return near.filter(first).select("wa", "wb", "distance")  # of the keys they share, one counts


def _rows_of(near: DataFrame, df: DataFrame, word: str, node: str) -> DataFrame:
    """Pairs of rows for pairs of words; the rows grow with the data, so no side is broadcast."""
    x, y = df.select(F.col(node).alias("x"), F.col(word).alias("wa")), df.select(F.col(node).alias("y"), F.col(word).alias("wb"))
    return near.join(x.hint("merge"), "wa").join(y.hint("merge"), "wb").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "distance").filter("id_a < id_b")


def hamming_pairs(df: DataFrame, word: str, distance: int, bits: int = 64, node: str = "id") -> DataFrame:
    """All pairs of rows whose words are at most ``distance`` bits apart, exactly, with the distance.

    Equal words are one row in the join on keys, so copies cost nothing; they are expanded at the end.
    """
    words = distinct_words(df, word)
    unequal = _rows_of(near_words(words, distance, bits), df, word, node)
    a, b = _sides(df, node, word)
    equal = a.join(b.hint("merge"), F.col(f"{word}_a") == F.col(f"{word}_b")).filter("id_a < id_b").select("id_a", "id_b", F.lit(0).alias("distance"))
    return unequal.unionByName(equal)


def near_bucket_pairs(df: DataFrame, bucket: str, distance: int = 2, bits: int = 32, node: str = "id") -> DataFrame:
    """Pairs whose buckets differ in one to ``distance`` bits."""
    return _rows_of(near_words(distinct_words(df, bucket), distance, bits), df, bucket, node).select("id_a", "id_b")


def candidate_pairs(df: DataFrame, bucket: str, distance: int = 2, bits: int = 32, node: str = "id") -> DataFrame:
    """Pairs of one bucket or of near buckets."""
    return hamming_pairs(df, bucket, distance, bits, node).select("id_a", "id_b")


def all_pairs(df: DataFrame, node: str = "id", *keep: str) -> DataFrame:
    """J1 by brute force: for small inputs, reports and tests only."""
    a, b = _sides(df, node, *keep)
    return a.join(b, F.col("id_a") < F.col("id_b"))


def with_features(pairs: DataFrame, features: DataFrame, node: str, *keep: str) -> DataFrame:
    """The columns of both ends of each pair, with suffixes _a and _b; features grow with the data, so they aren't broadcast."""
    a, b = _sides(features, node, *keep)
    return pairs.join(a.hint("merge"), "id_a").join(b.hint("merge"), "id_b")
