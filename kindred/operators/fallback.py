"""Fallback routing over a table of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without nulls in the columns."""
    return df.na.drop(subset=list(columns))


def size_gate(data: Column, least: int, content_type: Column | None = None) -> Column:
    """Large enough and, if a type is given, an image or plain bytes."""
    ok = F.length(data) > least
    return ok if content_type is None else ok & F.lower(content_type).rlike("image/|application/octet-stream")


def first_success(attempts: DataFrame, key: str = "domain", order: tuple[str, ...] = ("tier", "pos"), ok: str = "success", max_tier: int | None = None) -> DataFrame:
    """Of each key's successful attempts the first in order, with how many attempts of its tiers were made.

    One aggregation with partial results: no key's attempts need to be gathered, however many there are.
    """
    rows = attempts if max_tier is None else attempts.filter(F.col("tier") <= max_tier)
    rest = [c for c in rows.columns if c not in (key, *order, ok)]
    place = F.struct(*order, *rest)
    best = rows.groupBy(key).agg(F.min(F.when(F.col(ok), place)).alias("best"), F.count("*").alias("n_tried"))
    return best.select(key, F.col("best").isNotNull().alias("success"), *[F.col("best")[c].alias(c) for c in (*order, *rest)], "n_tried")


def with_attempts(won: DataFrame, tiers: DataFrame) -> DataFrame:
    """Attempts are the sources of all tiers up to the one used; of all tiers where none succeeded.

    ``tiers`` (tier, n_up_to) has a row for each tier: a fixed few, so it is broadcast.
    """
    few = F.broadcast(tiers.select("tier", F.col("n_up_to").alias("attempts")))
    total = tiers.agg(F.max("n_up_to").alias("all_tiers"))
    joined = won.join(few, "tier", "left").join(F.broadcast(total))
    return joined.withColumn("attempts", F.coalesce("attempts", "all_tiers")).drop("all_tiers")


def priority_list(attempts: DataFrame, listed: list[str], key: str = "domain", extra: int = 10, last: str = "dns") -> DataFrame:
    """First the listed sources in their order, then at most ``extra`` others by position, then ``last``."""
    place = F.array_position(F.array(*map(F.lit, listed)), F.col("source"))
    group = F.when(F.col("source") == last, 2).when(place > 0, 0).otherwise(1)
    ranked = attempts.withColumn("group", group).withColumn("place", F.when(place > 0, place).otherwise(F.col("pos")))
    nth = F.row_number().over(Window.partitionBy(key, "group").orderBy("place", "source"))
    kept = ranked.withColumn("nth", nth).filter(f"group <> 1 or nth <= {extra}").drop("nth")
    return first_success(kept, key, ("group", "place"))


def shuffled_retry(attempts: DataFrame, key: str = "domain", seed: int = 0, chunk: int = 5) -> DataFrame:
    """Every source in a seeded order that differs by key, in chunks; the chunk of the first success."""
    mixed = attempts.withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("source"))))
    place = F.row_number().over(Window.partitionBy(key).orderBy("draw", "source"))
    numbered = mixed.withColumn("place", place).drop("draw")
    won = first_success(numbered, key, ("place",))
    return won.withColumn("attempts", F.least(F.ceil(F.coalesce("place", "n_tried") / chunk) * chunk, "n_tried").cast("long"))


def recovered(base: DataFrame, retry: DataFrame, key: str = "domain") -> DataFrame:
    """Where the retry succeeded its row replaces the failed one."""
    values = [c for c in base.columns if c != key]
    better = retry.filter("success").select(key, *[F.col(c).alias(f"retry_{c}") for c in values])
    joined = base.join(better, key, "left")
    use = ~F.col("success") & F.coalesce("retry_success", F.lit(False))
    return joined.select(key, *[F.when(use, F.col(f"retry_{c}")).otherwise(F.col(c)).alias(c) for c in values], use.alias("recovered"))


def needs_recovery(base: DataFrame, below: float = 98.0) -> DataFrame:
    """R8's gate: whether the success rate is below the target."""
    rate = 100 * F.avg(F.col("success").cast("double"))
    return base.agg(rate.alias("success_rate"), F.coalesce(rate < below, F.lit(False)).alias("retry"))


def hybrid(first: DataFrame, second: DataFrame, key: str = "domain") -> DataFrame:
    """Successes of the first way, and the second way's rows for all other keys."""
    good = first.filter("success")
    return good.unionByName(second.join(good.select(key), key, "left_anti"), allowMissingColumns=True)


def without(df: DataFrame, skip: DataFrame, key: str = "domain") -> DataFrame:
    """Rows whose key isn't listed."""
    return df.join(skip, key, "left_anti")


def quality_gate(rate: Column) -> Column:
    """Label of a success rate."""
    return F.when(rate >= 98, "excellent").when(rate >= 97, "very good").when(rate >= 95, "good").when(rate >= 90, "fair").otherwise("poor")


def compare_tiers(attempts: DataFrame, limits: tuple[int, ...] = (3, 5, 7), key: str = "domain") -> DataFrame:
    """Success rate with the tiers up to each limit, and which limit is best (the lowest of equals)."""
    keys = attempts.select(key).distinct().withColumn("max_tier", F.explode(F.array(*map(F.lit, limits))))
    tier = attempts.filter("success").groupBy(key).agg(F.min("tier").alias("first_tier"))
    rates = keys.join(tier, key, "left").groupBy("max_tier").agg(F.count("*").alias("n"), F.count_if(F.col("first_tier") <= F.col("max_tier")).alias("found"))
    best = rates.agg(F.max_by("max_tier", F.struct("found", -F.col("max_tier"))).alias("best_tier"))
    return rates.join(F.broadcast(best)).select("max_tier", "n", "found", (F.col("max_tier") == F.col("best_tier")).alias("best"))
