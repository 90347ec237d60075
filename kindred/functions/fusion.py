"""Weighted fusion and decisions over pair measures as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.config import Config, Thresholds
from kindred.functions.vectors import hash_similarity


def or_rule(distance: Column, fft: Column, fmt: Column, bits: int = 6, fft_least: float = 0.985, fmt_least: float = 0.995) -> Column:
    """One of three transform measures is enough."""
    return F.coalesce(distance <= bits, F.lit(False)) | F.coalesce(fft >= fft_least, F.lit(False)) | F.coalesce(fmt >= fmt_least, F.lit(False))


def match_signals(t: Thresholds, distance: Column, color: Column, good_orb: Column, same_brand: Column) -> Column:
    """How many of the four signals speak for a pair."""
    return reduce(Column.__add__, [F.coalesce(x, F.lit(False)).cast("int") for x in (distance <= t.phash, color >= t.color, good_orb >= t.orb, same_brand)])


def weighted_similarity(c: Config, distance: Column, color: Column, orb: Column, dct: Column, same_brand: Column, signals: Column) -> Column:
    """Weighted channels (a missing one counts 0) with a brand bonus; halved if no signal backs more than 0.5."""
    z = lambda x: F.coalesce(x, F.lit(0.0))
    hashed = z(hash_similarity(distance, c.norm_bits))
    raw = c.weight_phash * hashed + c.weight_color * z(color) + c.weight_orb * z(orb) + c.weight_dct * z(dct)
    raw = raw + F.when(same_brand, c.brand_bonus).otherwise(0.0)
    return F.least(F.when((signals == 0) & (raw > 0.5), raw * 0.5).otherwise(raw), F.lit(1.0))


def calibrated_fusion(fused: Column, phash: Column, fft: Column, hu: Column, color_distance: Column) -> Column:
    """P5: weighted mean of the channels that are positive; 0 if none is."""
    color = F.greatest(F.lit(0.0), 1 - color_distance / 2)
    terms = [(0.35, fused), (0.25, phash), (0.20, fft), (0.15, hu), (0.05, color)]
    got = [(w, F.when(s > 0, s)) for w, s in terms]
    total = reduce(Column.__add__, [F.coalesce(s * w, F.lit(0.0)) for w, s in got])
    used = reduce(Column.__add__, [F.when(s.isNotNull(), w).otherwise(0.0) for w, s in got])
    return F.when(used > 0, total / used).otherwise(0.0)


# The least (for distances the greatest) value at which each channel agrees.
CHANNELS = {"fused": 0.25, "phash": 6, "fft": 0.985, "fmt": 0.995, "color_fmt": 0.85, "saliency": 0.80, "hu": 0.75, "zernike": 0.70, "sift": 0.3, "orb": 0.25, "calibrated": 0.75}
#: Confidence is the mean over these groups of whether any channel of the group agrees.
GROUPS = (("calibrated",), ("fused",), ("phash",), ("fft", "fmt"), ("hu", "zernike"), ("sift", "orb"))


def channel_votes(measures: dict[str, Column]) -> dict[str, Column]:
    """Whether each channel agrees; a missing measure doesn't."""
    test = {k: (measures[k] <= v) if k in ("fused", "phash") else (measures[k] >= v) for k, v in CHANNELS.items() if k in measures}
    return {k: F.coalesce(test.get(k, F.lit(False)), F.lit(False)) for k in CHANNELS}


def confidence(votes: dict[str, Column]) -> Column:
    """Mean of the six groups' votes."""
    return reduce(Column.__add__, [reduce(Column.__or__, [votes[c] for c in g]).cast("double") for g in GROUPS]) / len(GROUPS)


def decision_tree(votes: dict[str, Column], calibrated: Column) -> Column:
    """A very high fused score; else confidence with a good one; else the fused hash with another transform; else any channel."""
    rest = [votes[c] for c in CHANNELS if c not in ("fused", "calibrated")]
    return (
        F.when(calibrated >= 0.85, True)
        .when((confidence(votes) >= 0.5) & votes["calibrated"], True)
        .when(votes["fused"] & (votes["phash"] | votes["fft"]), True)
        .otherwise(reduce(Column.__or__, rest))
    )


def composite_score(calibrated: Column, *channels: Column) -> Column:
    """The calibrated score; where that is below 0.1, the best positive channel."""
    best = F.greatest(F.lit(0.0), *[F.coalesce(c, F.lit(0.0)) for c in channels])
    return F.when(calibrated < 0.1, F.when(best > 0, best).otherwise(calibrated)).otherwise(calibrated)


def legacy_similarity(hash_sim: Column, histogram: Column, structure: Column) -> Column:
    """40, 30 and 30 per cent."""
    return 0.4 * hash_sim + 0.3 * histogram + 0.3 * structure


def multi_criteria(distance: Column, good_orb: Column, color: Column) -> tuple[Column, Column]:
    """At least two of three strict criteria, and the confidence by how many hold."""
    n = reduce(Column.__add__, [F.coalesce(x, F.lit(False)).cast("int") for x in (distance <= 4, good_orb >= 25, color >= 0.90)])
    return n >= 2, F.when(n == 3, 1.0).when(n == 2, 0.85).when(n == 1, 0.67).otherwise(0.0)


def color_gate(distance: Column, most: float = 0.20) -> Column:
    """P10: whether an edge passes; unknown colours don't block."""
    return distance.isNull() | (distance <= most)


def singleton_accept(c: Config, distance: Column, color: Column, orb: Column, same_brand: Column, same_industry: Column) -> Column:
    """Any of five very relaxed criteria."""
    tests = (distance <= c.merge_phash, color >= c.merge_color, orb >= c.merge_orb, same_brand, same_industry)
    return reduce(Column.__or__, [F.coalesce(t, F.lit(False)) for t in tests])
