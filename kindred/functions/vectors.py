"""Distances and similarities of hashes and vectors as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def hex_words(hex_text: Column, chars: int = 64) -> Column:
    """A hash in hex as 32-bit words, to be kept beside it: distances then need no parsing."""
    return F.array(*[F.conv(F.substring(hex_text, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(chars // 8)])


def hamming_words(a: Column, b: Column) -> Column:
    """J5 on word arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def hamming_hex(a: Column, b: Column, chars: int = 64) -> Column:
    """Differing bits of two hashes in hex."""
    word = lambda c, i: F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long")
    return reduce(Column.__add__, [F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(chars // 8)])


def hamming_bits(a: Column, b: Column) -> Column:
    """Differing places of two bit strings, as far as the shorter one goes."""
    n = F.least(F.length(a), F.length(b))
    x, y = F.split(F.left(a, n), ""), F.split(F.left(b, n), "")
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p != q).cast("int")), F.lit(0), lambda acc, v: acc + v)


def pack_bits(bits: Column) -> Column:
    """Up to 64 places of a bit string as one number."""
    return F.conv(bits, 2, -10).cast("long")


def hamming_long(a: Column, b: Column) -> Column:
    """J6 on packed bits."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_vector(a: Column, b: Column) -> Column:
    """Unequal elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, v: acc + v)


def hash_similarity(distance: Column, norm_bits: int = 64) -> Column:
    """1 at distance 0, 0 from ``norm_bits`` on."""
    return F.greatest(F.lit(0.0), (F.lit(norm_bits) - distance) / F.lit(float(norm_bits)))


def l1_similarity(a: Column, b: Column) -> Column:
    """1 less half the sum of differences (below 0 for vectors of several unit-sum histograms)."""
    return 1 - _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / 2


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 0.0, norms: tuple[Column, Column] | None = None) -> Column:
    """J9; null if a vector is zero (unless ``eps`` is given).  ``norms``: both lengths, where a vector has many pairs."""
    x, y = norms or (norm(a), norm(b))
    scale = x * y + F.lit(eps)
    return F.when(scale > 0, dot(a, b) / scale)


def euclidean(a: Column, b: Column) -> Column:
    """J11; 0 if either is null."""
    gap = F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))
    return F.coalesce(gap, F.lit(0.0))


def correlation_max(a: Column, b: Column, circular: bool = False) -> Column:
    """Largest cross-correlation over all lags; linear (zero-padded to twice the length) or circular."""
    n = F.size(a)
    lags = F.sequence(F.lit(0), n - 1) if circular else F.sequence(1 - n, n - 1)
    place = (lambda i, s: F.pmod(i + s, n)) if circular else (lambda i, s: i + s)
    at = lambda s: _sum(F.transform(a, lambda x, i: x.cast("double") * F.coalesce(F.get(b, F.when(place(i, s) >= 0, place(i, s))).cast("double"), F.lit(0.0))))
    return F.greatest(F.array_max(F.transform(lags, at)), F.lit(None if circular else 0.0).cast("double"))


def median_bits(values: Column) -> Column:
    """Bits of a vector by its median: the thresholding step of the transform hashes."""
    once = F.transform(F.array(F.array_sort(F.transform(values, lambda x: x.cast("double")))), _middle)  # bound, so it is computed once
    return F.get(F.transform(once, lambda mid: F.array_join(F.transform(values, lambda x: F.when(x.cast("double") > mid, "1").otherwise("0")), "")), F.lit(0))


def _middle(ordered: Column) -> Column:
    """Median of a sorted array; null if it is empty."""
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def ones(bits: Column) -> Column:
    """Set bits of a bit string."""
    return F.length(F.replace(bits, F.lit("0"), F.lit("")))


def low_number(bits: Column, n: int = 32) -> Column:
    """The first ``n`` places as a number, the first one lowest."""
    return F.conv(F.reverse(F.left(bits, F.lit(n))), 2, 10).cast("long")


def variance(values: Column) -> Column:
    """Population variance of an array."""
    n = F.size(values)
    mean = _sum(F.transform(values, lambda x: x.cast("double"))) / n
    return _sum(F.transform(values, lambda x: F.pow(x.cast("double") - mean, 2))) / n


def quality_score(*scores: Column) -> Column:
    """25 for each score above 0."""
    return reduce(Column.__add__, [F.when(s > 0, 25).otherwise(0) for s in scores])
