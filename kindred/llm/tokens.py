"""Word hashes of texts, for shingles and seeds.  Words are maximal runs without the six ASCII white-space bytes."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.lower and bytes.split know ASCII only, which is what is meant."""
    return text.encode().lower().split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """A 64-bit xxhash of each word (hashing is quicker than remembering rare words)."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wraps around)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words, in place order; none if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mixed(out * _MIX + hashes[i : i + n])
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; with fewer words the whole sequence is the only one."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    return np.unique(grams(word_hashes(ws), min(k, len(ws))))
