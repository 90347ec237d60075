"""Benchmark decontamination by greedy string tiling.

Runs of ``seed`` words shared with a benchmark item are the seeds.  For each document and item that share
enough of them, the longest common runs are marked again and again, found by running Karp-Rabin over what is
unmarked, until no run of ``seed`` words is left.  The marked share of the item is its coverage; order doesn't
matter, so a passage whose parts were moved is still caught.

The benchmark is handled in blocks of a bounded size, each broadcast to one pass over the documents: no
shuffle, and a passage that stands in a third of all documents costs each of them the same.  Of several blocks one
at a time is held.  Texts that repeat a word or a phrase thousands of times cost time in proportion to their length
for each length of tile.

Edge cases, each with a defined result: null and empty texts match nothing; items of fewer than ``seed`` words match
nothing; very long texts are read whole, and only what lies around shared seeds is tiled; of tiles of equal length
the first in the item and then in the document is marked first; repeated items and repeated documents each match;
empty tables of either kind give no match; documents keep all their columns, whatever these are called.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parse_type

from .common import discard, fresh, materialise
from .tokens import grams, word_hashes

SEED, COVERAGE = 5, 0.5
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 32 << 20
# Fixed value: punctuation that isn't part of a word.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

OVERLAP = "array<struct<item_id:long,item_tokens:int,tiled:int,tiles:int,longest:int,reordered:boolean,coverage:double>>"


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words without punctuation."""
    return text.lower().encode().translate(None, PUNCTUATION).split() if text else []


def tile(item: list[int], doc: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in document, length) of the tiles, longest first.

    Each round finds the length of the longest common run of unmarked words and marks all runs of that length, so
    lengths fall from round to round: no more than the square root of twice the item's length are ever tried.
    """
    in_item, in_doc = set(item), set(doc)
    taken_item, taken_doc = bytearray(x not in in_doc for x in item), bytearray(x not in in_item for x in doc)
    tiles: list[tuple[int, int, int]] = []
    high = min(len(item), len(doc))
    while n := _longest(item, doc, taken_item, taken_doc, least, high):
        places = _places(_windows(doc, taken_doc, n))
        for h, i in _windows(item, taken_item, n):
            if taken_item.find(1, i, i + n) >= 0:
                continue
            free = places.get(h, deque())
            while free and taken_doc.find(1, free[0], free[0] + n) >= 0:
                free.popleft()  # marked words stay marked: each place is left behind once
            for j in free:
                if taken_doc.find(1, j, j + n) < 0 and item[i : i + n] == doc[j : j + n]:
                    taken_item[i : i + n] = taken_doc[j : j + n] = b"\1" * n
                    tiles.append((i, j, n))
                    break
        high = n - 1
    return tiles


_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _windows(seq: list[int], taken: bytearray, n: int) -> Iterator[tuple[int, int]]:
    """(rolling hash, place) of each run of ``n`` unmarked words."""
    power, h, free = pow(_BASE, n, _MOD), 0, 0
    for end, x in enumerate(seq):
        if taken[end]:
            h = free = 0
            continue
        h = (h * _BASE + x) % _MOD
        free += 1
        if free > n:
            h = (h - seq[end - n] * power) % _MOD
        if free >= n:
            yield h, end - n + 1


def _places(windows: Iterator[tuple[int, int]]) -> dict[int, deque[int]]:
    by_hash: dict[int, deque[int]] = defaultdict(deque)
    for h, at in windows:
        by_hash[h].append(at)
    return by_hash


def _longest(item, doc, taken_item, taken_doc, least: int, high: int) -> int:
    """Length of the longest common run of unmarked words, from ``least`` to ``high``; 0 if there is none.

    Halves the range; a run that is found is followed to its end, which a document that holds all of the item
    needs but one pass for.
    """
    stretch = lambda taken: max(map(len, bytes(taken).split(b"\1")))
    found, n, high = 0, least, min(high, stretch(taken_item), stretch(taken_doc))
    while n <= high:
        run = _run_of(item, doc, taken_item, taken_doc, n)
        if run:
            found = min(run, high)
        else:
            high = n - 1
        n = (max(found, least - 1) + high) // 2 + 1 if found < high else high + 1
    return found


def _run_of(item, doc, taken_item, taken_doc, n: int) -> int:
    """How far the first common run of ``n`` words goes; 0 if there is none."""
    by_hash = _places(_windows(item, taken_item, n))
    for h, j in _windows(doc, taken_doc, n):
        for i in by_hash.get(h, ()):
            if item[i : i + n] == doc[j : j + n]:
                k = n
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not taken_item[i + k] and not taken_doc[j + k]:
                    k += 1
                return k
    return 0


class SeedIndex:
    """Seeds of a block of benchmark items: hash, item, place; and a bitmap that turns most others away."""

    def __init__(self, items: list[tuple[int, str | None]], seed: int):
        self.seed, self.ids, self.words = seed, [], []
        hashes, of, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for item_id, text in items:
            h = word_hashes(tokens(text))
            g = grams(h, seed)
            hashes.append(g)
            of.append(np.full(len(g), len(self.ids)))
            at.append(np.arange(len(g)))
            self.ids.append(item_id)
            self.words.append(h)
        h, o, a = map(np.concatenate, (hashes, of, at))
        order = np.argsort(h, kind="stable")
        self.hashes, self.of, self.at = h[order], o[order], a[order]
        bits = max(16, min(26, int(math.log2(len(h) + 1)) + 8))
        self.mask = np.uint64((1 << bits) - 1)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[(h & self.mask).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``g``, item, place in item) for every shared seed."""
        near = np.flatnonzero(self.bitmap[(g & self.mask).astype(np.int64)])
        lo, hi = (np.searchsorted(self.hashes, g[near], side) for side in ("left", "right"))
        n = hi - lo
        which = np.repeat(np.arange(len(near)), n)
        index = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return near[which], self.of[index], self.at[index]


def overlaps(index: SeedIndex, texts: list[str | None], threshold: float) -> list[list[dict]]:
    """For each text, the items it covers to the threshold or more."""
    out: list[list[dict]] = [[] for _ in texts]
    lists = [tokens(t) for t in texts]
    ends = np.cumsum([len(x) for x in lists])
    all_words = word_hashes([w for x in lists for w in x])
    g = grams(all_words, index.seed)
    place, item, at = index.hits(g)
    doc = np.searchsorted(ends, place, "right")
    inside = place + index.seed <= ends[doc] if len(place) else np.empty(0, bool)  # not across two texts
    place, item, at, doc = place[inside], item[inside], at[inside], doc[inside]
    order = np.lexsort((place, item, doc))
    place, item, at, doc = place[order], item[order], at[order], doc[order]
    cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
    for run in np.split(np.arange(len(place)), cuts):
        if not len(run):
            continue
        words = index.words[item[run[0]]]
        if len(np.unique(at[run])) * index.seed < threshold * len(words):
            continue
        found = tile([int(x) for x in words], _around(all_words, place[run], index.seed), index.seed)
        tiled = sum(n for _, _, n in found)
        if tiled >= threshold * len(words):
            placed = [i for i, j, n in sorted(found, key=lambda x: x[1])]
            out[doc[run[0]]].append(
                {"item_id": index.ids[item[run[0]]], "item_tokens": len(words), "tiled": tiled, "tiles": len(found), "longest": max(n for _, _, n in found), "reordered": placed != sorted(placed), "coverage": tiled / len(words)}
            )
    return out


def _around(words: np.ndarray, places: np.ndarray, seed: int) -> list[int]:
    """The document's words under its seeds, with a different negative number between stretches.

    A tile of ``seed`` words or more consists of seeds, so nothing else can be part of one.
    """
    out, end = [], -1
    for p in np.unique(places).tolist():
        if p > end and out:
            out.append(-1 - len(out))
        out += [int(x) for x in words[max(p, end) : p + seed]]
        end = p + seed
    return out


def with_overlaps(docs: DataFrame, benchmark: DataFrame, out: str = "overlaps", seed: int = SEED, threshold: float = COVERAGE) -> DataFrame:
    """``docs`` with all columns and an array of the items that each document contains.

    ``benchmark`` has item_id and text.  One pass over the documents for each block of the benchmark; where there are
    several, each pass is written as a table and its block let go, so no worker ever holds more than one.
    """
    (mine,) = fresh(docs, out)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / BLOCK_BYTES))
    parts, written = [], None
    for block in range(n_blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).select(F.col("item_id").cast("long"), "text").collect()
        index = docs.sparkSession.sparkContext.broadcast(SeedIndex([tuple(r) for r in rows], seed))
        (name,) = fresh(docs, f"{mine}_{block}")
        docs = _one_pass(docs, index, name, threshold)
        parts.append(name)
        if n_blocks > 1:
            docs, before = materialise(docs, "tiled"), written
            index.destroy()
            if before is not None:
                discard(before)
            written = docs
    return docs.withColumn(mine, F.concat(*parts)).drop(*[p for p in parts if p != mine])


def _one_pass(docs: DataFrame, index, name: str, threshold: float) -> DataFrame:
    text_at = docs.columns.index("text")
    kind = parse_type(OVERLAP)
    schema = StructType([*docs.schema.fields, StructField(name, kind)])
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("item_tokens", pa.int32()), ("tiled", pa.int32()), ("tiles", pa.int32()), ("longest", pa.int32()), ("reordered", pa.bool_()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = overlaps(index.value, part.column(text_at).to_pylist(), threshold)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, arrow)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it contains."""
    found = with_overlaps(docs.select("doc_id", "text"), benchmark).filter(F.size("overlaps") > 0)
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item."""
    (name,) = fresh(docs, "overlaps")
    return with_overlaps(docs, benchmark, name).filter(F.size(name) == 0).drop(name)
