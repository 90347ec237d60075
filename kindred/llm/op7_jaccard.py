"""Exact set-similarity self-join on word shingles with a count-vector R-tree.

A document is the set of its k-word shingles.  Documents with equal sets are one class.  Hashing the shingles
into groups and counting them makes each class a point; two sets share no more than the sum of the smaller
coordinates of their points, so an R-tree over the points (with the sets' sizes) turns away pairs, node by
node, that can't reach the threshold.  What survives is verified on the whole texts.

How it is dealt out: the sizes fall in classes so that similar sets stand in one class or in neighbouring ones.
A class bounds how many shingles two similar sets don't share; hashed into more groups than that, they have a
group with the very same shingles.  So sets meet by the contents of their groups, which unrelated sets seldom
share, however frequent a passage is: other shingles stand in the same groups.  A bucket's classes
are bounded against its smallest one; those that it can't be near to look their best partner up in R-trees over
blocks of the bucket, so no tree holds a whole hot bucket.  The first count and smallest id of a bucket come from
a window, one task a key, whose rows (two numbers each) spill; all later counts are partial aggregates, joined back
by a merge join whose hot keys are split at run time.  These pairs, in proportion to the bucket, are verified and components are formed.  Best
partners in other components are looked up and verified again while that ties components together; then whatever
pairs of different components the bound leaves are verified, all of them.  A group of near copies so becomes one
component without a comparison of each two of its members.

Edge cases, each with a defined result: null and empty texts have an empty set and link with nothing; texts of
fewer words than a shingle are one shingle; very long texts are hashed whole, one text at a time; a row without an
id is counted but never compared, its component is null; repeated rows fall in one class; rows that repeat an id
with other texts each get a row, and one of the texts stands for the id when it is compared; ties take the smallest
id; an empty table gives an empty result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.graph import connected_components

from .common import discard, fresh, materialise
from .tokens import mixed, shingle_set

#: Fewest and most groups that a set's shingles are hashed into: coordinates of its point.
FEWEST, MOST = 32, 512
#: Rounds of best partners at most, before all that is left is verified.
ROUNDS = 4
#: Classes in a block of a bucket; buckets of up to FEW classes are searched for all pairs at once.
BLOCK, FEW = 2048, 64
NODE = 16


class Schemes:
    """Size classes and, for pairs whose smaller set is in a class, the number of groups and the spare ones.

    Sizes of class i + 1 reach as far as any set that is similar to one of class i.  Two similar sets of at
    most d unequal shingles agree in 1 + spare of d + 1 + spare groups, so a set with no more than ``spare``
    empty groups needn't be met by these.
    """

    def __init__(self, percent: int):
        self.percent, self.tops, self.groups, self.spare = percent, [0], [0], [0]

    def of(self, n: int) -> int:
        """The class of a size; classes start at 1."""
        while self.tops[-1] < n:
            top = (self.tops[-1] + 1) * 100 // self.percent
            unequal = (100 - self.percent) * (top + top * 100 // self.percent) // (100 + self.percent)
            spare, low = 0, self.tops[-1] + 1
            for _ in range(4):  # about as many as a set of the class hardly ever has empty
                empty = (unequal + 1 + spare) * math.exp(-low / (unequal + 1 + spare))
                spare = min(math.ceil(empty + 4 * math.sqrt(empty)), (unequal + 1) // 4)
            self.tops.append(top)
            self.groups.append(unequal + 1 + spare if unequal else 0)
            self.spare.append(spare)
        return bisect_left(self.tops, n)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Contents of the groups of a sorted set, in the scheme of its class and in that of the class below."""
        own = self.of(len(shingles))
        return np.concatenate([self._contents(shingles, i) for i in (own, own - 1) if self.groups[i]] or [np.empty(0, np.uint64)])

    def _contents(self, shingles: np.ndarray, i: int) -> np.ndarray:
        m = self.groups[i]
        group = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with the hash
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        name = mixed(group[starts] + np.uint64(i << 32))
        found = mixed(np.add.reduceat(mixed(shingles), starts) ^ name)
        if m - len(starts) > self.spare[i]:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), group[starts], assume_unique=True)
            found = np.concatenate([found, mixed(mixed(empty + np.uint64(i << 32)))])
        return found


def _features(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, set size, 128-bit digest of the set; keys and point for the first of its digest in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        schemes = Schemes(percent)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, digests, keys, points = [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingle_set(text, k)
                    d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                    sizes.append(len(s))
                    digests.append(d)
                    if d is None or doc_id is None or d in seen:
                        keys.append(None)
                        points.append(None)
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(d)
                    keys.append(schemes.keys(s).view(np.int64))
                    points.append(point_of(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(points, pa.binary())],
                    names=["doc_id", "n", "digest", "keys", "point"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, keys array<long>, point binary")


def groups_for(n: int) -> int:
    """One or two groups a shingle, so that few different shingles fall together; long texts have fewer.

    Their counts are large, so they still tell unrelated sets apart, and a point stays small.
    """
    return min(MOST, max(FEWEST, 1 << (n - 1).bit_length()))


def point_of(shingles: np.ndarray) -> bytes:
    """Counts by group, clipped at 255 (the search makes up for what is clipped off)."""
    g = groups_for(len(shingles))
    return np.minimum(np.bincount((shingles >> np.uint64(40)).astype(np.int64) % g, minlength=g), 255).astype(np.uint8).tobytes()


def folded(point: bytes, groups: int) -> np.ndarray:
    """The point in fewer groups (a power of two each): groups that fall together are summed."""
    return np.frombuffer(point, np.uint8).reshape(-1, groups).sum(0, dtype=np.uint16)


def may_link(n: int, point: bytes, m: int, other: bytes, percent: int) -> bool:
    """Whether the bound on the overlap of two sets lets them reach the threshold."""
    g = min(len(point), len(other))
    x, y = folded(point, g), folded(other, g)
    bound = int(np.minimum(x, y).sum(dtype=np.int64)) + min(n - int(x.sum(dtype=np.int64)), m - int(y.sum(dtype=np.int64)))
    return 100 * n >= percent * m and 100 * m >= percent * n and (100 + percent) * bound >= percent * (n + m)


class RTree:
    """Points in packed nodes: each node has the largest coordinates and the range of sizes below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(1), np.log(np.maximum(sizes, 1)) // 0.1))
        level = (points[self.order], sizes[self.order], sizes[self.order], (sizes - points.sum(1, dtype=np.int64))[self.order])
        self.levels = [level]
        while len(level[0]) > NODE:
            cuts = np.arange(0, len(level[0]), NODE)
            level = tuple(f.reduceat(x, cuts, axis=0) for f, x in zip((np.maximum, np.minimum, np.maximum, np.maximum), level, strict=True))
            self.levels.append(level)

    def search(self, point: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the given order) of points whose sets may be similar enough to this one, and their bounds.

        Over (clipped) coordinates: overlap <= sum of minima + the smaller of what was clipped off.
        """
        clipped = size - int(point.sum(dtype=np.int64))
        at, bound = np.arange(len(self.levels[-1][0])), np.empty(0)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most, excess = (x[at] for x in self.levels[depth])
            bound = np.minimum(high, point).sum(1, dtype=np.int64) + np.minimum(excess, clipped)
            ok = (percent * least <= 100 * size) & (100 * most >= percent * size) & ((100 + percent) * bound >= percent * (size + least))
            at, bound = at[ok], bound[ok] / (size + least[ok])
            if depth:
                n = len(self.levels[depth - 1][0])
                at = (at[:, None] * NODE + np.arange(NODE)).ravel()
                at = at[at < n]
        return self.order[at], bound


def _candidates(percent: int, best: bool, few: int):
    """Pairs of different components from sorted (key, block a, block b) runs.

    All of them or, with ``best`` and in buckets of more than ``few`` classes, each row's best one.
    """

    def found(rows: list[dict], others: list[dict], same: bool, top: bool) -> Iterator[tuple[int, int]]:
        by_width: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
        for side, part in zip(by_width, (rows, others), strict=True):
            for r in part:
                side[len(r["point"])].append(r)
        for wide, right in by_width[1].items():
            reps, labels = np.array([r["rep"] for r in right]), np.array([r["label"] for r in right])
            for other_wide, left in by_width[0].items():
                if not wide // 2 <= other_wide <= wide * 2:  # sizes so far apart don't link
                    continue
                g = min(wide, other_wide)
                tree = RTree(np.stack([folded(r["point"], g) for r in right]), np.array([r["n"] for r in right], np.int64))
                for r in left:
                    at, bound = tree.search(folded(r["point"], g), r["n"], percent)
                    ok = (labels[at] != r["label"]) & ((reps[at] > r["rep"]) | (not same or top))
                    at, bound = at[ok], bound[ok]
                    for m in at[[np.lexsort((reps[at], -bound))[0]]] if top and len(at) else at:
                        yield min(r["rep"], int(reps[m])), max(r["rep"], int(reps[m]))

    def pairs(rows: list[dict]) -> Iterator[tuple[int, int]]:
        first, second = rows[0]["i"], rows[0]["j"]
        left, right = ([r for r in rows if r["own"] == own] for own in (first, second))
        top = best and rows[0]["all"] > few
        if left and right:
            yield from found(left, right, first == second, top)
            if top and first != second:
                yield from found(right, left, False, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        rows = (r for batch in batches for start in range(0, batch.num_rows, 4096) for r in batch.slice(start, 4096).to_pylist())
        out: list[tuple[int, int]] = []
        for _, group in groupby(rows, key=lambda r: (r["key"], r["i"], r["j"])):
            new = [p for p in set(pairs(list(group))) if p not in seen]
            if len(seen) < 1_000_000:
                seen.update(new)
            out += new
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bound leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                rows = zip(*(c.to_pylist() for c in batch.slice(start, 2048).columns), strict=True)
                ok = [(a, b) for a, b, n, p, m, q in rows if may_link(n, p, m, q, percent)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in ok], pa.int64()) for i in (0, 1)], names=["a", "b"])

    mine = points.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("p_a"))
    other = points.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("p_b"))
    return pairs.join(mine, "a").join(other, "b").select("a", "b", "n_a", "p_a", "n_b", "p_b").mapInArrow(run, "a long, b long")


def _look_up(named: DataFrame, points: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs of different labels that meet in a bucket and pass the bound (each row's best one, or all)."""
    blocks = _blocks(named).join(points, "rep").select("key", "i", "j", "own", "all", "rep", "label", "n", "point")
    dealt = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_candidates(percent, best, FEW), "a long, b long").distinct()


def _texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of the documents in ``pairs``: the one time that whole texts move."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = mine.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])  # the ids grow with the data
    return materialise(found, "candidate-texts", free=True)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test: 100 |x & y| >= percent |x | y|."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(len(x) and len(y)) and 100 * both >= percent * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that are similar enough.  A text goes to each of its pairs; that of ``a`` once a group of them.

    A document with very many partners is dealt out over 64 tasks, and a task holds one text of ``a`` at a time.
    """
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int"))
    other = dealt.join(texts, dealt["b"] == texts["doc_id"]).select("a", "salt", "b", "text")
    own = dealt.select("a", "salt").distinct().join(texts, F.col("a") == texts["doc_id"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = own.unionByName(other).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(0, np.uint64), 0
        for batch in batches:
            found = []
            for start in range(0, batch.num_rows, 512):
                for a, _, b, text in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns), strict=True):
                    s = shingle_set(text, k)
                    if b is None:
                        held = s
                    elif similar(held, s, percent):
                        found.append((a, b))
            size += len(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _blocks(bucket: DataFrame) -> DataFrame:
    """Deal the rows of each bucket that has several components out to pairs of blocks.

    The largest component's rows never meet each other: only blocks of the others meet all blocks.
    """
    by_label = bucket.groupBy("key", "label").agg(F.count("*").alias("same"))
    by_key = by_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("same").alias("all"), F.max(F.struct("same", "label")).alias("top"))
    counted = bucket.join(by_key.filter("labels > 1").drop("labels").hint("merge"), "key")  # a merge join: hot keys are split
    n_top = F.ceil(F.col("top.same") / BLOCK).cast("int")
    n_rest = F.ceil((F.col("all") - F.col("top.same")) / BLOCK).cast("int")
    is_top = F.col("label") == F.col("top.label")
    own = F.when(is_top, n_rest + F.pmod(F.xxhash64("rep"), n_top)).otherwise(F.pmod(F.xxhash64("rep"), n_rest)).cast("int")
    met: Column = F.when(is_top, F.sequence(F.lit(0), F.col("n_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_rest") + F.col("n_top") - 1))
    numbered = counted.withColumn("n_top", n_top).withColumn("n_rest", n_rest).withColumn("own", own)
    return numbered.withColumn("with", F.explode(met)).select("key", "rep", "label", "own", "all", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (smallest doc_id with the same set) of every row."""
    whole = materialise(_features(docs, k, percent), "shingles")
    features = materialise(whole.select("doc_id", "n", "digest", F.col("keys").isNotNull().alias("emits"), "point"), "sets")
    classes = materialise(features.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min(F.when(F.col("emits"), F.col("doc_id"))).alias("rep")), "classes")
    chosen = classes.select("digest", F.col("rep").alias("doc_id"))
    met = whole.filter("keys is not null").join(chosen, ["digest", "doc_id"]).select(F.explode("keys").alias("key"), F.col("doc_id").alias("rep"))
    keyed = met.withColumn("least", F.min("rep").over(Window.partitionBy("key"))).withColumn("size", F.count("*").over(Window.partitionBy("key")))
    shared = materialise(keyed.filter("size > 1").select("key", "rep", "least", "size"), "shared-keys", free=True)
    discard(whole)
    emitted = features.filter("emits").join(chosen, ["digest", "doc_id"])
    points = emitted.select(F.col("doc_id").alias("rep"), "n", "point")
    stars = shared.filter("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    stars = materialise(_bounded(stars, points, percent), "stars")
    passed = stars.select(F.col("a").alias("least"), F.col("b").alias("rep"), F.lit(True).alias("passed"))
    met = shared.filter("size > 2").join(passed, ["least", "rep"], "left").withColumn("far", F.col("passed").isNull() & (F.col("rep") > F.col("least")))
    tried = materialise(met.select("key", "rep", "least", "size", "far"), "tried", free=True)
    mixed_keys = tried.filter("far").select("key").distinct().withColumn("mixed", F.lit(True))  # two that met are done
    marked = tried.join(mixed_keys.hint("merge"), "key", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    met = materialise(marked.select("key", "rep", "size", "mixed", F.when(F.col("far") | (F.col("mixed") & (F.col("size") <= FEW)), F.col("rep")).otherwise(F.col("least")).alias("label")), "buckets", free=True)
    discard(shared)
    discard(tried)
    tested = materialise(stars.unionByName(_look_up(met.filter("mixed"), points, percent, True)).distinct(), "tested", free=True)
    texts = _texts_of(docs, tested)  # whoever has a partner within the bound has one here
    links = materialise(_verify(tested, texts, k, percent), "links", free=True)
    labels = materialise(connected_components(links), "components")
    left, best = met.filter(f"size > {FEW} or not mixed").select("key", "rep", "size"), True  # of small mixed buckets all pairs are tested
    for n in range(ROUNDS + 1):
        named = left.select("key", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        crossing = materialise(_look_up(named, points, percent, best).join(tested, ["a", "b"], "left_anti"), "candidates", free=True)
        more = materialise(_verify(crossing, texts, k, percent), "links", free=True)
        done, found = not best, not more.isEmpty()
        if found:
            labels = materialise(connected_components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(more)), "components")
        left = left.filter(f"size > {FEW}")  # of small buckets all pairs are tested now
        if done:
            break
        tested, best = tested.unionByName(crossing), found and n < ROUNDS - 1
    placed = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    least = placed.groupBy("label").agg(F.min("class_id").alias("component_id"))
    discard(texts)
    final = materialise(placed.join(least, "label").select("digest", "class_id", "component_id"), "membership")
    rows = features.select("doc_id", "n", "digest")
    full = rows.filter("digest is not null and doc_id is not null").join(final, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    return full.unionByName(rows.filter("digest is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of similar documents the one with the smallest id, with all its columns.

    Rows that repeat an id are one document.  A null id is never compared and stays.
    """
    mark, copy = fresh(docs, "kept_id", "copy_no")
    kept = jaccard_components(docs.filter(F.col("doc_id").isNotNull()), k, percent).filter("doc_id = component_id").select(F.col("doc_id").alias(mark)).distinct()
    found = docs.join(kept, docs["doc_id"] == kept[mark]).drop(mark)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lit(0)))
    once = found.withColumn(copy, number).filter(F.col(copy) == 1).drop(copy)
    return once.unionByName(docs.filter(F.col("doc_id").isNull()))


def oracle(k: int, percent: int) -> str:
    """DuckDB SQL for all columns: every shingle is joined, so it is for small tables."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {k - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {k - 1}], ' ')))) end s from w),
c as (select doc_id, len(s)::bigint n, s, case when len(s) = 0 then doc_id else min(doc_id) over (partition by s) end class_id from s),
r as (select doc_id, n, unnest(s) x from c where doc_id = class_id and n > 0),
i as (select a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) c from r a join r b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from i where 100 * c >= {percent} * (na + nb - c)),
e as (select a, b from l union all select b, a from l),
p(id, other) as (select distinct class_id, class_id from c union select p.id, e.b from p join e on p.other = e.a),
m as (select id, min(other) label from p group by id)
select doc_id, n n_shingles, label component_id, class_id from c join m on m.id = c.class_id
"""
