"""Language-model scoring with a hashed maximum-entropy model and exact corpus counts.

P(token | context) = P(class | context) P(group | class, context) P(token | group, token before).

* Classes and groups are by frequency: the most frequent tokens are dealt to groups in the order of their counts,
  the others by hash to groups of their own.  The first two factors are softmaxes over hashed n-gram and skip
  features (the token before, the two before, the one before that).  They are trained by full gradients: in each
  of ``len(STEPS)`` rounds the weights are broadcast, every task sums the expected (and once the observed) count
  of each feature and class over its documents, the sums are added in a tree, and one step is made, the gradient
  in proportion to the expected counts.  Nothing depends on how the documents are dealt to tasks.
* The last factor has an indicator feature for each pair of neighbours, with absolute discounting in place of a
  prior; its counts, like those of single tokens, cover the whole training corpus, so they grow with it.

Counting and looking counts up never moves a text: a task cuts its documents into chunks, stores each chunk as
token numbers over its distinct tokens, and sends these tokens' hashes, packed, to shards by hash range; a shard
adds the chunks' counts up and answers each chunk with one packed array.  A token that stands in every document
is one number in each chunk's array.  The number of shards follows the number of distinct tokens in chunks.

Tokens are told apart by 64-bit hashes, pairs by 44 bits of the context and 20 of the token.

Edge cases, each with a defined result: null and empty texts are one end token; very long texts are read whole
(a chunk holds at least one document); with no training rows every count is 0 and the model is uniform over groups;
a null id trains as the text 'null'; repeated rows train and are scored each; tokens of equal counts are ordered by
hash; an empty table gives an empty result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .op5_quality import bucket_of
from .tokens import mixed, word_hashes, words

CLASSES = 16
GROUPS = CLASSES * CLASSES
#: Tokens dealt to groups by count; groups of the others.
FREQUENT, TAIL = 4096, 64
#: Rows of the hashed weight tables; features of a context besides the bias.
ROWS, FEATURES = 1 << 14, 3
#: Size of the step of each round, and what is added to observed and expected counts (a prior).
STEPS, PRIOR = (0.5, 0.3, 0.2), 10.0
#: Largest weight: a context's weights then sum to less than float32's exponential can take.
LIMIT = 16.0
#: Absolute discount of pair counts.
DISCOUNT = 0.75
#: Tokens in a numpy batch (their weights stay in a core's cache), and bytes of text in a chunk.
STEP, CHUNK = 1 << 14, 8 << 20
#: Keys in a shard of the counts, about; parts that a gradient is cut into, and added up at once.
SHARD, SLICES, FAN_IN = 1 << 20, 16, 64
#: Bits of a pair's key that tell its token.
TOKEN_BITS = np.uint64(20)
# Fixed value: stands for the end of a text.
END = np.uint64(0x5BD1E995A3C59AC3)
_ONES = np.ones(CLASSES, np.float32)
_SEEDS = np.array([0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers of 0 or more, compressed a byte plane at a time."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max((i + 1 for i in range(8) if planes[i].any()), default=0)
    return struct.pack("<QB", len(x), used) + zlib.compress(planes[:used].tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    n, used = struct.unpack_from("<QB", data)
    planes = np.zeros((8, n), np.uint8)
    planes[:used] = np.frombuffer(zlib.decompress(data[9:]), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def token_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text followed by an end; and where each text's tokens begin."""
    lists = [words(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lists])]).astype(np.int64)
    out = np.empty(starts[-1], np.uint64)
    inner = np.ones(len(out), bool)
    inner[starts[1:] - 1] = False
    out[inner] = word_hashes([w for x in lists for w in x])
    out[~inner] = END
    return out, starts


def before(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token and the one before that; the end stands before a text."""
    one = np.concatenate([[END], tokens[:-1]])
    two = np.concatenate([[END, END], tokens[:-2]])[: len(tokens)]
    two[starts[:-1]] = END
    second = starts[:-1] + 1
    two[second[second < len(tokens)]] = END
    one[starts[:-1]] = END
    return one, two


def context_rows(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of the weight table for each token's context: token before, two before as a pair, one skipped."""
    one, two = before(tokens, starts)
    mask, out = np.uint64(ROWS - 1), np.empty((FEATURES, len(tokens)), np.int64)
    for at in range(0, len(tokens), STEP):  # small arrays stay in the cache
        a, b = one[at : at + STEP], two[at : at + STEP]
        for f, key in enumerate((a, b * np.uint64(3) + a, b)):
            out[f, at : at + STEP] = mixed(key ^ _SEEDS[f]) & mask
    return out


def pair_keys(tokens: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """A key for each token: the token before and the token's group above, the token below."""
    context = mixed(mixed(before(tokens, starts)[0]) + groups.astype(np.uint64))
    return context >> TOKEN_BITS << TOKEN_BITS | mixed(tokens ^ _SEEDS[1]) >> (np.uint64(64) - TOKEN_BITS)


class Groups:
    """Which group a token is in: frequent ones by a table of at most FREQUENT entries, others by hash."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        """``frequent`` in order of falling count; a group holds about as much of the sum of the counts' roots."""
        share, n = np.sqrt(counts.astype(float)), GROUPS - TAIL
        group = np.minimum((np.cumsum(share) - share / 2) / max(1e-9, share.sum()) * n, n - 1).astype(np.int64)
        order = np.argsort(frequent)
        self.tokens, self.group = frequent[order], group[order]

    @staticmethod
    def tail(tokens: np.ndarray) -> np.ndarray:
        return (mixed(tokens ^ _SEEDS[2]) % np.uint64(TAIL)).astype(np.int64)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        out = GROUPS - TAIL + self.tail(tokens)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            out = np.where(self.tokens[at] == tokens, self.group[at], out)
        return out


class Weights:
    """Class weights by context row, and group weights by (context row, class) hashed into as many rows."""

    def __init__(self, sums: np.ndarray):
        """All weights 0 but the biases, which follow the groups' ``sums`` of tokens."""
        mass = sums.reshape(CLASSES, CLASSES) + 1.0
        self.first = np.zeros((ROWS + 1, CLASSES))
        self.second = np.zeros((ROWS + CLASSES, CLASSES))
        self.first[ROWS] = np.log(mass.sum(1) / mass.sum())
        self.second[ROWS:] = np.log(mass / mass.sum(1, keepdims=True))

    @staticmethod
    def inside(rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Rows of the second table: the context's row and the class, hashed together."""
        return (rows * 17 + cls * 40503) & (ROWS - 1)

    def ready(self) -> Weights:
        """The same in the precision that scoring uses."""
        self.small = self.first.astype(np.float32), self.second.astype(np.float32)
        return self

    def _logits(self, rows: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class logits, group logits within the class, and the second table's rows; ``rows`` is (features, tokens)."""
        (one, two), within, part = self.small, self.inside(rows, cls), np.empty((len(cls), CLASSES), np.float32)
        take = lambda table, at, out=None: table.take(at, 0, out, "clip")  # noqa: E731  several times quicker than table[at]; all rows exist
        first, second = take(one, rows[0]), take(two, ROWS + cls)
        first += one[ROWS]
        second += take(two, within[0], part)
        for f in range(1, FEATURES):
            first += take(one, rows[f], part)
            second += take(two, within[f], part)
        return first, second, within

    def log_probability(self, rows: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(class | context) P(group | class, context)."""
        cls, sub = groups // CLASSES, groups % CLASSES
        first, second, _ = self._logits(rows, cls)
        at = np.arange(len(groups))
        out = first[at, cls] + second[at, sub]
        for z in (first, second):
            np.exp(z, out=z)  # weights are kept within LIMIT, so nothing overflows
            out -= np.log(z @ _ONES)
        return out

    def observe(self, rows: np.ndarray, groups: np.ndarray, out: np.ndarray) -> None:
        """Add the observed counts of features and classes to ``out`` (table, row, class)."""
        cls, sub = groups // CLASSES, groups % CLASSES
        for i, (cells, target) in enumerate(((rows, cls), (self.inside(rows, cls), sub))):
            out[i] += np.bincount((cells * CLASSES + target).ravel(), minlength=ROWS * CLASSES).reshape(ROWS, CLASSES)

    def expect(self, rows: np.ndarray, groups: np.ndarray, out: np.ndarray) -> None:
        """Add the expected counts of features and classes to ``out`` (table, row, class)."""
        first, second, within = self._logits(rows, groups // CLASSES)
        for i, (z, cells) in enumerate(((first, rows), (second, within))):
            np.exp(z, out=z)
            z /= (z @ _ONES)[:, None]
            flat, column = cells.ravel(), np.empty((FEATURES, len(z)))
            for c in range(CLASSES):
                column[0] = z[:, c]
                column[1:] = column[0]
                out[i, :, c] += np.bincount(flat, column.ravel(), ROWS)

    def step(self, expected: np.ndarray, observed: np.ndarray, size: float) -> None:
        """Move each weight by the gradient, observed less expected counts, in proportion to the expected ones."""
        for table, e, o in zip((self.first, self.second), expected, observed, strict=True):
            table[:ROWS] += size * np.log((o + PRIOR) / (e + PRIOR))
            np.clip(table[:ROWS], -LIMIT, LIMIT, out=table[:ROWS])


CHUNK_SCHEMA = "chunk long, doc_ids array<long>, held array<boolean>, lengths binary, distinct int, tokens binary, places binary"


class Chunk:
    """Documents as numbers of their tokens in the sorted array of distinct tokens."""

    def __init__(self, row: dict):
        self.ids, self.held = row["doc_ids"], np.array(row["held"], bool)
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        by_count = np.frombuffer(row["tokens"], np.uint64)
        order = np.argsort(by_count)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.distinct, self.cells = by_count[order], rank[unpack(row["places"]).astype(np.int64)]
        self.trained = np.repeat(~self.held, self.lengths)

    @staticmethod
    def record(number: int, ids: list, held: list, parts: list[np.ndarray], lengths: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        distinct, cells = np.unique(tokens, return_inverse=True)
        by_count = np.argsort(-np.bincount(cells, minlength=len(distinct)), kind="stable")  # small numbers for frequent tokens
        rank = np.empty(len(distinct), np.int64)
        rank[by_count] = np.arange(len(distinct))
        columns = [
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([pack(np.concatenate(lengths))], pa.binary()),
            pa.array([len(distinct)], pa.int32()), pa.array([distinct[by_count].tobytes()], pa.binary()), pa.array([pack(rank[cells])], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])


def _chunks(docs: DataFrame) -> DataFrame:
    """The documents cut into chunks; a chunk has at least one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, parts, lengths, size = [], [], [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                tokens, starts = token_stream(part.column(2).to_pylist())
                ids += part.column(0).to_pylist()
                held += part.column(1).to_pylist()
                parts.append(tokens)
                lengths.append(np.diff(starts))
                size += 6 * len(tokens)
                if size >= CHUNK:
                    yield Chunk.record(number, ids, held, parts, lengths)
                    ids, held, parts, lengths, size, number = [], [], [], [], 0, number + 1
        if ids:
            yield Chunk.record(number, ids, held, parts, lengths)

    held = bucket_of(F.col("doc_id"), 7) == 2
    return docs.select(F.col("doc_id").cast("long"), held.alias("held"), "text").mapInArrow(run, CHUNK_SCHEMA)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


ASKED = "shard int, chunk long, keys binary, counts binary"


def _asked(chunk: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys and what the chunk adds to each, a row for each shard (the keys' highest bits)."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]])
    rows = [(int(shard[a]), chunk, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "chunk", "keys", "counts"])


def _bits(keys: int) -> int:
    """Shards, as a power of two, for so many keys."""
    return max(3, math.ceil(math.log2(max(1, keys) / SHARD)))


def _ask_tokens(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            c = Chunk(row)
            yield _asked(row["chunk"], c.distinct, np.bincount(c.cells[c.trained], minlength=len(c.distinct)), bits)

    return run


def _ask_pairs(bits: int, groups: Groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            c = Chunk(row)
            keys, cells = np.unique(pair_keys(c.distinct[c.cells], c.starts, groups.of(c.distinct)[c.cells]), return_inverse=True)
            yield _asked(row["chunk"], keys, np.bincount(cells[c.trained], minlength=len(keys)), bits)

    return run


def _summed(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each row of a shard the places of its keys in the sorted keys, these, and their sums."""
    keys = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in table.column("keys")]
    every, cells = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(cells, np.concatenate([unpack(x.as_py()) for x in table.column("counts")]).astype(float), len(every)).astype(np.int64)
    return np.split(cells, np.cumsum([len(k) for k in keys])[:-1]), every, sums


ANSWER = "shard int, chunk long, kind int, values array<binary>"


def _answer(shards: list[int], chunks: list[int | None], kind: int, values: list[list[bytes]]) -> pa.Table:
    return pa.table({"shard": pa.array(shards, pa.int32()), "chunk": pa.array(chunks, pa.int64()), "kind": pa.array([kind] * len(chunks), pa.int32()), "values": pa.array(values, pa.list_(pa.binary()))})


def _answer_tokens(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Counts for each chunk; and, without a chunk, what the shard adds to the tail groups, and its top tokens."""
    cells, keys, sums = _summed(table)
    tail, seen = Groups.tail(keys), sums > 0
    top = np.lexsort((keys, -sums))[:FREQUENT]
    notes = [np.bincount(tail, sums, TAIL).astype(np.int64).tobytes(), np.bincount(tail, seen, TAIL).astype(np.int64).tobytes(), keys[top].tobytes(), sums[top].tobytes()]
    chunks = table.column("chunk").to_pylist()
    return _answer([key[0].as_py()] * (len(chunks) + 1), [*chunks, None], 0, [*([pack(sums[c])] for c in cells), notes])


def _answer_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each chunk and pair its count, its context's count, and the kinds of tokens seen there."""
    cells, keys, sums = _summed(table)
    context = keys >> TOKEN_BITS
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    total, kinds = np.repeat(np.add.reduceat(sums, starts), sizes), np.repeat(np.add.reduceat((sums > 0).astype(np.int64), starts), sizes)
    chunks = table.column("chunk").to_pylist()
    return _answer([key[0].as_py()] * len(chunks), chunks, 1, [[pack(x[c]) for x in (sums, total, kinds)] for c in cells])


def _frequent(notes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent tokens with their counts; tokens and kinds of tokens in tail groups (all tokens so far)."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            tokens, n = (np.frombuffer(x, np.int64) for x in row["values"][2:])
            yield pa.RecordBatch.from_arrays([pa.array(tokens[n > 0]), pa.array(n[n > 0])], names=["token", "n"])

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, TAIL), np.int64)
        for row in _rows_of(batches):
            sums += np.stack([np.frombuffer(x, np.int64) for x in row["values"][:2]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL)), pa.array(sums[0]), pa.array(sums[1])], names=["g", "n", "v"])

    best = notes.mapInArrow(top, "token long, n long").orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    rows = notes.mapInArrow(tails, "g long, n long, v long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # TAIL rows
    n, v = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for r in rows:
        n[r["g"]], v[r["g"]] = r["n"], r["v"]
    return np.array([r["token"] for r in best], np.int64).view(np.uint64), np.array([r["n"] for r in best], np.int64), n, v


def _added(chunks: DataFrame, weights: Weights, groups: Groups, observed: bool) -> np.ndarray:
    """The sums of all training documents, added in a tree of bounded fan-in."""
    shared = chunks.sparkSession.sparkContext.broadcast((weights.ready(), groups))
    kinds = (pa.int64(), pa.int32(), pa.binary())
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "slice", "sums"])
    shape = (4 if observed else 2, ROWS, CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, g = shared.value
        out, part = np.zeros((shape[0], CLASSES, ROWS)).transpose(0, 2, 1), None  # a class's counts lie together
        for row in _rows_of(batches):
            part, c = TaskContext.get().partitionId(), Chunk(row)
            tokens = c.distinct[c.cells]
            rows, of = context_rows(tokens, c.starts)[:, c.trained], g.of(c.distinct)[c.cells[c.trained]]
            for at in range(0, len(of), STEP):
                w.expect(rows[:, at : at + STEP], of[at : at + STEP], out)
            for at in range(0, len(of) if observed else 0, 8 * STEP):
                w.observe(rows[:, at : at + 8 * STEP], of[at : at + 8 * STEP], out[2:])
        if part is not None:
            yield batch_of([(part, i, x.tobytes()) for i, x in enumerate(np.array_split(out.ravel(), SLICES))])

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ordered = table.sort_by("part").column("sums")
        total = sum(np.frombuffer(x.as_py()) for x in ordered)
        return pa.Table.from_batches([batch_of([(key[0].as_py(), key[1].as_py(), total.tobytes())])])

    schema = "part long, slice int, sums binary"
    parts = materialise(chunks.mapInArrow(run, schema), "lm-sums")
    while (last := parts.agg(F.max("part")).first()[0]) is not None:
        small = materialise(parts.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part", "slice").applyInArrow(merged, schema), "lm-sums")
        discard(parts)
        parts = small
        if last < FAN_IN:
            break
    got = sorted(parts.collect(), key=lambda r: r["slice"])  # SLICES rows
    discard(parts)
    return np.concatenate([np.frombuffer(r["sums"]) for r in got]).reshape(shape) if got else np.zeros(shape)


def fit_weights(chunks: DataFrame, groups: Groups, sums: np.ndarray) -> Weights:
    """Train on the chunks' documents that aren't held out, by one full gradient a round."""
    weights, observed = Weights(sums), np.zeros(0)
    for n, size in enumerate(STEPS):
        found = _added(chunks, weights, groups, n == 0)
        observed = found[2:] if n == 0 else observed
        weights.step(found[:2], observed, size)
    return weights.ready()


def token_probability(c, c_group, v_group, pair, context, kinds):
    """P(token | group, token before): what is left of the pair's share, and the discount by the group's shares."""
    alone = (c + 1) / (c_group + v_group + 1)
    n = np.maximum(context, 1)
    return np.where(context > 0, np.maximum(pair - DISCOUNT, 0) / n + DISCOUNT * kinds / n * alone, alone)


def score_corpus(docs: DataFrame) -> DataFrame:
    """Counts, base score and model score (log10) of every document."""
    chunks = materialise(_chunks(docs), "lm-chunks")
    size = chunks.agg(F.sum("distinct"), F.count("*")).first()
    asked = chunks.mapInArrow(_ask_tokens(_bits(size[0] or 0)), ASKED)
    counts = materialise(asked.groupBy("shard").applyInArrow(_answer_tokens, ANSWER), "lm-counts", free=True)
    frequent, n_frequent, n_tail, v_tail = _frequent(counts.filter("chunk is null"))
    n_tokens, n_types = int(n_tail.sum()), int(v_tail.sum())
    groups = Groups(frequent, n_frequent)
    sums, kinds = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    sums[GROUPS - TAIL :], kinds[GROUPS - TAIL :] = n_tail, v_tail
    of = groups.of(frequent)
    for table, x in ((sums, n_frequent), (kinds, np.ones_like(n_frequent))):
        np.add.at(table, of, x)
        np.subtract.at(table, GROUPS - TAIL + Groups.tail(frequent), x)
    weights = fit_weights(chunks, groups, sums)
    shared = docs.sparkSession.sparkContext.broadcast((weights, groups, sums, kinds))
    asked = chunks.mapInArrow(_ask_pairs(_bits(3 * (size[0] or 0)), groups), ASKED)
    pairs = materialise(asked.groupBy("shard").applyInArrow(_answer_pairs, ANSWER), "lm-pairs", free=True)
    base = math.log10(n_tokens + n_types + 1)

    def scored(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        w, g, c_group, v_group = shared.value
        chunk, right = Chunk(left.to_pylist()[0]), right.sort_by([("kind", "ascending"), ("shard", "ascending")]).to_pylist()
        c = np.concatenate([unpack(r["values"][0]) for r in right if r["kind"] == 0])[chunk.cells].astype(np.int64)
        tokens, starts = chunk.distinct[chunk.cells], chunk.starts
        of = g.of(chunk.distinct)[chunk.cells]
        cells = np.unique(pair_keys(tokens, starts, of), return_inverse=True)[1]
        seen = [np.concatenate([unpack(r["values"][i]) for r in right if r["kind"] == 1])[cells].astype(np.int64) for i in range(3)]
        rows = context_rows(tokens, starts)
        context = np.concatenate([w.log_probability(rows[:, i : i + STEP], of[i : i + STEP]) for i in range(0, len(of), STEP)]).astype(np.float64)
        add = lambda x: np.add.reduceat(x, starts[:-1])
        score = add(context) / math.log(10) + add(np.log10(token_probability(c, c_group[of], v_group[of], *seen)))
        n = chunk.lengths
        return pa.table({"doc_id": pa.array(chunk.ids, pa.int64()), "held_out": chunk.held, "n_tokens": n, "n_known": add((c > 0).astype(np.int64)), "train_tokens": np.full(len(n), n_tokens, np.int64), "base_score": add(np.log10(c + 1)) - n * base, "score": score})

    answers = counts.filter("chunk is not null").unionByName(pairs).repartition(max(1, (size[1] + 1) // 2), "chunk")
    dealt = chunks.drop("distinct").repartition(max(1, (size[1] + 1) // 2), "chunk")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, out)
