"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network with a temperature.

Random indexing: each word has a fixed sparse index vector drawn by its hash; a word's vector is the sum of the
index vectors of its neighbours in the training texts.  Words and, as words of their own, their shapes (case,
digits, attached symbols) live in one hashed table.  A document is the mean of its word vectors and of its
shapes' vectors, with how alike neighbouring words are and how long it is.  The network is trained on a bounded
sample of labelled rows; a temperature fitted on rows apart from these calibrates its probabilities.

Edge cases, each with a defined result: null and empty texts get the score of a document without words; labels that
are null are left out; of contradictory labels of an id the lower one counts; with labels of one kind only (or none)
every score is the smoothed share of label 1; whole texts are read, however long; repeated rows get equal scores;
an empty table gives an empty result; extra columns are kept by the stage and not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, materialise

#: Labelled documents, and bytes of their texts, that training uses at most (chosen by hash of the id).
TRAIN_ROWS, TRAIN_BYTES = 6000, 48 << 20
BUCKETS, DIM, NONZERO, HIDDEN = 1 << 14, 48, 4, 24
SHAPES = 1 << 8
ACCEPT = 0.7
MEMO = 200_000

_UPPER, _DIGIT = frozenset(range(65, 91)), frozenset(range(48, 58))


def _shape(word: bytes) -> int:
    """A small number for how a word is written: case, digits, symbols before and behind it."""
    text = word.decode("utf-8", "replace")
    kinds = [("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c) for c in text[:48]]
    runs = [k for i, k in enumerate(kinds) if not i or k != kinds[i - 1] or not k.isalnum()]
    return xxhash.xxh32_intdigest("".join(runs[:2] + runs[-3:]).encode()) % SHAPES


class _Memo(dict):
    """word -> bucket * SHAPES + shape, for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.lower()) % BUCKETS * SHAPES + _shape(word)
        return found


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero coordinates of each bucket's (and then each shape's) index vector."""
    rng = np.random.default_rng(7)
    n = BUCKETS + SHAPES
    return rng.integers(0, DIM, (n, NONZERO)), rng.choice(np.array([-1.0, 1.0], np.float32), (n, NONZERO))


def _coded(texts: list[str | None], memo: _Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and shapes (as rows of the table) of all words, and where each text's words begin."""
    lists = [t.encode().split() if t else [] for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    codes = np.fromiter((memo[w] for x in lists for w in x), np.int64, starts[-1])
    return codes // SHAPES, codes % SHAPES + BUCKETS, starts


def context_vectors(texts: list[str | None]) -> np.ndarray:
    """Random indexing over the training texts: a unit vector for every bucket and shape that occurs."""
    places, signs = _index_vectors()
    table = np.zeros((BUCKETS + SHAPES) * DIM)
    memo = _Memo()
    for at in range(0, len(texts), 256):
        words, shapes, starts = _coded(texts[at : at + 256], memo)
        inner = np.ones(len(words), bool)
        inner[starts[1:-1][starts[1:-1] < len(words)]] = False  # the first word of a text has none before it
        right = np.flatnonzero(inner)[np.flatnonzero(inner) > 0]
        for rows in (words, shapes):
            for a, b in ((right - 1, right), (right, right - 1)):
                cells = rows[a][:, None] * DIM + places[rows[b]]
                table += np.bincount(cells.ravel(), signs[rows[b]].ravel(), len(table))
    table = table.reshape(-1, DIM)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str | None], table: np.ndarray, memo: _Memo) -> np.ndarray:
    """Features of each text: mean word vector, mean shape vector, likeness of neighbours, log length."""
    words, shapes, starts = _coded(texts, memo)
    out = np.zeros((len(texts), 2 * DIM + 4), np.float32)
    n = np.diff(starts)
    out[:, -1] = np.log1p(n) / 5
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        if a == b:
            continue
        for at in range(a, b, 1 << 16):  # a long text a piece at a time
            end = min(b, at + (1 << 16))
            w = table[words[at:end]]
            out[i, :DIM] += w.sum(0)
            out[i, DIM : 2 * DIM] += np.bincount(shapes[at:end] - BUCKETS, minlength=SHAPES).astype(np.float32) @ table[BUCKETS:]
            out[i, -4] += np.einsum("ij,ij->", w[1:], w[:-1])
            out[i, -3] += (words[at + 1 : end] == words[at : end - 1]).sum()
        out[i, :-1] /= b - a
        out[i, -2] = np.linalg.norm(out[i, :DIM])
    return out


@dataclass
class Model:
    """The word table, the network and its temperature; a fixed size of about 3 MB."""

    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    prior: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list[str | None], memo: _Memo) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        z = self.logits(pooled(texts, self.table, memo)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(texts: list[str | None], labels: list[int], apart: list[bool], epochs: int = 120, seed: int = 3) -> Model:
    """Fit on the rows that aren't apart, by Adam; then the temperature on those that are."""
    y, apart = np.array(labels, np.float32), np.array(apart, bool)
    if len(set(labels)) < 2:
        return Model(*[np.zeros(1)] * 6, 0.0, prior=(float(y.sum()) + 1) / (len(y) + 2))
    if len(set(y[~apart].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        apart = np.zeros(len(y), bool)
    table = context_vectors([t for t, a in zip(texts, apart, strict=True) if not a])
    memo = _Memo()
    x = np.concatenate([pooled(texts[i : i + 256], table, memo) for i in range(0, len(texts), 256)])
    fit = np.flatnonzero(~apart)
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.2, HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y[fit] == 1, 0.5 / y[fit].mean(), 0.5 / (1 - y[fit].mean())).astype(np.float32)
    xs, ys, step = (x[fit] - mean) / scale, y[fit], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // 128)):
            h = np.tanh(xs[part] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - ys[part]) * weight[part] / len(part)
            back = error[:, None] * params[2] * (1 - h * h)
            grads = [xs[part].T @ back + 1e-4 * params[0], back.sum(0), h.T @ error + 1e-4 * params[2], error.sum(keepdims=True)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(table, mean, scale, params[0], params[1], params[2], float(params[3][0]))
    if apart.any():
        z = model.logits(x[apart])
        model.temperature = float(min(np.geomspace(0.3, 8, 60), key=lambda t: _log_loss(z / t, y[apart])))
    return model


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; ids that are null count as the text 'null'."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("null")), "UTF-8")), F.lit(n))


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labelled documents that aren't held out; the sample's ids are few enough to broadcast."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = usable.count()
    order = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    sample = usable.filter(order < int((1 << 20) * min(1.0, TRAIN_ROWS / max(1, n))) + 1)
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("order", order), "quality-sample")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TRAIN_BYTES:
        rows = rows.filter(F.col("order") < (1 << 20) * min(1.0, TRAIN_ROWS / max(1, n)) * TRAIN_BYTES / size)
    got = sorted(rows.select("doc_id", "text", "quality").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["text"] or ""))
    apart = [xxhash.xxh32_intdigest(str(r["doc_id"]), 5) % 5 == 0 for r in got]
    return train([r["text"] for r in got], [int(r["quality"] == 1) for r in got], apart)


def with_quality(docs: DataFrame, model: Model, out: str) -> DataFrame:
    """``docs`` with all columns and the score, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                scores = shared.value.scores(part.column(text_at).to_pylist(), memo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, out])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and the decision of every document."""
    scored = with_quality(docs.select("doc_id", "text"), fit_quality(docs, labels), "score")
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    (name,) = fresh(docs, "score")
    return with_quality(docs, fit_quality(docs, labels), name).filter(F.col(name) >= ACCEPT).drop(name)
