"""Canonical exact fingerprints of documents.

Canonical form: Unicode NFKC, case folding, white space folded to single spaces.  The fingerprint is the
128-bit xxhash of its UTF-8 bytes plus a number that tells different canonical forms with one hash apart: all
documents in a bucket of equal hashes are compared byte by byte.

Edge cases, each with a defined result: null text is an empty one, whose canonical form is empty; very long texts are
read whole; rows that repeat a doc_id are ordered by text, and equal rows in any order, which doesn't show; a table of
one document is its own successor; null ids come first; an empty table gives an empty result; columns other than
doc_id and text are not read, whatever their names.  An edited text's hash is told apart by bytes from its own
document's only: another document's form with the very same 128 bits would count as equal to it.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def canonical(text: str | None) -> bytes:
    """NFKC, case folded (and NFKC again, as folding can undo it), white space runs as one space, trimmed."""
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and hash of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [digest(canonical(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], names=["doc_id", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, digest string")


def shared_buckets(hashed: DataFrame) -> DataFrame:
    """The ids whose hash occurs more than once; only hashes and ids move."""
    several = materialise(hashed.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "shared-digests")  # a hot hash can be split in the join
    return hashed.join(several, "digest", "left_semi").select("doc_id").distinct()


def numbered(forms: DataFrame) -> DataFrame:
    """digest, form, number of the canonical forms that share a hash with another form (hardly ever any).

    The grouping compares bytes; copies collapse before the shuffle.
    """
    distinct = forms.groupBy("digest", "form").agg(F.count("*").alias("copies"))
    crowded = distinct.groupBy("digest").agg(F.count("*").alias("forms")).filter("forms > 1").select("digest")
    number = F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1
    return distinct.join(crowded, "digest", "left_semi").withColumn("number", number).select("digest", "form", "number")


OUT = "part int, role string, n_chars long, edited_sha256 string, digest string, edited_digest string, same_form boolean, next_digest string, text string, next_text string, form binary"
NAMES = [x.split()[0] for x in OUT.split(", ")]


def _probe(text: str, after: str) -> tuple:
    """What an edited document has: length, edited text's hash, the three fingerprints' hashes."""
    n = len(text)
    k = n // 4
    edited = text[: n - k] + after[:k]
    form, edited_form = canonical(text), canonical(edited)
    return n, hashlib.sha256(edited.encode()).hexdigest(), digest(form), digest(edited_form), form == edited_form, digest(canonical(after)), form


def _paired(doc_kind: str):
    """Rows in order of doc_id within a partition; each is probed with its successor.

    A partition's first text and its last document leave unprobed, for the border with the next partition.
    """
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[doc_kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), []
        before: tuple | None = None
        flagged: set = set()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [arrow, pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", *NAMES])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for doc_id, is_doc, text in zip(*(batch.column(i).slice(start, 256).to_pylist() for i in range(3)), strict=True):
                    if not is_doc:  # it stands before the document it speaks of
                        flagged.add(doc_id)
                        continue
                    if before is None:
                        rows.append((doc_id, part, "head", *[None] * 6, text, None, None))
                    else:
                        *found, form = _probe(before[1], text)
                        rows.append((before[0], part, "row", *found, None, None, form if before[0] in flagged else None))
                        if before[0] != doc_id:
                            flagged.discard(before[0])
                    before = (doc_id, text)
                if rows:
                    yield batch_of(rows)
                    rows = []
        if before is not None:
            shared = canonical(before[1]) if before[0] in flagged else None
            yield batch_of([(before[0], part, "tail", *[None] * 6, before[1], None, shared)])

    return run


def _bordered(doc_kind: str):
    """The last document of each partition with the first text of the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                *found, _ = _probe(r["text"], r["next_text"])
                r |= dict(zip(NAMES[2:8], found, strict=True)) | {"role": "row", "text": None, "next_text": None}
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return run


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how they compare.

    The texts move once, ranged by doc_id; notes on which documents need the byte comparison travel with them.
    """
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce("text", F.lit(""))
    flags = shared_buckets(materialise(digests(docs), "digests")).select("doc_id", F.lit(False).alias("is_doc"), F.lit(None).cast("string").alias("text"))
    ordered = docs.select("doc_id", F.lit(True).alias("is_doc"), text.alias("text")).unionAll(flags).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "is_doc", "text")
    probed = materialise(ordered.mapInArrow(_paired(kind), f"doc_id {kind}, {OUT}"), "probed")
    heads = probed.filter("role = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    tails = probed.filter("role = 'tail'")
    by_part = Window.orderBy("part")  # one row for each partition
    order = tails.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())).alias("next_part"))
    border = tails.join(order, "part").join(heads, "next_part").withColumn("next_text", F.col("after")).select("doc_id", *NAMES)
    rows = probed.filter("role = 'row'").unionByName(border.mapInArrow(_bordered(kind), f"doc_id {kind}, {OUT}"))
    forms = rows.filter("form is not null").select("doc_id", "digest", "form")
    numbers = materialise(numbered(forms), "numbered")
    if numbers.isEmpty():
        rows = rows.withColumn("number", F.lit(0))
    else:
        own = forms.join(numbers, ["digest", "form"]).groupBy("doc_id", "digest").agg(F.max("number").alias("number"))
        rows = rows.join(own, ["doc_id", "digest"], "left").fillna(0, ["number"])
    number = F.concat(F.lit("-"), F.col("number"))
    own = F.concat("digest", number)
    edited = F.when(F.col("edited_digest") == F.col("digest"), F.concat("digest", F.when(F.col("same_form"), number).otherwise(F.lit("-x")))).otherwise(F.concat("edited_digest", F.lit("-0")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), edited.alias("edited_fingerprint"),
        (own == edited).cast("double").alias("near_edited"),
        (F.col("digest") == F.col("next_digest")).cast("double").alias("near_next"),
    )
