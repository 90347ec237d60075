"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one vocabulary token can end its valid encoding.  A table of that token per
prefix is the whole encoder state: bytes appended at the end only extend it, and an edit redoes it from the
edit on.  Whether a token may follow another depends on these two alone: no merge may have crossed their border
while both sides of it stood there.

Edge cases, each with a defined result: null and empty texts have no tokens; very long texts are read whole, pieces
in portions, and a piece of any length takes time in proportion to it; repeated rows are encoded alike; a text has
one encoding, so there are no ties; an empty table gives an empty result; columns other than doc_id and text are not
read, whatever their names.  The rank file's path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces that a Python worker remembers in each of two generations: a full young one becomes the old one, and
#: pieces met again move back, so frequent pieces stay.
CACHE = 300_000
#: Pieces of a text that are handled at once.
CHUNK = 1 << 18
NEVER = 1 << 60


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a ``.tiktoken`` file by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def merge_tree(tokens: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """The last merge (left, right) that makes each token, and tokens that their own bytes don't encode to."""
    rank = {t: i for i, t in enumerate(tokens)}
    left, right, loose = [-1] * len(tokens), [-1] * len(tokens), []
    for own, token in enumerate(tokens):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], NEVER))
            if rank.get(parts[best] + parts[best + 1], NEVER) >= own:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            left[own], right[own] = rank[parts[0]], rank[parts[1]]
        elif len(parts) > 2:
            loose.append(own)
    return left, right, loose


class Encoder:
    """Encoding of single pieces; small enough to broadcast (two numbers and a few bytes a token)."""

    def __init__(self, tokens: list[bytes], tree: tuple[list[int], list[int], list[int]] | None = None):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.left, self.right, loose = tree or merge_tree(tokens)
        self.loose = frozenset(loose)
        lengths: dict[bytes, set[int]] = {}
        for i, t in enumerate(tokens):
            if i not in self.loose:
                lengths.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: dict[int, bool] = {}

    def __reduce__(self):
        return Encoder, (self.tokens, (self.left, self.right, sorted(self.loose)))

    def _spine(self, token: int, side: int) -> list[tuple[int, bytes, int]]:
        """What stood at a token's edge while it was built: (token, its bytes, rank of the merge that consumed it)."""
        found = self.spines[side].get(token)
        if found is None:
            child, found, consumed, at = (self.left, self.right)[side], [], NEVER, token
            while at >= 0:
                found.append((at, self.tokens[at], consumed))
                consumed, at = at, child[at]
            self.spines[side][token] = found
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether token ``b`` directly after ``a`` is left alone by merging."""
        key = a << 32 | b
        ok = self.fits.get(key)
        if ok is None:
            ok = self.fits[key] = self._follows(a, b)
            if len(self.fits) > 4 * CACHE:
                self.fits.clear()
        return ok

    def _follows(self, a: int, b: int) -> bool:
        rank = self.rank
        for x, x_bytes, x_until in self._spine(a, 1):
            for y, y_bytes, y_until in self._spine(b, 0):
                merged = rank.get(x_bytes + y_bytes)
                if merged is not None:
                    when = max(merged, x, y)
                    if when < x_until and when <= y_until:  # of equal ranks the merge further left comes first
                        return False
        return True

    def extend(self, piece: bytes, last: list[int]) -> None:
        """Complete ``last``: after it, last[i] is the token that ends the encoding of piece[:i]."""
        get, lengths, fits, follows, loose = self.rank.get, self.lengths.get, self.fits.get, self.follows, self.loose
        for end in range(len(last), len(piece) + 1):
            for n in lengths(piece[end - 2 : end], ()) if end > 1 else ():
                if n > end:
                    continue
                token = get(piece[end - n : end])
                if token is None or token in loose:
                    continue
                if n == end:
                    break
                before = last[end - n]
                ok = fits(before << 32 | token)
                if ok or ok is None and follows(before, token):
                    break
            else:
                token = get(piece[end - 1 : end])
                if token is None:
                    raise ValueError("the vocabulary lacks single bytes")
            last.append(token)

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        table = PrefixTable(self, piece)
        return table.ids()


class PrefixTable:
    """One piece with its table of last tokens; appends and edits keep what stays valid."""

    def __init__(self, encoder: Encoder, piece: bytes = b""):
        self.encoder, self.piece, self.last = encoder, piece, [-1]
        encoder.extend(piece, self.last)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.encoder.extend(self.piece, self.last)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace piece[start:end]; prefixes up to ``start`` keep their tokens."""
        self.piece = self.piece[:start] + new + self.piece[end:]
        del self.last[start + 1 :]
        self.encoder.extend(self.piece, self.last)

    def ids(self) -> list[int]:
        whole = self.encoder.rank.get(self.piece)
        if whole is not None:
            return [whole]
        out, at = [], len(self.piece)
        while at:
            out.append(self.last[at])
            at -= len(self.encoder.tokens[self.last[at]])
        return out[::-1]


#: All letters of these ranges are \p{L}, all digits \p{N}, and \s means the same to both regex modules.
LETTERS, PLAIN_TEXT = "A-Za-zÀ-ÖØ-öø-ɏ", re.compile("[\t\n\r -~À-ÖØ-öø-ɏ]*")


def _spelt_out(pattern: str) -> str:
    r"""The pattern for texts of PLAIN_TEXT, for the standard module, which is the faster one."""
    inside = lambda m: m[0].replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9")
    return re.sub(r"\[[^\]]*\]", inside, pattern).replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class TextCoder:
    """Whole texts: pieces by pattern, each encoded separately; ids as little-endian 32-bit numbers."""

    def __init__(self, encoder: Encoder, pattern: str):
        import regex

        self.encoder, self.memory, self.old = encoder, {}, {}
        self.any, self.plain = regex.compile(pattern), re.compile(_spelt_out(pattern))

    def encode(self, text: str) -> bytes:
        pattern = self.plain if PLAIN_TEXT.fullmatch(text) else self.any
        if len(text) <= CHUNK:
            return self._pieces(pattern.findall(text))
        found, parts = (m[0] for m in pattern.finditer(text)), []
        while some := list(islice(found, CHUNK)):
            parts.append(self._pieces(some))
        return b"".join(parts)

    def _pieces(self, pieces: list[str]) -> bytes:
        memory = self.memory
        try:
            return b"".join(map(memory.__getitem__, pieces))
        except KeyError:
            pass
        if len(memory) > CACHE:
            self.old, self.memory = memory, {}
            memory = self.memory
        old, encode = self.old, self.encoder.encode
        for piece in set(pieces).difference(memory):
            memory[piece] = old.get(piece) or _packed(encode(piece.encode()))
        return b"".join(map(memory.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.encoder.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, number of ids, SHA-256 of the ids and of the bytes they decode to; with ``keep_ids`` the ids too.

    Row by row, without a shuffle.  The vocabulary is read once, by the driver; its size is fixed by the file.
    A Python worker has one copy of what is broadcast, so the pieces it remembers serve all its tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(TextCoder(Encoder(load_ranks(rank_path)), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield _coded(coder, part.column(0), part.column(1).to_pylist(), keep_ids)

    kind = dict(docs.dtypes)["doc_id"]
    ids = ", ids array<long>" if keep_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}")


def _coded(coder: TextCoder, doc_ids: pa.Array, texts: Iterable[str | None], keep_ids: bool) -> pa.RecordBatch:
    counts, digests, decoded, lists = [], [], [], []
    for text in texts:
        ids = coder.encode(text or "")
        counts.append(len(ids) // 4)
        digests.append(hashlib.sha256(ids).hexdigest())
        decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        if keep_ids:
            lists.append(np.frombuffer(ids, "<u4").astype("i8"))
    columns = [doc_ids, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if keep_ids:
        columns, names = [*columns, pa.array(lists, pa.list_(pa.int64()))], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names=names)
