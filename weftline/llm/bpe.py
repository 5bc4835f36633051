"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved recursively down to leaves of at most ``LEAF`` bytes, which the
tokenizer library encodes.  Two neighbouring encodings are joined by encoding a
window around the cut again.  The window grows, token by token, to both sides
until it ends where a character that isn't white space is followed by a space
or a line feed.  No alternative of the split pattern matches across such a
place and none looks further ahead than its following character, so every
split of any surrounding text has a boundary there; tokens beyond it can't
change.  A text without such places is encoded again as a whole at each level.

Decoding concatenates the tokens' bytes up the same kind of tree.

Cases: a null or empty text has no tokens; a very long text costs a task memory
in proportion to its own length; repeated rows are encoded each for itself; an
empty table gives an empty result; other columns are ignored by ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from weftline.functions.pages import spread

LEAF = 1024


class Codec:
    """Encodes and decodes by a rank file's content and a split pattern."""

    _made: dict = {}

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF) -> None:
        own = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.base = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        self.bytes_of: list[bytes] = [b""] * (max(own.values(), default=-1) + 1)
        for token, rank in own.items():
            self.bytes_of[rank] = token
        self.leaf = leaf

    @classmethod
    def cached(cls, ranks: bytes, pattern: str) -> Codec:
        """One for each worker process and vocabulary."""
        key = (hashlib.sha256(ranks).digest(), pattern)
        if key not in cls._made:
            cls._made[key] = cls(ranks, pattern)
        return cls._made[key]

    def encode(self, text: str) -> list[int]:
        data = text.encode()
        return self._encode(data, 0, len(data)) if data else []

    def _encode(self, data: bytes, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.base.encode_ordinary(data[start:end].decode())
        cut = (start + end) // 2
        while data[cut] & 0xC0 == 0x80:  # not inside a character
            cut -= 1
        if cut == start:  # one character longer than a leaf
            return self.base.encode_ordinary(data[start:end].decode())
        return self._join(data, start, cut, end, self._encode(data, start, cut), self._encode(data, cut, end))

    def _join(self, data: bytes, start: int, cut: int, end: int, left: list[int], right: list[int]) -> list[int]:
        size = self.bytes_of
        low, i = cut, len(left)
        while i:
            i -= 1
            low -= len(size[left[i]])
            if _settled(data, start, low, cut):
                break
        high, j = cut, 0
        while j < len(right):
            high += len(size[right[j]])
            j += 1
            if _settled(data, cut, high, end):
                break
        return left[:i] + self.base.encode_ordinary(data[low:high].decode()) + right[j:]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


def _settled(data: bytes, start: int, at: int, end: int) -> bool:
    """Whether the split has a boundary at ``at`` whatever surrounds
    data[start:end]: a space or line feed there, none right before it."""
    if not start < at < end or data[at] not in b" \n":
        return False
    if data[at - 1] < 0x80:
        return 0x21 <= data[at - 1] <= 0x7E
    first = at - 1
    while data[first] & 0xC0 == 0x80:
        first -= 1
    return not data[first:at].decode().isspace()


#: Columns that ``encode`` can return beside doc_id.
KINDS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>"}


def encode(docs: DataFrame, ranks: bytes, pattern: str, columns: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """doc_id and ``columns`` for each row of ``docs(doc_id, text)``: the number
    of tokens, the ids, the digest of the ids as little-endian unsigned 32-bit
    integers, the digest of the bytes that the ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # about 1 MB, whatever the input
    names = ["doc_id", *columns]
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.cached(shared.value, pattern)
        for batch in batches:
            got: dict[str, list] = {c: [] for c in columns}
            for value in batch.column(1):
                ids = codec.encode(value.as_py() or "")
                if "n_tokens" in got:
                    got["n_tokens"].append(len(ids))
                if "ids" in got:
                    got["ids"].append(np.array(ids, dtype=np.int32))
                if "ids_sha256" in got:
                    got["ids_sha256"].append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                if "decoded_sha256" in got:
                    got["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[c], types.get(c, pa.string())) for c in columns)], names=names)

    return spread(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{c} {KINDS[c]}" for c in columns))


def decode(rows: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id and text (binary) from rows (doc_id, ids); null ids: empty."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.cached(shared.value, pattern)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text binary")
