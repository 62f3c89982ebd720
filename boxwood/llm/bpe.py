"""Byte-level BPE by tree reduction, and back.

A text's halves are encoded recursively, down to leaves of ``LEAF`` code points
that the library encodes. Neighbours are joined as a monoid: the text around the
seam is encoded anew, in a window that grows on either side until it begins and
ends at a place where tokens provably cannot change. Such a place lies between a
letter or digit and a space or line feed: no alternative of the pattern matches
both, so every scan breaks there, and what is before it and after it is encoded
the same alone as together (the pattern looks ahead only, and a piece that ends in
a letter or digit does not look beyond itself). The tokens outside the window
stand as they are. Where a side has no such place the window takes it whole.
Decoding joins the bytes of the parts up the tree.

Defined results
    null or empty text: no ids; the hashes of the empty string.
    any ``doc_id`` (null, repeated): one result row per input row. Extra columns
    are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwood.llm.blocks import lean
from boxwood.llm.common import small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Code points of a leaf, and of the first window on either side of a seam.
LEAF, WINDOW = 1 << 10, 32
#: Where every scan of the pattern breaks.
BREAK = re.compile(r"(?<=[^\W_])(?=[ \n])")


class Coder:
    """A vocabulary with its pattern; one per worker process."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]
        self.size = [0] * len(self.names)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def _within(self, ids: list[int], n_bytes: int, back: bool) -> int:
        """How many tokens at an end of ``ids`` make ``n_bytes``."""
        k = 0
        while n_bytes > 0:
            n_bytes -= self.size[ids[-1 - k] if back else ids[k]]
            k += 1
        assert n_bytes == 0, "a break inside a token"
        return k

    def join(self, text: str, a: int, left: list[int], seam: int, right: list[int], b: int) -> list[int]:
        """Ids of text[a:b] from those of text[a:seam] and text[seam:b]."""
        if BREAK.match(text, seam):
            return left + right
        first, width = a, WINDOW
        while True:  # the last break before the seam
            start = max(a, seam - width)
            at = [m.start() for m in BREAK.finditer(text, max(start, a + 1), seam)]
            if at or start == a:
                first = at[-1] if at else a
                break
            width *= 2
        m = BREAK.search(text, seam + 1, b)
        last = m.start() if m and m.start() < b else b
        gone = self._within(left, len(text[first:seam].encode()), True)
        skip = self._within(right, len(text[seam:last].encode()), False)
        return left[: len(left) - gone] + self.whole.encode_ordinary(text[first:last]) + right[skip:]

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        return self._encode(text, 0, len(text), max(leaf, 1))

    def _encode(self, text: str, a: int, b: int, leaf: int) -> list[int]:
        if b - a <= leaf:
            return self.whole.encode_ordinary(text[a:b])
        seam = (a + b) // 2
        return self.join(text, a, self._encode(text, a, seam, leaf), seam, self._encode(text, seam, b, leaf), b)

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return self.whole.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


@lru_cache(4)
def coder(ranks: str = RANKS, pattern: str | None = None) -> Coder:
    """``ranks``: a path, or the name of a file of the public tokenizers."""
    import public_tokenizers

    return Coder(ranks if "/" in ranks else public_tokenizers.path(ranks), pattern or public_tokenizers.PATTERN)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _map(df: DataFrame, schema: str, fields: list[str], make) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        lean()
        for b in batches:
            for a in range(0, b.num_rows, 256):  # ids of a few texts at a time
                part = b.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), *make(part.column(1))], fields)

    return small_batches(df).mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``."""
    make = lambda col: [pa.array([coder(ranks).encode(t.as_py()) for t in col], pa.list_(pa.int32()))]
    src = _source(docs, id_col, text_col)
    return _map(src, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>", ["doc_id", "ids"], make)


def decode(coded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``doc_id, bytes`` from ``doc_id, ids``; null ids count as none."""
    make = lambda col: [pa.array([coder(ranks).decode(t.as_py() or []) for t in col], pa.binary())]
    src = coded.select("doc_id", "ids")
    return _map(src, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, bytes binary", ["doc_id", "bytes"], make)


def digest(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, ids made and decoded in
    one pass so that they need not travel."""

    def make(col: pa.Array) -> list[pa.Array]:
        c, n, coded, decoded = coder(ranks), [], [], []
        for t in col:
            ids = c.encode(t.as_py())
            n.append(len(ids))
            coded.append(hashlib.sha256(",".join([c.names[i] for i in ids]).encode()).hexdigest())
            decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]

    src = _source(docs, id_col, text_col)
    fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return _map(src, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", fields, make)


def round_trip(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, same``: the ids, and whether their decoded bytes
    are the text's."""

    def make(col: pa.Array) -> list[pa.Array]:
        c = coder(ranks)
        ids = [c.encode(t.as_py()) for t in col]
        same = [c.decode(i) == t.as_py().encode() for i, t in zip(ids, col, strict=True)]
        return [pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]

    src = _source(docs, id_col, text_col)
    return _map(src, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, same boolean", ["doc_id", "n_tokens", "ids", "same"], make)
