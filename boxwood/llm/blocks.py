"""Documents packed into blocks, and keys exchanged between blocks.

Operators that compare every window of every document would need a row per
window; a row costs far more than its key. So documents are packed into blocks
of a few MB (compressed, written once to the shared folder), a task hashes the
windows of a block with vectorised arithmetic, and what travels is, for each
block and key range that it has keys in, one sorted array of distinct keys,
stored as differences. Who receives a key range merges the arrays of all blocks
and sends each block its answers in the order of its keys.

A key that a third of all documents share is in a block's array once, so key
ranges stay even however skewed the documents are; ranges are sized by the
number of keys, so a task's memory does not grow with the corpus. Arrays number
at most blocks times ranges, and never more than the keys.

Fingerprints are 64 bits of a polynomial over random symbol values, finished by a
mixing step. They are made in slices of ``STEP`` symbols, so a block costs a few
times its own size in memory however long its documents are. Which documents are
in which block is decided once, by the written table, so every later pass and
every retry sees the same blocks.
"""

from __future__ import annotations

import ctypes
import math
import pickle
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwood.llm.common import small_batches, stash

U64 = np.uint64
NO_ID = np.iinfo(np.int64).max
#: Text bytes of a block, and symbols hashed at a time.
BLOCK_BYTES, STEP = 4 << 20, 1 << 17
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, (2, 256), dtype=np.uint64) * U64(2) + U64(1)
_BASES = (0x9E3779B97F4A7C15, 0xAEF17502108EF2D9)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


@cache
def _trim() -> Callable[[int], int]:
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # glibc: arrays from 4 MB on are mapped, the heap's end is trimmed
        libc.mallopt(-3, 4 << 20)
        libc.mallopt(-1, 4 << 20)
    return getattr(libc, "malloc_trim", lambda _: 0)


def lean() -> None:
    """Has a worker hand freed memory back to the system, now and from now on:
    workers are reused, and what a task needed once would stay with them."""
    _trim()(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out)


@cache
def _usual(which: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASES[which], 2 * STEP), _powers(pow(_BASES[which], -1, 1 << 64), 2 * STEP)


def _prefixes(values: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """``pre, inv``: ``(pre[j] - pre[i]) * inv[i]`` is the polynomial of values[i:j]."""
    n = len(values) + 1
    p, inv = _usual(which) if n <= 2 * STEP else (_powers(_BASES[which], n), _powers(pow(_BASES[which], -1, 1 << 64), n))
    v = _TABLE[which][values] if values.dtype == np.uint8 else values
    pre = np.zeros(n, U64)
    np.cumsum(v * p[: n - 1], out=pre[1:])
    return pre, inv


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Fingerprints of values[start:end] (bytes, or 64-bit words), the same wherever
    they stand. ``starts`` and ``ends`` ascend."""
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + STEP, "right")))
        pre, inv = _prefixes(values[a : int(ends[j - 1])], which)
        s = starts[i:j] - a
        out[i:j] = (pre[ends[i:j] - a] - pre[s]) * inv[s]
        i = j
    return mix(out + (ends - starts).astype(U64))


def rolling(values: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Fingerprint of each run of ``size`` values, by start."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for a in range(0, n, STEP):
        b = min(a + STEP, n)
        pre, inv = _prefixes(values[a : b + size - 1], which)
        out[a:b] = mix((pre[size : size + b - a] - pre[: b - a]) * inv[: b - a])
    return out


class Block:
    """Some documents: ``ids`` (``NO_ID`` where null), ``offsets`` into ``data``."""

    def __init__(self, packed: bytes):
        raw = _UNZIP.decompress(packed)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        self.ids = np.frombuffer(raw, np.int64, n, 8)
        self.offsets = np.frombuffer(raw, np.int64, n + 1, 8 + 8 * n)
        self.data = np.frombuffer(raw, np.uint8, -1, 16 + 16 * n)

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NO_ID)

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document numbers of the runs of ``[^\\x20\\x09-\\x0D]``."""
        return words_of(self.data if data is None else data, self.offsets)

    @staticmethod
    def pack(ids: list[np.ndarray], lengths: list[np.ndarray], data: list[bytes]) -> bytes:
        ids_, lens = np.concatenate(ids), np.concatenate(lengths)
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        return zstandard.ZstdCompressor(level=3).compress(b"".join([np.int64(len(ids_)).tobytes(), ids_.tobytes(), offsets.tobytes(), *data]))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    white = _WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[True], white[:-1]]) | first[:-1]
    after = np.concatenate([white[1:], [True]]) | first[1:]
    starts, ends = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes as they are."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return spans(data, starts, ends, which)


def arrow_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined bytes of a string array, without a copy where it has no
    nulls; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(col.type)
    at = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, len(col) + 1, (8 if wide else 4) * col.offset).astype(np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return np.diff(at), data


def pack_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None) -> DataFrame:
    """``(block, n, raw, data)``, written to the shared folder. A block holds
    about ``size`` bytes of text, or one document if that is longer."""
    size = size or BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        number, ids, lens, data, have = TaskContext.get().partitionId() << 32, [], [], [], 0

        def out() -> pa.RecordBatch:
            packed = Block.pack(ids, lens, data)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sum(map(len, ids))], pa.int64()), pa.array([have], pa.int64()), pa.array([packed], pa.binary())], ["block", "n", "raw", "data"])

        for b in batches:
            own = pc.fill_null(b.column(0), int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths, joined = arrow_bytes(b.column(1))
            ends, i = np.cumsum(lengths), 0
            while i < len(own):
                start = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(ends, start + max(size - have, 0), "right")))
                if have and int(ends[j - 1]) - start > size - have:  # the next document alone is too long for this block
                    yield out()
                    number, ids, lens, data, have = number + 1, [], [], [], 0
                    continue
                ids.append(own[i:j]), lens.append(lengths[i:j]), data.append(joined[start : ends[j - 1]].tobytes())
                have, i = have + int(ends[j - 1]) - start, j
                if have >= size:
                    yield out()
                    number, ids, lens, data, have = number + 1, [], [], [], 0
        if ids:
            yield out()

    return stash(small_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "block long, n long, raw long, data binary"), "blocks")


def raw_size(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("raw")).first()[0] or 0


def ranges_for(keys: float, each: int = 1 << 20, least: int = 8) -> int:
    """A power of two: key ranges of about ``each`` keys."""
    return 1 << max(int(math.log2(least)), math.ceil(math.log2(max(keys, 1) / each)))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, byte plane by byte plane."""
    return pack_array(np.diff(keys, prepend=U64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_array(packed, U64))


def pack_array(a: np.ndarray) -> bytes:
    return _ZIP.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpack_array(packed: bytes, dtype) -> np.ndarray:
    raw, size = np.frombuffer(_UNZIP.decompress(packed), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


_HEAD = struct.Struct("<QIBB")


def pack_gaps(keys: np.ndarray, zeros: int = 0) -> bytes:
    """Ascending 64-bit keys whose lowest ``zeros`` bits are 0, as Rice-coded
    differences: the low bits of each as they are, the rest in unary. Evenly spread
    keys take some hundredths of a bit more than their entropy, any others less than
    4 bits more than the logarithm of the mean difference."""
    if not len(keys):
        return b""
    gaps = (keys[1:] - keys[:-1]) >> U64(zeros)
    mean = (int(keys[-1] - keys[0]) >> zeros) / max(len(gaps), 1)
    low = int(math.log2(max(mean * math.log(2), 1)))
    ends = np.cumsum((gaps >> U64(low)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, bool)
    unary[ends] = True
    octets, (whole, rest) = gaps.view(np.uint8).reshape(-1, 8), divmod(low, 8)
    some = np.packbits(np.unpackbits(octets[:, whole : whole + 1], axis=1)[:, 8 - rest :]) if rest else unary[:0]
    return b"".join([_HEAD.pack(int(keys[0]), len(keys), zeros, low), octets[:, :whole].T.tobytes(), some.tobytes(), np.packbits(unary).tobytes()])


def unpack_gaps(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, U64)
    first, n, zeros, low = _HEAD.unpack_from(packed)
    raw, n, (whole, rest) = np.frombuffer(packed, np.uint8, -1, _HEAD.size), n - 1, divmod(low, 8)
    a, b = n * whole, n * whole + (n * rest + 7) // 8
    octets = np.zeros((n, 8), np.uint8)
    octets[:, :whole] = raw[:a].reshape(whole, n).T
    if rest:
        octets[:, whole] = np.packbits(np.unpackbits(raw[a:b], count=n * rest).reshape(n, rest), axis=1)[:, 0] >> (8 - rest)
    high = np.diff(np.flatnonzero(np.unpackbits(raw[b:])), prepend=-1) - 1
    out = np.empty(n + 1, U64)
    out[0] = first
    out[1:] = (octets.reshape(-1).view(U64) + (high.astype(U64) << U64(low))) << U64(zeros)
    return np.cumsum(out, out=out)


def pack_bits(flags: np.ndarray) -> bytes:
    return _ZIP.compress(len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes())


def unpack_bits(packed: bytes) -> np.ndarray:
    raw = _UNZIP.decompress(packed)
    return np.unpackbits(np.frombuffer(raw, np.uint8, -1, 8), count=int.from_bytes(raw[:8], "little")).astype(bool)


def parts(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """``(range, from, to)`` of ascending keys for each of ``ranges`` equal key
    ranges (a power of two) that has any."""
    if not len(keys):
        return
    of = (keys >> U64(64 - int(math.log2(ranges)))).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.diff(of, prepend=-1))
    yield from zip(of[at].tolist(), at.tolist(), np.append(at[1:], len(keys)).tolist(), strict=True)


Emit = Callable[[Block, list], Iterable[tuple[int, tuple]]]


def send(blocks: DataFrame, emit: Emit, answers: int = 0) -> DataFrame:
    """``(bucket, block, load)`` of what ``emit(block, answers)`` yields as
    (bucket, arrays packed)."""

    def run(batches):
        lean()
        for b in batches:
            for at, data, ans in rows_of(b, answers):
                got = list(emit(Block(data), ans))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int32()), pa.array([at] * len(got), pa.int64()), pa.array([pickle.dumps(x) for _, x in got], pa.binary())], ["bucket", "block", "load"])

    return blocks.mapInArrow(run, "bucket int, block long, load binary")


def rows_of(batch: pa.RecordBatch, answers: int) -> Iterator[tuple[int, bytes, list]]:
    names = batch.schema.names
    for i in range(batch.num_rows):
        ans = []
        for a in range(answers):
            got = batch.column(names.index(f"a{a}"))[i].as_py() or []
            ans.append({x["bucket"]: pickle.loads(x["load"]) for x in got})
        yield batch.column(names.index("block"))[i].as_py(), batch.column(names.index("data"))[i].as_buffer().to_pybytes(), ans


def merge(sent: DataFrame, reply: Callable[[int, list[tuple]], list], name: str) -> DataFrame:
    """``(block, bucket, load)``: for each bucket, ``reply(bucket, loads)`` gives an
    answer for each load. Written to the shared folder."""

    def run(t: pa.Table) -> pa.Table:
        lean()
        order = np.argsort(t.column("block").to_numpy(), kind="stable")
        at = [t.column("block")[int(i)].as_py() for i in order]
        bucket = t.column("bucket")[0].as_py()
        loads = [pickle.loads(t.column("load")[int(i)].as_buffer()) for i in order]
        out = reply(bucket, loads)
        return pa.table({"block": pa.array(at, pa.int64()), "bucket": pa.array([bucket] * len(at), pa.int32()), "load": pa.array([pickle.dumps(x) for x in out], pa.binary())})

    return stash(sent.groupBy("bucket").applyInArrow(run, "block long, bucket int, load binary"), name)


def with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """``blocks`` with a column ``a0``, ``a1``, ... of each one's answers."""
    for i, a in enumerate(answers):
        got = a.groupBy("block").agg(F.collect_list(F.struct("bucket", "load")).alias(f"a{i}"))
        blocks = blocks.join(got.hint("shuffle_hash"), "block", "left")
    return blocks


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Entries:
    """Distinct pairs (key, check) of a block's items, ascending, each with its
    least owner; ``back`` is the pair of each item."""

    def __init__(self, key: np.ndarray, check: np.ndarray, own: np.ndarray):
        order = np.lexsort((own, check, key))
        new = starts_of(key[order], check[order])
        self.back = np.empty(len(order), np.int64)
        self.back[order] = np.cumsum(new) - 1
        firsts = order[new]
        self.key, self.check, self.least = key[firsts], check[firsts], own[firsts]

    def loads(self, ranges: int) -> Iterator[tuple[int, tuple]]:
        for i, a, b in parts(self.key, ranges):
            yield i, (pack_sorted(self.key[a:b]), pack_array(self.check[a:b]), pack_array(self.least[a:b]))


def least_owners(loads: list[tuple]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each pair of each load (as :meth:`Entries.loads` sends them): whether all
    loads together have it with a smaller owner, and whether its key comes with
    other checks as well."""
    keys, checks, least = [unpack_sorted(x[0]) for x in loads], [unpack_array(x[1], U64) for x in loads], [unpack_array(x[2], np.int64) for x in loads]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    key, check, own = np.concatenate(keys), np.concatenate(checks), np.concatenate(least)
    del keys, checks, least
    order = np.lexsort((check, key))
    new = starts_of(key[order], check[order])
    group = np.cumsum(new) - 1
    lowest = np.minimum.reduceat(own[order], np.flatnonzero(new))
    before = np.empty(len(key), bool)
    before[order] = lowest[group] < own[order]
    name = np.cumsum(starts_of(key[order])) - 1
    many = np.bincount(name[new])
    open_ = np.empty(len(key), bool)
    open_[order] = (many > 1)[name]
    return np.split(before, ends), np.split(open_, ends)


def sketch_loads(names: np.ndarray, row: int, bits: int, ranges: int) -> Iterator[tuple[int, tuple]]:
    """One row of a block's count-min sketch of ``2**bits`` counters of 8 bits that
    stop at 255. It is kept sparse, as its counters that are not 0."""
    cells, n = np.unique(cells_of(names, row, bits), return_counts=True)
    for i, a, b in parts(cells, ranges):
        yield row * ranges + i, (pack_sorted(cells[a:b]), pack_array(np.minimum(n[a:b], 255).astype(np.uint8)))


def cells_of(names: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each name, in the upper bits."""
    return mix(names + U64(0x632BE59BD9B4E019 + 0x51ED270B * row)) & ~U64((1 << (64 - bits)) - 1)


def sketch_reply(_: int, loads: list[tuple]) -> list:
    """The sum of a range's counters over all blocks, told as "two or more"."""
    keys = [unpack_sorted(a) for a, _ in loads]
    cells, counts = np.concatenate(keys), np.concatenate([unpack_array(b, np.uint8) for _, b in loads])
    order = np.argsort(cells, kind="stable")
    new = starts_of(cells[order])
    total = np.minimum(np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new)), 255)
    flags = np.empty(len(cells), bool)
    flags[order] = (total > 1)[np.cumsum(new) - 1]
    return [pack_bits(x) for x in np.split(flags, np.cumsum([len(k) for k in keys])[:-1])]


def sketch_repeated(names: np.ndarray, answer: dict, rows: int, bits: int, ranges: int) -> np.ndarray:
    """For each of a block's names: is the least of its counters two or more?"""
    out = np.ones(len(names), bool)
    for row in range(rows):
        cells, back = np.unique(cells_of(names, row, bits), return_inverse=True)
        got = [unpack_bits(answer[row * ranges + i]) for i, _, _ in parts(cells, ranges)]
        out &= (np.concatenate(got) if got else np.zeros(0, bool))[back]
    return out
