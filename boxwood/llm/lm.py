"""Language-model scores from a log-frequency Bloom filter.

Word counts of the training documents are exact: each block sends its distinct
words with their counts once and receives the corpus counts of those words. Word
pairs and triples, those seen once too, go into a Bloom filter by the level of
their count (``DOWN``: 1, 2, 3, 4, 6, 8, 12, ...): an n-gram of level q is inserted
as (n-gram, 1) ... (n-gram, q), and its level is read back by probing until one is
missing. The filter is built in segments by key range, one task each, always at
``BITS_PER_ENTRY`` bits an entry, so its error rate is the same at every size.

A filter holds an entry for each distinct n-gram, so it grows with the corpus. Up
to ``BROADCAST_RAW`` bytes of text, which bound it to about three times as many,
its segments are broadcast to the workers. Beyond, the probes go to the segments:
each block's n-grams are sent by key range to where the range's segment is built
and probed. Both ways make the same probes of the same bits.

The model interpolates, with c' the level's lower and C' its upper count:
``p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))``
``p2(w | v) = (min(c'(v w), c(v)) + K p1(w)) / (c(v) + K)``
``p3(w | u v) = (min(c'(u v w), C'(u v)) + K p2(w | v)) / (C'(u v) + K)``
Lower counts above and upper ones below make sums over all words at most 1, but
for false hits of the filter.

Defined results
    null or empty text: one token (the end).
    a null ``doc_id`` has the empty string as its text form, so it is held out.
    repeated rows and ids count and are scored each on their own; extra columns
    are ignored. An empty training part gives N = V = 0 and finite scores.
"""

from __future__ import annotations

import math
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxwood.llm import blocks as B
from boxwood.llm.common import shuffles_freed, stash

END, START = B.U64(0xE3D0C2B1A4958677), B.U64(0x1F2E3D4C5B6A7988)
PROBES, BITS_PER_ENTRY, PRIOR, ALPHA = 4, 12, 4.0, 0.1
#: N-grams of a block outweigh its text, so blocks are smaller here.
BLOCK_BYTES, RANGE_KEYS = 2 << 20, 1 << 19
#: An array of a block's keys in a range should have so many keys. Ranges grow for
#: that with the corpus, up to ``MOST_KEYS``, which is what a task has to hold.
ARRAY_KEYS, MOST_KEYS = 1 << 8, 1 << 22
BROADCAST_RAW = 64 << 20
#: The least count of each level; 0 is "not there".
DOWN = np.array([0, 1, 2, 3, *(x << k for k in range(1, 40) for x in (2, 3))], np.int64)
UP = np.append(DOWN[1:] - 1, DOWN[-1])


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == B.NO_ID else str(i).encode()) % 10 == 0 for i in ids.tolist()], bool)


def _tokens(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in order, one end after each document's words; their documents."""
    data = B.lower_bytes(block.data)
    starts, ends, doc = B.words_of(data, block.offsets)
    n = np.bincount(doc, minlength=len(block))
    token, of = np.empty(len(starts) + len(block), B.U64), np.empty(len(starts) + len(block), np.int64)
    at, last = np.arange(len(starts)) + doc, np.cumsum(n) + np.arange(len(block))
    token[at], of[at] = B.word_hashes(data, starts, ends), doc
    token[last], of[last] = END, np.arange(len(block))
    return token, of


def _grams(token: np.ndarray, of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pair and of the triple that end at each token. A document's first
    token has no triple: its key is that of its pair."""
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    before = np.concatenate([[START], token[:-1]])[: len(token)]
    before[first] = START
    pair = B.mix(before * B.U64(0x9E3779B97F4A7C15) + token)
    triple = B.mix(np.concatenate([[START], pair[:-1]])[: len(pair)] * B.U64(0xC2B2AE3D27D4EB4F) + token)
    triple[first] = pair[first]
    mask = ~B.U64((1 << (64 - bits)) - 1)
    return pair & mask, triple & mask


def _spread(keys: np.ndarray) -> np.ndarray:
    return B.mix(keys + B.U64(0x2545F4914F6CDD1D))


def _place(key: np.ndarray, level: int, probe: int, mask: np.ndarray | int) -> np.ndarray:
    return B.mix(key + B.U64((level * 0x9E3779B97F4A7C15 + probe * 0xC2B2AE3D27D4EB4F) % (1 << 64))) & mask


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their total counts, and where each given key is among them."""
    u, back = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(back, np.concatenate(counts), len(u)).astype(np.int64), back


def build_segment(keys: np.ndarray, counts: np.ndarray, entry_bits: int = BITS_PER_ENTRY) -> np.ndarray:
    """The filter of one key range: a power of two of bits, as bytes."""
    levels = np.searchsorted(DOWN, counts, "right") - 1
    bits = 1 << max(10, math.ceil(math.log2(max(int(levels.sum()), 1) * entry_bits)))
    flags = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        some = keys[levels >= level]
        for probe in range(PROBES):
            flags[_place(some, level, probe, B.U64(bits - 1))] = True
    return np.packbits(flags, bitorder="little")


def probe_segment(segment: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level read back for each key: probes go on until one is missing."""
    out, left, mask = np.zeros(len(keys), np.uint8), np.arange(len(keys)), B.U64(8 * len(segment) - 1)
    for level in range(1, len(DOWN)):
        for probe in range(PROBES):
            bit = _place(keys[left], level, probe, mask)
            left = left[(segment[(bit >> B.U64(3)).astype(np.int64)] >> (bit & B.U64(7)).astype(np.uint8)) & 1 == 1]
        if not len(left):
            break
        out[left] = level
    return out


def interpolate(p1: np.ndarray, pair: np.ndarray, context: np.ndarray, triple: np.ndarray, history: np.ndarray) -> np.ndarray:
    """``p3`` from ``p1``, the levels of the pair, of the triple and of the triple's
    history, and the exact count of the pair's first word."""
    p2 = (np.minimum(DOWN[pair], context) + PRIOR * p1) / (context + PRIOR)
    return (np.minimum(DOWN[triple], UP[history]) + PRIOR * p2) / (UP[history] + PRIOR)


def ranges_of(total: int, bytes_a_key: int, each: int) -> int:
    """Key ranges of about ``each`` keys of all blocks' ``total`` bytes; fewer and
    larger where a block's arrays would get short."""
    keys, block = total / bytes_a_key, BLOCK_BYTES / bytes_a_key
    return B.ranges_for(keys, max(each, min(MOST_KEYS, keys * ARRAY_KEYS / block)))


def _counts(packed: DataFrame, ranges: int) -> tuple[DataFrame, int, int]:
    """Answers with each block's words' training counts; N and V."""

    def words(block, _):
        token, of = _tokens(block)
        u, back = np.unique(_spread(token), return_inverse=True)
        n = np.bincount(back[~held_out(block.ids)[of]], minlength=len(u)).astype(np.int64)
        for i, a, b in B.parts(u, ranges):
            yield i, (B.pack_gaps(u[a:b]), B.pack_array(n[a:b]))

    def counted(_, loads):
        keys = [B.unpack_gaps(a) for a, _ in loads]
        _, sums, back = _sums(keys, [B.unpack_array(b, np.int64) for _, b in loads])
        each = np.split(sums[back], np.cumsum([len(k) for k in keys])[:-1])
        return [(B.pack_array(p), (int(sums.sum()), int((sums > 0).sum())) if i == 0 else (0, 0)) for i, p in enumerate(each)]

    def totals(batches):
        for b in batches:
            got = [pickle.loads(x.as_buffer())[1] for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x for x, _ in got)], pa.int64()), pa.array([sum(y for _, y in got)], pa.int64())], ["n", "v"])

    with shuffles_freed(packed.sparkSession):
        counts = B.merge(B.send(packed, words), counted, "counts")
    row = counts.select("load").mapInArrow(totals, "n long, v long").groupBy().sum("n", "v").first()
    return counts, row[0] or 0, row[1] or 0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", entry_bits: int = BITS_PER_ENTRY) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    packed = B.pack_blocks(docs, id_col, text_col, BLOCK_BYTES)
    total = max(B.raw_size(packed), 1)
    ranges, gram_ranges = ranges_of(total, 20, 1 << 20), ranges_of(total, 4, RANGE_KEYS)
    bits = min(64, math.ceil(math.log2(total)) + 20)
    counts, n_train, n_distinct = _counts(packed, ranges)
    shared = total <= BROADCAST_RAW

    def grams(block, _):
        token, of = _tokens(block)
        trained = ~held_out(block.ids)[of]
        keys = np.concatenate(_grams(token, of, bits))
        u, back = np.unique(keys, return_inverse=True)
        # A first token's pair stands for its triple as well; it counts once.
        once = np.concatenate([trained, trained & (keys[len(of) :] != keys[: len(of)])])
        n = np.bincount(back[once], minlength=len(u))
        if shared:
            u, n = u[n > 0], n[n > 0]
        for i, a, b in B.parts(u, gram_ranges):
            yield i, (B.pack_gaps(u[a:b], 64 - bits), B.pack_array(n[a:b].astype(np.uint32)))

    def segment_of(loads):
        keys = [B.unpack_gaps(a) for a, _ in loads]
        u, n, back = _sums(keys, [B.unpack_array(b, np.uint32) for _, b in loads])
        return build_segment(u[n > 0], n[n > 0], entry_bits), u, np.split(back, np.cumsum([len(k) for k in keys])[:-1])

    def probed(_, loads):
        segment, u, backs = segment_of(loads)
        levels = probe_segment(segment, u)
        return [B.pack_array(levels[back]) for back in backs]

    def built(t: pa.Table) -> pa.Table:
        B.lean()
        segment = segment_of([pickle.loads(x.as_buffer()) for x in t.column("load")])[0]
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "bits": pa.array([segment.tobytes()], pa.binary())})

    sent = B.send(packed, grams)
    if shared:
        with shuffles_freed(docs.sparkSession):
            rows = stash(sent.groupBy("bucket").applyInArrow(built, "bucket int, bits binary"), "segments").toLocalIterator()
        held = docs.sparkSession.sparkContext.broadcast({r.bucket: np.frombuffer(bytes(r.bits), np.uint8) for r in rows})
        answered, answers = B.with_answers(packed, counts), 1
    else:
        held = None
        with shuffles_freed(docs.sparkSession):
            levels = B.merge(sent, probed, "levels")
        answered, answers = B.with_answers(packed, counts, levels), 2
    den = n_train + ALPHA * (n_distinct + 1)

    def level_of(u: np.ndarray, i: int, a: int, b: int, told: dict) -> np.ndarray:
        if held is None:
            return B.unpack_array(told[i], np.uint8)
        segment = held.value.get(i)
        return probe_segment(segment, u[a:b]) if segment is not None else np.zeros(b - a, np.uint8)

    def finish(batches):
        B.lean()
        for batch in batches:
            for _, data, told in B.rows_of(batch, answers):
                yield _result(B.Block(data), told)

    def _result(block: B.Block, told: list[dict]) -> pa.RecordBatch:
        token, of = _tokens(block)
        u, back = np.unique(_spread(token), return_inverse=True)
        got = [B.unpack_array(told[0][i][0], np.int64) for i, _, _ in B.parts(u, ranges)]
        c = np.concatenate([*got, np.zeros(0, np.int64)])[back]
        first = np.ones(len(of), bool)
        first[1:] = of[1:] != of[:-1]
        context = np.concatenate([[0], c[:-1]])[: len(c)]
        context[first] = c[token == END][:1]  # as many starts as ends
        u, back = np.unique(np.concatenate(_grams(token, of, bits)), return_inverse=True)
        level = np.concatenate([*(level_of(u, i, a, b, told[-1]) for i, a, b in B.parts(u, gram_ranges)), np.zeros(0, np.uint8)])[back]
        pair, triple = level[: len(of)], level[len(of) :]
        history = np.concatenate([np.zeros(1, np.uint8), pair[:-1]])[: len(of)]
        history[first] = 0  # a first token has its pair alone
        p1 = (c + ALPHA) / den
        p = interpolate(p1, pair, context, triple, history)
        per = lambda x: np.bincount(of, weights=x, minlength=len(block))
        ints = lambda x: per(x).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [block.id_array(), pa.array(held_out(block.ids)), pa.array(ints(np.ones(len(of)))), pa.array(ints(c > 0)), pa.array(np.full(len(block), n_train, np.int64)), pa.array(per(np.log10(p1))), pa.array(per(np.log10(p)))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return answered.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
