"""Suffix dedup: bytes covered by 50-byte strings that start in an earlier document.

Two forms of one operator.

``doubled_ranks`` is distributed prefix doubling as in the textbook: a row a
position, named at first by the rank of its first 7 bytes; then, at offsets of 7,
14, 28, ... bytes, Spark sorts the pairs (rank here, rank that many bytes on) and
ranks them anew, until a position is unique or its rank covers the threshold.
Ranks are exact; no fingerprint takes part. A position costs a row of some 20
bytes in each of four sorts, which is several tens of times the input in disk
(the README has figures), so it serves texts of bounded size and as the check of
the other form.

``remove_repeated_bytes`` keeps names of growing length and dropping of unique
positions, but names a sample of positions that loses nothing, by fingerprints
instead of ranks: 25 bytes, then whole runs of neighbouring positions, then the 50
bytes where a run is still open (:mod:`boxwood.llm.repeats`).

Defined results
    null or empty text: 0 bytes, nothing removed.
    a null ``doc_id`` comes after every id; two null ids never remove each other.
    rows with the same id never remove each other's bytes.
    texts of any length are taken whole, in memory of a few times their size.
    Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwood.llm import blocks as B
from boxwood.llm import repeats
from boxwood.llm.common import stash

#: Bits kept of a gram when grams are counted: fewer can only let through more.
NAME_BITS = 40
#: Bytes of the first name: as many as a rank of 63 bits holds.
FIRST = 7


def _bytes(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    return block.data, block.offsets


def remove_repeated_bytes(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary).
    A byte goes if a string of ``size`` bytes covers it that also starts in a
    document with a smaller id."""
    packed = B.pack_blocks(docs, id_col, text_col)
    gram = max(1, size // 2)
    names = max(B.raw_size(packed) * 2 / (size - gram + 2), 1)
    ranges = (B.ranges_for(names), B.ranges_for(names / 2), B.ranges_for(names))
    task = repeats.Task(_bytes, size, gram, 1, NAME_BITS, ranges)

    def finish(batches):
        B.lean()
        for batch in batches:
            for _, data, answers in B.rows_of(batch, 3):
                block = B.Block(data)
                yield _result(block, repeats.covered(block, task, answers))

    return repeats.settle(packed, task).mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _result(block: B.Block, gone: np.ndarray) -> pa.RecordBatch:
    first = np.zeros(len(block.data) + 1, bool)
    first[block.offsets] = True
    opens = gone & (first[:-1] | ~np.concatenate([[False], gone[:-1]]))
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[block.offsets])
    n, removed, spans = np.diff(block.offsets), sums(gone), sums(opens)
    rest, ends = block.data[~gone].tobytes(), np.concatenate([[0], np.cumsum(n - removed)])
    kept = [rest[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.RecordBatch.from_arrays([block.id_array(), pa.array(n), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def doubled_ranks(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, at, rank`` of the positions whose ``size`` bytes occur elsewhere
    too: equal ranks mean equal bytes. ``row`` numbers the rows of ``docs``."""

    def positions(batches):
        for b in batches:
            lengths, data = B.arrow_bytes(b.column(2))
            ends = np.cumsum(lengths)
            for k, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
                m = n - FIRST + 1
                if n < size:
                    continue
                name, own = np.zeros(m, np.int64), data[end - n : end].astype(np.int64)
                for j in range(FIRST):
                    name = name << 8 | own[j : j + m]
                for a in range(0, m, 1 << 16):
                    c = min(a + (1 << 16), m) - a
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(c, b.column(0)[k].as_py())), pa.array([b.column(1)[k].as_py()] * c, pa.int64()), pa.array(np.arange(a, a + c)), pa.array(np.full(c, n)), pa.array(name[a : a + c])], ["row", "id", "at", "n", "rank"])

    rows = stash(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "texts")
    p = stash(rows.mapInArrow(positions, "row long, id long, at long, n long, rank long"), "positions")
    have = FIRST
    while have < size:
        step = min(have, size - have)  # the last two names may overlap
        on = p.select("row", (F.col("at") - step).alias("at"), F.col("rank").alias("then"))
        pairs = p.join(on, ["row", "at"]).filter(F.col("at") <= F.col("n") - have - step)
        # A rank is the least place of its pair in the sorted order; it only has to
        # tell pairs apart, so partitions of the range sort number on their own.
        have += step
        sums = pairs.groupBy("rank", "then").agg(F.count(F.lit(1)).alias("many"))
        place = sums.repartitionByRange("rank", "then").sortWithinPartitions("rank", "then").select("rank", "then", "many", F.monotonically_increasing_id().alias("new"))
        # What is unique goes, and with it, by the next join, all that it is a part of.
        ranked = pairs.join(stash(place, "ranks").filter("many > 1"), ["rank", "then"])
        p = stash(ranked.select("row", "id", "at", "n", F.col("new").alias("rank")), "positions")
    return p.select("row", "id", "at", "rank")


def repeated_positions(docs: DataFrame, size: int = 50) -> DataFrame:
    """``id, at`` of the positions whose ``size`` bytes also start in a document
    with a smaller id, by prefix doubling."""
    p = doubled_ranks(docs, size)
    least = p.groupBy("rank").agg(F.min("id").alias("least"))
    return p.join(least, "rank").filter(F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))).select("id", "at")


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT k, doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS m FROM (SELECT *, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
hit AS (SELECT k, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY m) AS least FROM win) WHERE coalesce(doc_id > least, least IS NOT NULL)),
isl AS (SELECT k, i, sum(CASE WHEN i <= prev + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS g FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS prev FROM hit)),
span AS MATERIALIZED (SELECT k, min(i) AS a, max(i) + 50 AS b FROM isl GROUP BY k, g),
gap AS (SELECT k, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS a, a AS b FROM span UNION ALL SELECT k, max(b), 1000000000 FROM span GROUP BY k),
rest AS (SELECT k, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM gap JOIN d USING (k) GROUP BY k),
total AS (SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY k)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN total USING (k) LEFT JOIN rest USING (k)"""
