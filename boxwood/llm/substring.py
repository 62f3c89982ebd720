"""Substring dedup: exact repeats of 50-word windows behind a count-min sketch.

1. Each block of documents counts its windows in a count-min sketch of ``DEPTH``
   rows of 8-bit counters whose width follows the corpus (``CELLS`` counters a
   name). What is counted for a window is its least gram of ``GRAM`` words, which
   neighbouring windows share, so a name stands for some 13 windows; a window
   never occurs more often than its gram, and no counter is less than its names'
   count. Sketches of all blocks are merged by adding counters. Windows whose
   least counter says 1 are unique and drop out; none that repeats is lost.
2. Windows estimated repeated are grouped exactly (:mod:`boxwood.llm.repeats`,
   rounds 2 and 3), and the smallest document of each group is found.

Defined results
    null or empty text: no words, nothing removed, ``kept`` empty.
    a null ``doc_id`` comes after every id; two null ids never remove each other.
    rows with the same id never remove each other's words.
    texts of any length are taken whole, in memory of a few times their size.
    Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwood.llm import blocks as B
from boxwood.llm import repeats

CELLS, DEPTH, GRAM = 8, 2, 25


def _words(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words, and where documents begin among them."""
    starts, ends, doc = block.words()
    return B.word_hashes(block.data, starts, ends), np.searchsorted(doc, np.arange(len(block) + 1)).astype(np.int64)


def remove_repeated_windows(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept`` (the kept words
    joined by one space). A word goes if a window of ``size`` words covers it
    whose word sequence also starts in a document with a smaller id."""
    packed = B.pack_blocks(docs, id_col, text_col)
    names = max(B.raw_size(packed) / 5 * 2 / (size - min(GRAM, size) + 2), 1)
    bits = min(60, max(16, math.ceil(math.log2(names * CELLS))))
    ranges = (B.ranges_for(names), B.ranges_for(names), B.ranges_for(names * 2))
    task = repeats.Task(_words, size, min(GRAM, size), DEPTH, bits, ranges)

    def finish(batches):
        B.lean()
        for batch in batches:
            for _, data, answers in B.rows_of(batch, 3):
                block = B.Block(data)
                yield _result(block, repeats.covered(block, task, answers))

    return repeats.settle(packed, task).mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")


def _result(block: B.Block, gone: np.ndarray) -> pa.RecordBatch:
    starts, ends, doc = block.words()
    n = np.bincount(doc, minlength=len(block)).astype(np.int64)
    removed = np.bincount(doc[gone], minlength=len(block)).astype(np.int64)
    first, kept = np.concatenate([[0], np.cumsum(n)]), []
    for i in range(len(block)):
        if removed[i]:
            own = slice(first[i], first[i + 1])
            left = ~gone[own]
            at, text = int(block.offsets[i]), block.text(i)
            kept.append(b" ".join([text[s:e] for s, e in zip((starts[own][left] - at).tolist(), (ends[own][left] - at).tolist(), strict=True)]))
        else:
            kept.append(b" ".join(block.text(i).split()))
    return pa.RecordBatch.from_arrays([block.id_array(), pa.array(n), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT k, doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
hit AS (SELECT k, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE coalesce(doc_id > m, m IS NOT NULL)),
gone AS (SELECT DISTINCT k, pos FROM (SELECT k, unnest(range(i, i + 50)) AS pos FROM hit)),
g AS (SELECT k, list(pos) AS ps FROM gone GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (k)"""
