"""Suffix and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from boxwood.llm import blocks, repeats, substring, suffixes

SCHEMA = "doc_id long, text string, n_words long, kept string"


def corpus():
    r = random.Random(5)
    words = ["ab", "cde", "f", "ghij", "é", "klm", "no", "日本"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, other = say(90), say(55)
    docs = [(7, shared), (3, say(20) + " " + shared + " " + say(10)), (5, "x " + other + "\n" + shared), (1, other), (9, other), (9, other + " tail"), (2, None), (4, ""), (None, shared), (None, shared + " z"), (8, "a" * 130), (6, "a" * 90), (11, say(49)), (12, say(3000)), (10, " \t\n ")]
    docs += [(20 + i, shared) for i in range(30)]
    return docs


def before(a, b):
    """Is id a smaller than b, null last?"""
    return a is not None and (b is None or a < b)


def brute_words(docs, size=50):
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for (i, _), w in zip(docs, split):
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), []).append(i)
    out = []
    for (i, _), w in zip(docs, split):
        gone = set()
        for p in range(len(w) - size + 1):
            if any(before(j, i) for j in first[tuple(w[p : p + size])]):
                gone.update(range(p, p + size))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def brute_bytes(docs, size=50):
    first = {}
    data = [(t or "").encode() for _, t in docs]
    for (i, _), b in zip(docs, data):
        for p in range(len(b) - size + 1):
            first.setdefault(b[p : p + size], set()).add(i)
    out = []
    for (i, _), b in zip(docs, data):
        gone = [False] * len(b)
        for p in range(len(b) - size + 1):
            if any(before(j, i) for j in first[b[p : p + size]]):
                gone[p : p + size] = [True] * size
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for k, x in enumerate(b) if not gone[k])).hexdigest()))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], SCHEMA).repartition(3)


def test_words(spark):
    docs = corpus()
    assert rows(substring.digest(frame(spark, docs))) == sorted(brute_words(docs), key=repr)


def test_bytes(spark):
    docs = corpus()
    assert rows(suffixes.digest(frame(spark, docs))) == sorted(brute_bytes(docs), key=repr)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300)
    docs = corpus()
    assert rows(suffixes.digest(frame(spark, docs))) == sorted(brute_bytes(docs), key=repr)
    assert rows(substring.digest(frame(spark, docs))) == sorted(brute_words(docs), key=repr)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring.digest(none).count() == 0 and suffixes.digest(none).count() == 0


def test_prefix_doubling(spark):
    docs = [d for d in corpus() if d[1] is None or len(d[1]) < 2000]
    data = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            data.setdefault(b[p : p + 50], []).append((i, p))
    want = sorted(((i, p) for who in data.values() for i, p in who if any(before(j, i) for j, _ in who)), key=repr)
    assert rows(suffixes.repeated_positions(frame(spark, docs))) == want
    assert suffixes.repeated_positions(frame(spark, docs[:0])).count() == 0


def test_long_and_plain_texts(spark):
    r = random.Random(3)
    deep = "".join(r.choice("ab ") for _ in range(20000))
    docs = [(1, deep), (2, deep[:9000] + "x" + deep[9000:]), (3, "a" * 30000), (4, "b" * 10 + "a" * 300), (5, " " * 5000), (6, " " * 60), (7, deep[5000:5049]), (8, deep[5000:5050])]
    assert rows(suffixes.digest(frame(spark, docs))) == sorted(brute_bytes(docs), key=repr)
    assert rows(substring.digest(frame(spark, docs))) == sorted(brute_words(docs), key=repr)


@pytest.mark.parametrize("step", [64, 1 << 17])
def test_names(monkeypatch, step):
    monkeypatch.setattr(blocks, "STEP", step)
    blocks._usual.cache_clear()
    r = np.random.default_rng(2)
    data = r.integers(0, 2, 3000).astype(np.uint8)
    for size in (1, 7, 50):
        got = blocks.rolling(data, size)
        same = {}
        for i, h in enumerate(got.tolist()):
            same.setdefault(h, set()).add(data[i : i + size].tobytes())
        assert len(got) == 3000 - size + 1 and all(len(x) == 1 for x in same.values())
        assert len(same) == len({data[i : i + size].tobytes() for i in range(len(got))})
    starts = np.sort(r.integers(0, 2900, 200))
    ends = np.minimum.accumulate((starts + 40)[::-1])[::-1]
    got = blocks.spans(data, starts, ends)
    assert len({(a, b) for a, b in zip(got.tolist(), (data[s:e].tobytes() for s, e in zip(starts, ends)))}) == len(set(got.tolist()))
    blocks._usual.cache_clear()


def test_runs_cover_all_strings():
    r = np.random.default_rng(5)
    data = r.integers(97, 100, 4000).astype(np.uint8)
    bounds = np.array([0, 10, 10, 900, 2000, 4000])
    got = repeats.runs_of(data, bounds, np.arange(5), 50, 25)
    places = [p for a, b in zip(got.lo, got.hi) for p in range(a, b + 1)]
    assert places == [p for a, b in zip(bounds[:-1], bounds[1:]) for p in range(a, b - 49)]
    assert len(got.lo) < 0.12 * len(places)
