"""Strings of ``size`` symbols that also start in a document with a smaller id.

Symbols are bytes or word fingerprints. One name for every position does not fit
a disk budget of a few times the input, so positions are sampled without loss: in
each string of ``size`` symbols the least fingerprint of its ``gram``-long
substrings stands for it. Equal strings have equal least grams, neighbouring
strings mostly share theirs, and a *run* is a stretch of neighbours that do: about
one run for ``(size - gram + 2) / 2`` positions. Names get longer in rounds, and
what is unique drops out before the next:

1. grams (``gram`` symbols): runs whose gram occurs once in the corpus are unique,
   as are all their strings. Counting may overestimate and loses none.
2. whole runs (up to ``2 * size - gram`` symbols): equal runs have equal strings at
   equal places, so the smallest document of a group of equal runs settles all the
   strings of the others. A gram all of whose runs are equal is settled.
3. strings of ``size`` symbols, of the runs that are still open only: those at the
   ends of repeated stretches. They are grouped exactly, by gram and string.

Equality is that of two independent 64-bit fingerprints (the gram's and the longer
name's).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from boxwood.llm import blocks as B

#: Strings that are named at a time.
CHUNK = 1 << 17

Symbols = Callable[[B.Block], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Task:
    """What is compared, and how many key ranges each round has."""

    symbols: Symbols
    size: int
    gram: int
    rows: int
    bits: int
    ranges: tuple[int, int, int]


@dataclass
class Runs:
    """Places of the first and last string of each run, its name and its document's id."""

    lo: np.ndarray
    hi: np.ndarray
    name: np.ndarray
    own: np.ndarray

    def take(self, which: np.ndarray) -> Runs:
        return Runs(self.lo[which], self.hi[which], self.name[which], self.own[which])


def _least_of(names: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive names, by doubling."""
    out, have = names, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def runs_of(values: np.ndarray, bounds: np.ndarray, ids: np.ndarray, size: int, gram: int) -> Runs:
    """All runs of a block. ``bounds``: where documents begin, and the end."""
    n = len(values) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Runs(none, none, np.zeros(0, B.U64), none)
    fits = np.ones(n, bool)
    for end in bounds[1:].tolist():
        fits[max(0, end - size + 1) : end] = False
    los, names, last, went = [], [], B.U64(0), False
    for a in range(0, n, B.STEP):
        b = min(a + B.STEP, n)
        least = _least_of(B.rolling(values[a : b + size - 1], gram), size - gram + 1)
        ok = fits[a:b]
        new = ok.copy()
        new[1:] &= ~(ok[:-1] & (least[1:] == least[:-1]))
        new[0] &= not (went and least[0] == last)
        last, went = least[-1], bool(ok[-1])
        at = np.flatnonzero(new)
        los.append(at + a)
        names.append(least[at])
    lo = np.concatenate(los)
    doc = np.searchsorted(bounds, lo, "right") - 1
    hi = np.minimum(np.append(lo[1:], n) - 1, bounds[doc + 1] - size)
    # Least names crowd near zero; mixed again they spread over the ranges.
    return Runs(lo, hi, B.mix(np.concatenate(names) + B.U64(0xD6E8FEB86659FD93)), ids[doc])


def strings(values: np.ndarray, runs: Runs, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, B.Entries]]:
    """Places, owners and distinct names of all strings of ``runs``, some runs at a
    time in the order of their grams; equal grams are never apart."""
    order = np.argsort(runs.name, kind="stable")
    many = (runs.hi - runs.lo + 1)[order]
    ends, new, i = np.cumsum(many), B.starts_of(runs.name[order]), 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, "right")))
        while j < len(order) and not new[j]:
            j += 1
        part = np.sort(order[i:j])
        n = (runs.hi - runs.lo + 1)[part]
        place = np.repeat(runs.lo[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
        own = np.repeat(runs.own[part], n)
        yield place, own, B.Entries(np.repeat(runs.name[part], n), B.spans(values, place, place + size, 1), own)
        i = j


class View:
    """A block as far as the answers to it go: what is settled, what is open."""

    def __init__(self, block: B.Block, task: Task, answers: list[dict]):
        self.task = task
        self.values, self.bounds = task.symbols(block)
        self.runs = runs_of(self.values, self.bounds, block.ids, task.size, task.gram)
        self.hit = np.zeros(0, bool)
        if answers:
            self.runs = self.runs.take(B.sketch_repeated(self.runs.name, answers[0], task.rows, task.bits, task.ranges[0]))
            r = self.runs
            self.entries = B.Entries(r.name, B.spans(self.values, r.lo, r.hi + task.size, 1), r.own)
        if len(answers) > 1:
            got = [answers[1][i] for i, _, _ in B.parts(self.entries.key, task.ranges[1])]
            before, more = (np.concatenate([B.unpack_bits(x[k]) for x in got]) if got else np.zeros(0, bool) for k in (0, 1))
            back = self.entries.back
            self.hit = before[back] | (r.own > self.entries.least[back])
            self.open = r.take(more[back] & ~self.hit)

    def covered(self, answer: dict) -> np.ndarray:
        """Which symbols a string covers that starts in an earlier document."""
        size, told = self.task.size, {i: iter(x) for i, x in answer.items()}
        change = np.zeros(len(self.values) + 1, np.int32)
        change[self.runs.lo[self.hit]] += 1
        change[self.runs.hi[self.hit] + size] -= 1
        for place, own, e in strings(self.values, self.open, size):
            before = np.concatenate([B.unpack_bits(next(told[i])) for i, _, _ in B.parts(e.key, self.task.ranges[2])])
            hit = place[before[e.back] | (own > e.least[e.back])]
            change[hit] += 1
            change[hit + size] -= 1
        return np.cumsum(change[:-1]) > 0


def settle(packed: DataFrame, task: Task) -> DataFrame:
    """``packed`` with the answers of the three rounds (``a0``, ``a1``, ``a2``)."""

    def grams(block, _):
        values, bounds = task.symbols(block)
        names = runs_of(values, bounds, block.ids, task.size, task.gram).name
        for row in range(task.rows):
            yield from B.sketch_loads(names, row, task.bits, task.ranges[0])

    def runs(block, answers):
        yield from View(block, task, answers).entries.loads(task.ranges[1])

    def run_reply(_, loads):
        return [tuple(map(B.pack_bits, x)) for x in zip(*B.least_owners(loads), strict=True)]

    def open_strings(block, answers):
        view, out = View(block, task, answers), {}
        for _, _, e in strings(view.values, view.open, task.size):
            for i, load in e.loads(task.ranges[2]):
                out.setdefault(i, []).append(load)
        yield from out.items()

    def string_reply(_, loads):
        flags = iter(B.least_owners([piece for load in loads for piece in load])[0])
        return [[B.pack_bits(next(flags)) for _ in load] for load in loads]

    first = B.merge(B.send(packed, grams), B.sketch_reply, "grams")
    second = B.merge(B.send(B.with_answers(packed, first), runs, 1), run_reply, "runs")
    third = B.merge(B.send(B.with_answers(packed, first, second), open_strings, 2), string_reply, "strings")
    return B.with_answers(packed, first, second, third)


def covered(block: B.Block, task: Task, answers: list[dict]) -> np.ndarray:
    """The symbols of a block that go."""
    return View(block, task, answers[:2]).covered(answers[2])
