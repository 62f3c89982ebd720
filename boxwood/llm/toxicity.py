"""Toxicity by a weighted finite-state pattern grammar.

Words of a clause become symbols (sure or likely insult, threat, target, negation,
reported speech, other) and small transducers, composed into two machines, read
them. From left to right negation, reported speech and targets mark the insults
and threats that they reach; from right to left targets mark those before them;
then the insult and threat transducers emit, on weighted arcs, one event for each
marked symbol: plain, targeted, negated, quoted, threat, likely, doubtful. (A left
and a right sequential machine one after the other is the general form of a
rational function.)

A clause is scored as a whole, by its strongest event and whether it has several;
a document by its numbers of clauses of each kind and their share of its words.

The insult lexicon has two grades, each of words and stems: sure ones, which clean
texts hardly have, and likely ones, which are many times as frequent in texts of
label 1 but occur in clean ones too. Lexicon and weights are learned from labelled
training rows: those whose crc32(doc_id as text) mod 4 is not 2. The fit reads a
bounded sample of them (``SAMPLE`` rows, ``SAMPLE_BYTES`` of text in expectation,
both documented parameters); every text is scored whole.

Defined results
    null or empty text: the score of a text without matches.
    null ``doc_id``: its text form is the empty string, so it is not held out;
    unlabelled rows and null labels teach nothing. Repeated rows are scored each;
    a text that is labelled both ways counts as label 1.
    Without usable labels the seed lexicon and fixed weights are used.
    texts of any length are scored whole. Extra columns are ignored, or kept as they
    are where rows are filtered.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwood.llm.blocks import lean
from boxwood.llm.common import small_batches, stash

SAMPLE, SAMPLE_BYTES, THRESHOLD = 8000, 32 << 20, 0.3
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting")
THREATS = frozenset("kill hurt destroy murder stab shoot beat töten umbringen verletzen tuer blesser frapper matar herir golpear".split())
TARGETS = frozenset("you your yours u they them he she du dich dir euch ihr tu te toi vous tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never isnt arent dont nicht kein keine nie pas jamais aucun nunca jamás ningún".split())
REPORTS = frozenset("said says say wrote claimed quoted sagte sagt schrieb dit disait écrit dijo dice escribió".split())
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Words that negation reaches, and that a target may stand off.
REACH, NEAR = 3, 4
#: From the strongest to the weakest.
EVENTS = ("threat", "targeted", "plain", "quoted", "negated", "likely", "doubtful")
FEATURES = (*EVENTS, "several", "share")
#: A likely form is at least so many times as frequent in texts of label 1.
RATIO = 10

Symbol = tuple[str, frozenset[str]]
Step = Callable[[Hashable, Symbol], tuple[Hashable, Symbol, float]]
NONE: frozenset[str] = frozenset()
KINDS = ("other", "sure", "maybe", "menace", "target", "negation", "report")
MARKED = ("sure", "maybe", "menace")


class Transducer:
    """Letter to letter and deterministic. ``step(state, symbol)`` is the arc's end,
    output and weight; ``compiled`` has the arcs that can be reached."""

    def __init__(self, start: Hashable, step: Step):
        self.start, self.step = start, step

    def compose(self, then: Transducer) -> Transducer:
        """The machine that feeds ``then`` with what this one writes."""

        def step(state, symbol):
            a, b = state
            a, middle, w = self.step(a, symbol)
            b, out, v = then.step(b, middle)
            return (a, b), out, w + v

        return Transducer((self.start, then.start), step)

    def compiled(self, alphabet: Iterable[Symbol]) -> dict[Hashable, dict[Symbol, tuple]]:
        arcs, todo, alphabet = {}, [self.start], list(alphabet)
        while todo:
            state = todo.pop()
            if state not in arcs:
                arcs[state] = {x: self.step(state, x) for x in alphabet}
                todo += [arc[0] for arc in arcs[state].values()]
        return arcs


def _marker(trigger: str, reach: int | None, mark: str) -> Transducer:
    """Marks what stands up to ``reach`` words after a trigger (None: up to the end)."""

    def step(left, x):
        kind, marks = x
        out = (kind, marks | {mark}) if left and kind in MARKED else x
        if kind == trigger:
            return (1 if reach is None else reach), out, 0.0
        return (left if reach is None else max(0, left - 1)), out, 0.0

    return Transducer(0, step)


def _emitter(kinds: tuple[str, ...], event: Callable[[str, frozenset[str]], str | None], weights: dict[str, float]) -> Transducer:
    def step(state, x):
        name = event(*x) if x[0] in kinds else None
        return (state, (name, NONE), weights.get(name, 0.0)) if name else (state, x, 0.0)

    return Transducer(0, step)


def _insult(kind: str, marks: frozenset[str]) -> str:
    if kind == "maybe":
        return "doubtful" if marks & {"negated", "quoted"} else "likely"
    return next((e for m, e in (("negated", "negated"), ("quoted", "quoted"), ("aimed", "targeted")) if m in marks), "plain")


def _threat(kind: str, marks: frozenset[str]) -> str | None:
    return "threat" if marks == {"aimed"} else None


@dataclass
class Grammar:
    words: frozenset[str] = frozenset(SEEDS)
    stems: tuple[str, ...] = ()
    likely: frozenset[str] = frozenset()
    likely_stems: tuple[str, ...] = ()
    #: By feature: of the logarithm of one more than the number of clauses.
    weights: dict[str, float] = field(default_factory=lambda: dict(zip(FEATURES, (2.5, 2.5, 2.0, 1.0, 0.5, 1.0, 0.5, 0.5, 0.5), strict=True)))
    bias: float = -4.0

    @cached_property
    def machines(self) -> tuple[dict, dict]:
        """What reads a clause from the left, and what then reads it from the right;
        both start in the state they were built with."""
        left = _marker("negation", REACH, "negated").compose(_marker("report", None, "quoted")).compose(_marker("target", NEAR, "aimed"))
        right = _marker("target", NEAR, "aimed").compose(_emitter(("sure", "maybe"), _insult, self.weights)).compose(_emitter(("menace",), _threat, self.weights))
        a = left.compiled((k, NONE) for k in KINDS)
        b = right.compiled({arc[1] for arcs in a.values() for arc in arcs.values()})
        return (left.start, a), (right.start, b)

    @cached_property
    def first(self) -> re.Pattern:
        """Finds texts in which some transducer can emit at all."""
        whole, begun = self.words | self.likely | THREATS, {*self.stems, *self.likely_stems}
        some = [re.escape(w) + r"(?![^\W\d_])" for w in sorted(whole)] + [re.escape(s) for s in sorted(begun)]
        return re.compile(r"(?<![^\W\d_])(?:" + "|".join(some) + ")")

    def kind(self, word: str) -> str:
        if word in self.words or word.startswith(self.stems):
            return "sure"
        if word in self.likely or word.startswith(self.likely_stems):
            return "maybe"
        return next((k for k, some in (("menace", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) if word in some), "other")

    def read(self, words: list[str], known: dict[str, str] | None = None) -> tuple[Counter, float]:
        """The events that the machines emit for a clause, in numbers, and the weight
        of the path they take."""
        known = {} if known is None else known
        (state, arcs), (back, arcs_back) = self.machines
        out, found, weight = [], Counter(), 0.0
        for w in words:
            kind = known.get(w)
            if kind is None:
                kind = known[w] = self.kind(w)
            state, x, v = arcs[state][kind, NONE]
            weight += v
            out.append(x)
        for x in reversed(out):
            back, (name, _), v = arcs_back[back][x]
            weight += v
            if name in EVENTS:
                found[name] += 1
        return found, weight

    def matches(self, text: str) -> list[tuple[str, dict[str, int], float]]:
        """The matched clauses of a text: words, events and path weight."""
        each = ((words := WORD.findall(c), *self.read(words)) for c in CLAUSE.split(text.lower()))
        return [(" ".join(words), dict(found), weight) for words, found, weight in each if found]

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        text = text.lower()
        if not self.first.search(text):
            return out
        n, emitted, known = 0, 0, {}
        for clause in CLAUSE.split(text):
            words = WORD.findall(clause)
            n += len(words)
            if self.first.search(clause) and (found := self.read(words, known)[0]):
                out[next(i for i, e in enumerate(EVENTS) if found[e])] += 1
                out[-2] += found.total() > 1
                emitted += found.total()
        out[-1] = 100 * emitted / max(n, 1)
        return out

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.bias + np.log1p(features) @ np.array([self.weights[f] for f in FEATURES])))))


def lexicon(texts: list[str], labels: list[int], least: int = 5, precision: float = 0.98) -> tuple[frozenset[str], tuple[str, ...], frozenset[str], tuple[str, ...]]:
    """Sure words and stems, likely words and stems: forms that mark label 1, chosen
    by greedy cover of its texts, the sure ones first. A form is sure if texts of
    label 1 are ``precision`` of those that have it, likely if label 1 has it
    ``RATIO`` times as often per word."""

    def forms(text: str) -> Counter:
        out: Counter = Counter()
        words = Counter(WORD.findall(text.lower()))
        out[""] = words.total()
        for w, k in words.items():
            if len(w) > 2:
                out[w] += k
            for n in (4, 5, 6):
                if len(w) >= n:
                    out[w[:n] + "*"] += k
        return out

    # Texts are read one at a time and only counts are kept: first how many texts
    # of label 1 have a form, then, for those that enough have, what the others do.
    marked = [t for t, y in zip(texts, labels, strict=True) if y]
    count: Counter = Counter()
    for t in marked:
        count.update(forms(t).keys())
    seen = {x for x, n in count.items() if x and n >= least}
    del count
    docs, uses, total = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    for t, y in zip(texts, labels, strict=True):
        got, y = forms(t), int(bool(y))
        total[y] += got[""]
        for x in seen & got.keys():
            docs[y][x] += 1
            uses[y][x] += got[x]
    sure = {x for x in seen if docs[1][x] >= precision * (docs[1][x] + docs[0][x])}
    often = {x for x in seen - sure if uses[1][x] * max(total[0], 1) >= RATIO * uses[0][x] * max(total[1], 1)}
    where: dict[str, set[int]] = {x: set() for x in sure | often}
    for i, t in enumerate(marked):
        for x in where.keys() & forms(t).keys():
            where[x].add(i)
    chosen: tuple[list[str], list[str]] = ([], [])
    # Likely forms have a cover of their own: their counts matter where a sure form is too.
    for grade, some in enumerate((sure, often)):
        left, open_ = set(range(len(marked))), set(some)
        while open_ and left:
            best = max(open_, key=lambda x: (len(where[x] & left), docs[1][x] - docs[0][x], len(x), x))
            if len(where[best] & left) < least:
                break
            chosen[grade].append(best)
            left -= where[best]
            open_.remove(best)
        if not grade:  # sure words that the cover made redundant still mark other texts
            chosen[0].extend(x for x in sorted(open_, key=lambda x: -docs[1][x]) if not x.endswith("*") and docs[1][x] >= 4 * least)
    split = lambda xs: (frozenset(x for x in xs if not x.endswith("*")), tuple(x[:-1] for x in xs if x.endswith("*")))
    return *split(chosen[0]), *split(chosen[1])


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 25) -> tuple[list[float], float]:
    """Ridge logistic regression on log(1 + count), by Newton steps."""
    a = np.hstack([np.log1p(x), np.ones((len(x), 1))])
    w, penalty = np.zeros(a.shape[1]), np.diag([ridge * 10] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
        w = w - step
    return [float(v) for v in w[:-1]], float(w[-1])


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Fit on about ``sample`` labelled rows, or ``SAMPLE_BYTES`` of text if that is
    less, picked by a hash of the id. The result depends on the rows alone, not on
    their order. Only ids and numbers are joined by exchange: the picked ids, about
    ``sample``, are broadcast, and no text but theirs is moved."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    marked = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    by_id = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    usable = stash(by_id.join(marked, "doc_id").select("doc_id", "n", "size", "toxic"), "toxicity-ids")
    n, total = usable.agg(F.sum("n"), F.sum("size")).first()
    share = min(1.0, sample / max(n or 0, 1), SAMPLE_BYTES / max(total or 0, 1))
    some = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else usable
    picked = known.filter(F.octet_length("text") <= SAMPLE_BYTES // 8).join(F.broadcast(some.select("doc_id", "toxic")), "doc_id")
    label: dict[str, int] = {}
    # Dealt anew, or each small part of ``docs`` would be read in its turn.
    for r in picked.select("text", "toxic").hint("rebalance").toLocalIterator():
        label[r.text] = max(label.get(r.text, 0), int(r.toxic))
    texts = sorted(label)
    y = [label[t] for t in texts]
    if not 0 < sum(y) < len(y):
        return Grammar()
    words, stems, likely, likely_stems = lexicon(texts, y)
    if not (words or stems or likely or likely_stems):
        return Grammar()
    g = Grammar(words | frozenset(SEEDS), stems, likely, likely_stems)
    w, g.bias = fit_weights(np.array([g.features(t) for t in texts]), np.array(y, float))
    # The machines' weights are those of the arcs: made anew with them.
    return Grammar(g.words, g.stems, g.likely, g.likely_stems, dict(zip(FEATURES, w, strict=True)), g.bias)


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``."""

    def run(batches):
        lean()
        for b in batches:
            s = [grammar.score(grammar.features(t.as_py() or "")) for t in b.column(1)]
            out = [is_held_out(i.as_py()) for i in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.bool_()), pa.array(s, pa.float64()), pa.array([int(v >= THRESHOLD) for v in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` with all its columns, without the rows that are predicted toxic."""
    at = docs.columns.index("text")

    def run(batches):
        lean()
        for b in batches:
            fine = [grammar.score(grammar.features(t.as_py() or "")) < THRESHOLD for t in b.column(at)]
            yield b.filter(pa.array(fine, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
