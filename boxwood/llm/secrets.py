"""Secret scans: named patterns plus sliding-window entropy, without a shuffle.

Everything is one projection over the scan. A pattern's spans come from the
lengths of the pieces that ``split`` and ``regexp_extract_all`` give, so
positions are code points. High-entropy stretches come from a window that slides
over each candidate string: the state of one ``aggregate`` holds the counts of
the characters in the window and the sum of ``c * log2(c)`` over them, and each
step adds one character and takes one away. The sum is kept in integers (units
of 2**-20), so the result does not depend on the order of additions.

Character classes: ``entropy_hex`` over ``[0-9A-Fa-f]`` and ``entropy_b64`` over
``[A-Za-z0-9+/_-]``. A candidate is a run of one class, at least a window long,
with a digit and a letter, that no allow-list pattern matches (placeholders,
UUID-like groups). Spans of entropy that touch a named span are left out, as the
named one already covers the find.

Defined results
    null or empty text: counts 0, ``spans`` empty, the hash of the empty string.
    any ``doc_id`` (null, repeated): one result row per input row.
    very long texts are scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwood.llm.common import text_or_empty

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of fewer characters fails whole, so the bound may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

WINDOW = 20
SCALE = 1 << 20
#: Kind, alphabet, pattern of a candidate, least entropy of a window in bits.
CLASSES = (
    ("entropy_hex", "0123456789abcdefABCDEF", "[0-9A-Fa-f]{20,}", 3.0),
    ("entropy_b64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "[A-Za-z0-9+/_-]{20,}", 3.7),
)
ALLOW = (
    "([Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd]|[Xx]{4}|0{6}|1234567)",
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
SPAN = "struct<s:int,o:int,e:int,kind:string,text:string>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find_all(text: Column, pattern: str, kind: str, order: int, group: int = 0, least: int = 0, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of spans, those whose
    ``group`` is shorter than ``least`` dropped after matching."""
    # A match has no look-around, so its group is found again in the match alone. What
    # ``split`` gives after the last match has no match beside it and is not used.
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = lambda m: F.length(F.regexp_extract(m, pattern, group) if group else m)
    pairs = F.zip_with(found, F.split(text, pattern), lambda m, gap: F.struct(m.alias("m"), size(m).alias("g"), F.length(gap).alias("gap")))
    steps = F.filter(pairs, lambda x: x["m"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + F.length(x["m"])
        span = F.struct(start.alias("s"), F.lit(order).alias("o"), end.alias("e"), F.lit(kind).alias("kind"), x["m"].alias("text"))
        return F.struct(end.alias("at"), F.when(x["g"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    out = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    hit = text.rlike(pattern)
    return F.when(hit if gate is None else gate & hit, out).otherwise(none)


def _ftab() -> list[int]:
    return [0, *(round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1))]


def _limit(bits: float) -> int:
    """The largest sum of c*log2(c) that a window of that entropy may have."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE)


def entropy_spans(text: Column, alphabet: str, bits: float) -> Column:
    """``array<struct<a, b>>``: merged windows of at least ``bits`` bits."""
    table, limit = F.array(*[F.lit(x).cast("long") for x in _ftab()]), _limit(bits)
    codes = F.transform(F.slice(F.split(text, ""), 1, F.length(text)), lambda ch: F.position(ch, F.lit(alphabet)) - 1)
    steps = _let(codes, lambda cs: F.transform(cs, lambda c, i: F.struct((i + 1).alias("i"), c.alias("c"), F.when(i >= WINDOW, F.get(cs, i - WINDOW)).otherwise(-1).alias("o"))))

    def step(acc: Column, x: Column) -> Column:
        count = lambda c: F.get(acc["cnt"], c)
        f = lambda c: F.get(table, c)
        gone = F.when(x["o"] >= 0, f(count(x["o"]) - 1) - f(count(x["o"]))).otherwise(F.lit(0).cast("long"))
        total = acc["sum"] + F.when(x["c"] == x["o"], F.lit(0).cast("long")).otherwise(f(count(x["c"]) + 1) - f(count(x["c"])) + gone)
        cnt = F.transform(acc["cnt"], lambda v, k: v + (k == x["c"]).cast("int") - (k == x["o"]).cast("int"))

        def place(s: Column) -> Column:
            last, a = F.get(acc["out"], F.size(acc["out"]) - 1), x["i"] - WINDOW
            span = lambda at: F.array(F.struct(at.alias("a"), x["i"].alias("b")))
            grown = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), span(last["a"]))
            out = F.when(last["b"] >= a, grown).otherwise(F.concat(acc["out"], span(a)))
            return F.struct(cnt.alias("cnt"), s.alias("sum"), F.when((x["i"] >= WINDOW) & (s <= limit), out).otherwise(acc["out"]).alias("out"))

        return _let(total, place)

    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("cnt"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
    return F.aggregate(steps, zero, step)["out"]


def _entropy_found(text: Column, allow: tuple[str, ...], order: int, kind: str, alphabet: str, pattern: str, bits: float) -> Column:
    def fine(c: Column) -> Column:
        ok = c["text"].rlike("[0-9]") & c["text"].rlike("[A-Za-z]")
        for p in allow:
            ok = ok & ~c["text"].rlike(p)
        return ok

    def spans(c: Column) -> Column:
        cut = lambda w: c["text"].substr(w["a"] + 1, w["b"] - w["a"])
        place = lambda w: F.struct((c["s"] + w["a"]).alias("s"), F.lit(order).alias("o"), (c["s"] + w["b"]).alias("e"), F.lit(kind).alias("kind"), cut(w).alias("text"))
        return F.transform(entropy_spans(c["text"], alphabet, bits), place)

    return F.flatten(F.transform(F.filter(find_all(text, pattern, kind, order), fine), spans))


def scan(docs: DataFrame, allow: tuple[str, ...] = ALLOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs``' columns in ``keep`` plus ``base`` and ``extra``: arrays of spans
    (``s`` inclusive, ``e`` exclusive, ``kind``, ``text``), each in order."""
    t = F.col("_t")
    d = docs.select(*keep, text_or_empty().alias("_t"))
    marks = t.contains("=") | t.contains(":")
    base = F.array_sort(F.concat(
        find_all(t, ASSIGN, "assign", 0, group=2, least=8, gate=marks),
        find_all(t, ACCESS, "access", 1, gate=t.contains("AKIA")),
        find_all(t, HEX, "hex", 2),
    ))
    d = d.select(*keep, "_t", base.alias("base"))
    extra = [_entropy_found(t, allow, 3 + n, *of) for n, of in enumerate(CLASSES)]
    free = lambda x: ~F.exists(F.col("base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    return d.select(*keep, F.col("_t").alias("text"), "base", F.array_sort(F.filter(F.concat(*extra), free)).alias("extra"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per row: counts by kind, the hash of the base spans, all spans as text."""
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs, keep=("doc_id",)).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; touching
    and overlapping spans become one mark. Null texts stay null."""
    # One struct holds the row, so no column of it can clash with ours.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = scan(docs.select(row.alias("_row"), "text"), keep=("_row",))

    def step(acc: Column, x: Column) -> Column:
        piece = F.when(x["s"] > acc["at"], F.concat(F.col("text").substr(acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(F.when(acc["out"] == "", F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    spans = F.array_sort(F.concat("base", "extra"))
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    text = F.when(F.col("_row.text").isNull(), F.lit(None).cast("string")).when(F.size(spans) == 0, F.col("text")).otherwise(done)
    return found.select(*[text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    base = []
    for order, (kind, pattern, group, least) in enumerate((("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 0), ("hex", HEX, 0, 0))):
        base.append(_sql_find(q(pattern), kind, order, group, f"WHERE g >= {least}"))
    classes = []
    for n, (kind, _, pattern, bits) in enumerate(CLASSES):
        allowed = " OR ".join(f"regexp_matches(m, {q(p)})" for p in ALLOW)
        classes.append(f"""SELECT k, {3 + n} AS o, '{kind}' AS kind, s, m, {_limit(bits)} AS lim FROM ({_sql_find(q(pattern), kind, 3 + n, 0, "")}) WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({allowed})""")
    table = "[" + ", ".join(f"{x}::BIGINT" for x in _ftab()[1:]) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(base)}),
cand AS ({" UNION ALL ".join(classes)}),
w AS (SELECT k, o, kind, s, lim, a, list_aggregate(list_transform(range(a + 1, a + {WINDOW + 1}), lambda i: m[i]), 'histogram') AS h FROM (SELECT *, unnest(range(0, len(m) - {WINDOW - 1})) AS a FROM cand)),
hot AS (SELECT k, o, kind, s, a FROM w WHERE list_sum(list_transform(map_values(h), lambda c: {table}[c::BIGINT])) <= lim),
isl AS (SELECT *, sum(CASE WHEN a <= prev + {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY k, o, s ORDER BY a) AS grp FROM (SELECT *, lag(a) OVER (PARTITION BY k, o, s ORDER BY a) AS prev FROM hot)),
ent AS (SELECT k, o, kind, s + min(a) AS s, s + max(a) + {WINDOW} AS e FROM isl GROUP BY k, o, kind, s, grp),
spans AS (SELECT k, o, kind, s, e FROM base UNION ALL SELECT k, o, kind, s, e FROM ent x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.k = x.k AND b.s < x.e AND x.s < b.e)),
agg AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) AS a FROM spans GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN agg USING (k)"""


def _sql_find(pattern: str, kind: str, order: int, group: int, where: str) -> str:
    gaps = "list_sum(list_transform(gaps[1:i], lambda x: len(x)))"
    lens = "coalesce(list_sum(list_transform(ms[1:i-1], lambda x: len(x))), 0)"
    return f"""SELECT k, {order} AS o, '{kind}' AS kind, s, s + len(m) AS e, m FROM (SELECT k, ms[i] AS m, len(gs[i]) AS g, ({gaps} + {lens})::BIGINT AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM
(SELECT k, regexp_extract_all(t, {pattern}) AS ms, regexp_extract_all(t, {pattern}, {group}) AS gs, string_split_regex(t, {pattern}) AS gaps FROM d WHERE regexp_matches(t, {pattern})))) {where}"""


SQL = _sql()
