"""Exact selection and ranking without a global single-task sort."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwood.plans.stage import local_rows, stage

#: Rows of a group that the last step of a selection may rank at once.
BRACKET_ROWS = 200_000


@dataclass
class _Range:
    """Where the wanted rank ``k`` (of ``n`` rows) lies: between ``lo`` and ``hi``,
    ends included unless open."""

    k: int
    n: int
    lo: float | int
    hi: float | int
    lo_open: bool = False
    hi_open: bool = False

    @property
    def single(self) -> bool:
        return self.lo == self.hi


def _within(d: DataFrame, key: str, ranges: dict[str, _Range], kind: str) -> DataFrame:
    """Rows of ``d`` inside the range of their group. The ranges are the driver's
    own, one small row a group."""
    rows = [(g, r.lo, r.hi, r.lo_open, r.hi_open) for g, r in ranges.items()]
    b = F.broadcast(local_rows(d.sparkSession, rows, f"g string, _lo {kind}, _hi {kind}, _lo_open boolean, _hi_open boolean"))
    c = F.col(key)
    inside = ((c > F.col("_lo")) | (~F.col("_lo_open") & (c == F.col("_lo")))) & ((c < F.col("_hi")) | (~F.col("_hi_open") & (c == F.col("_hi"))))
    return d.join(b, "g").filter(inside).select("g", "v", "i")


def _narrow(d: DataFrame, key: str, ranges: dict[str, _Range], kind: str) -> dict[str, _Range]:
    """Shrinks every range until it has ``BRACKET_ROWS`` rows or one value. A round
    is two grouped passes for all groups together: approximate percentiles around
    each rank give two of the group's own values, and rows are counted below, at,
    between and above them. The part that holds the rank is kept, so each round
    leaves out one value at least."""
    done = dict(ranges)
    while busy := {g: r for g, r in done.items() if r.n > BRACKET_ROWS and not r.single}:
        inside = _within(d, key, busy, kind)
        around = {g: (max(0, math.floor(1000 * r.k / r.n) - 1), min(1000, math.ceil(1000 * r.k / r.n) + 1)) for g, r in busy.items()}
        grid = sorted({q for pair in around.values() for q in pair})
        got = inside.groupBy("g").agg(F.percentile_approx(key, [q / 1000 for q in grid], 20_000).alias("q")).collect()
        cuts = [(x["g"], *(x["q"][grid.index(q)] for q in around[x["g"]])) for x in got]
        told = F.broadcast(local_rows(d.sparkSession, cuts, f"g string, a {kind}, b {kind}"))
        c, a, b = F.col(key), F.col("a"), F.col("b")
        parts = (c < a, c == a, (c > a) & (c < b), (c == b) & (b > a))
        counts = inside.join(told, "g").groupBy("g").agg(*[F.count_if(p).alias(f"n{j}") for j, p in enumerate(parts)]).collect()
        at = {g: (a, b) for g, a, b in cuts}
        for x in counts:
            r, (lo, hi), k = busy[x["g"]], at[x["g"]], busy[x["g"]].k
            sizes = [x[f"n{j}"] for j in range(4)]
            sizes.append(r.n - sum(sizes))
            options = ((r.lo, lo, r.lo_open, True), (lo, lo, False, False), (lo, hi, True, True), (hi, hi, False, False), (hi, r.hi, True, r.hi_open))
            for n, option in zip(sizes, options, strict=True):
                if k <= n:
                    done[x["g"]] = _Range(k, n, *option)
                    break
                k -= n
    return done


def kth_by_group(d: DataFrame, want: dict[str, tuple[int, int]]) -> dict[str, tuple[float, int]]:
    """For each group ``g`` of ``d(g, v, i)``, the ``k``-th smallest (1-based) of its
    ``n`` rows in the order of (value, id), as (value, id); ``want``: (k, n) by group.

    Values are narrowed first, then, where equal values alone are too many, ids.
    No task sorts more than ``BRACKET_ROWS`` rows of a group.
    """
    for g, (k, n) in want.items():
        if not 1 <= k <= n:
            raise IndexError(f"rank {k} of {n} points{' of ' + g if g else ''}")
    whole = {g: _Range(k, n, float("-inf"), float("inf")) for g, (k, n) in want.items()}
    values = _narrow(d, "v", whole, "double")
    rest = _within(d, "v", values, "double")
    tied = {g: _Range(r.k, r.n, -(2**63), 2**63 - 1) for g, r in values.items() if r.n > BRACKET_ROWS}
    out: dict[str, tuple[float, int]] = {}
    if tied:
        ids = _narrow(rest, "i", tied, "long")
        out = {g: (values[g].lo, r.lo) for g, r in ids.items() if r.single}
        few = {g: ids.get(g, _Range(r.k, r.n, -(2**63), 2**63 - 1)) for g, r in values.items() if g not in out}
        rest, values = (_within(rest, "i", few, "long"), few) if few else (rest, {})
    if values:
        ranks = F.broadcast(local_rows(d.sparkSession, [(g, r.k) for g, r in values.items()], "g string, k long"))
        r = F.row_number().over(Window.partitionBy("g").orderBy("v", "i"))
        for x in rest.withColumn("r", r).join(ranks, "g").filter(F.col("r") == F.col("k")).collect():
            out[x["g"]] = (x["v"], x["i"])
    return out


def kth(df: DataFrame, value: str | Column, k: int, n: int | None = None, id_col: str = "point_id") -> tuple[float, int]:
    """The k-th smallest (1-based) of ``(value, id)`` of all rows, as (value, id)."""
    v = F.col(value) if isinstance(value, str) else value
    d = df.select(F.lit("").alias("g"), v.cast("double").alias("v"), F.col(id_col).alias("i"))
    return kth_by_group(d, {"": (k, d.count() if n is None else n)})[""]


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name`` = 0-based position in the total order. Rows are dealt
    by range and ranked per partition; only one count per partition reaches the
    driver. The dealt rows are written once, since the ranges come from a sample."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = stage(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("_part").count().orderBy("_part").collect()
    starts, at = [], 0
    for r in counts:
        starts.append((r["_part"], at))
        at += r["count"]
    offset = F.broadcast(local_rows(df.sparkSession, starts or [(0, 0)], "_part int, _start long"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*cols))
    return dealt.withColumn("_local", local).join(offset, "_part").withColumn(name, (F.col("_start") + F.col("_local") - 1).cast("long")).drop("_part", "_start", "_local")
