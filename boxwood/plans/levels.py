"""Splitting all nodes of one level of a tree at once, over distributed points.

Points carry their node's path in ``subtree``. What a level needs to know of its
nodes (dimension, split) is the driver's own and travels as one small broadcast
row a node, so a level costs a few grouped passes however many nodes it has.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwood.plans.local import State
from boxwood.plans.select import kth_by_group
from boxwood.plans.stage import local_rows

#: Node, split value, last value and last id of the less side, its size.
Cut = tuple[float, float, int, int]
LAST = int(np.iinfo(np.int64).max)


def _along(ndim: int) -> Column:
    """The coordinate along ``dim``."""
    return reduce(lambda acc, d: F.when(F.col("dim") == d, F.col(f"c{d}")).otherwise(acc), range(1, ndim), F.col("c0"))


def _told(placed: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(local_rows(placed.sparkSession, rows, schema))


def cut_level(placed: DataFrame, ndim: int, nodes: dict[str, tuple[State, int]], sliding: bool = False) -> dict[str, Cut]:
    """The split of each of ``nodes`` (state and number of points by path)."""
    told = _told(placed, [(p, s.split_dim, (s.mins[s.split_dim] + s.maxs[s.split_dim]) / 2) for p, (s, _) in nodes.items()], "subtree string, dim int, mid double")
    own = placed.join(told, "subtree").select(F.col("subtree").alias("g"), _along(ndim).alias("v"), F.col("point_id").alias("i"), "mid")
    if not sliding:
        halves = {p: (n + 1) // 2 for p, (_, n) in nodes.items()}
        got = kth_by_group(own.drop("mid"), {p: (halves[p], n) for p, (_, n) in nodes.items()})
        return {p: (v, v, i, halves[p]) for p, (v, i) in got.items()}
    key = F.struct("v", "i")
    out: dict[str, Cut] = {}
    full = []
    for r in own.groupBy("g").agg(F.count_if(F.col("v") <= F.col("mid")).alias("k"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect():
        s, n = nodes[r["g"]]
        if r["k"] == 0:
            out[r["g"]] = (r["lo"]["v"], r["lo"]["v"], r["lo"]["i"], 1)
        elif r["k"] == n:
            full.append((r["g"], r["hi"]["v"], r["hi"]["i"]))
        else:
            mid = (s.mins[s.split_dim] + s.maxs[s.split_dim]) / 2
            out[r["g"]] = (mid, mid, LAST, r["k"])
    if full:  # the largest point alone goes to the greater side
        hi = _told(placed, full, "g string, hv double, hi long")
        below = (F.col("v") < F.col("hv")) | ((F.col("v") == F.col("hv")) & (F.col("i") < F.col("hi")))
        for r in own.join(hi, "g").filter(below).groupBy("g").agg(F.max(key).alias("x")).collect():
            out[r["g"]] = (r["x"]["v"], r["x"]["v"], r["x"]["i"], nodes[r["g"]][1] - 1)
    return out


def descend(placed: DataFrame, ndim: int, nodes: dict[str, tuple[State, int]], cuts: dict[str, Cut]) -> DataFrame:
    """``placed`` with the points of ``nodes`` moved to their children."""
    told = _told(placed, [(p, s.split_dim, float(cuts[p][1]), int(cuts[p][2])) for p, (s, _) in nodes.items()], "subtree string, dim int, _v double, _i long")
    x = _along(ndim)
    less = (x < F.col("_v")) | ((x == F.col("_v")) & (F.col("point_id") <= F.col("_i")))
    to = F.when(F.col("dim").isNull(), F.col("subtree")).otherwise(F.concat("subtree", F.when(less, F.lit("0")).otherwise(F.lit("1"))))
    return placed.join(told, "subtree", "left").select(*[c for c in placed.columns if c != "subtree"], to.alias("subtree"))
