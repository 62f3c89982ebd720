"""Dealing points to workers: blocks, medians of blocks, regions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwood.functions.points import PointSet, bounds
from boxwood.plans.levels import cut_level, descend
from boxwood.plans.local import State
from boxwood.plans.select import global_rank, kth
from boxwood.plans.stage import local_rows


def block_of(rank: Column, n: int, size: int) -> Column:
    """The contiguous block of a 0-based rank; the first n % size have one more."""
    each, more = divmod(n, size)
    if each == 0:
        return rank.cast("int")
    edge = more * (each + 1)
    return F.when(rank < edge, F.floor(rank / (each + 1))).otherwise(F.floor((rank - edge) / each) + more).cast("int")


def distribute_blocks(points: PointSet, size: int) -> DataFrame:
    """Points with ``block``, by point id."""
    d = global_rank(points.df, ["point_id"])
    return d.withColumn("block", block_of(F.col("rank"), points.df.count(), size)).drop("rank")


def pivot_of_blocks(blocks: DataFrame, dim: int) -> DataFrame:
    """One row ``pivot``: the lower median of the blocks' lower medians."""
    med = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")
    return blocks.groupBy("block").agg(med(f"c{dim}").alias("m")).agg(med("m").alias("pivot"))


def select_by_block(blocks: DataFrame, dim: int, t: int) -> DataFrame:
    """``block, q, pivot``: the t-th smallest overall, and the last place of the t
    smallest in each block (-1: none)."""
    c = F.col(f"c{dim}")
    v, i = kth(blocks, c, t)
    less = (c < v) | ((c == v) & (F.col("point_id") <= i))
    return blocks.groupBy("block").agg((F.count_if(less) - 1).alias("q"), F.lit(v).alias("pivot"))


def split_by_block(blocks: DataFrame, ndim: int, mins: list[float] | None = None, maxs: list[float] | None = None) -> DataFrame:
    """``block, q, split_dim, split_val`` of the median split of all blocks."""
    b = bounds(PointSet(blocks, ndim))
    spread = [hi - lo for lo, hi in zip(mins or b.mins, maxs or b.maxs, strict=True)]
    d = spread.index(max(spread))
    return select_by_block(blocks, d, (b.n + 1) // 2).select("block", "q", F.lit(d).alias("split_dim"), F.col("pivot").alias("split_val"))


def split_rank(size: int, split_left: bool = True) -> int:
    """How many of ``size`` workers take the less side."""
    return size // 2 + (size % 2 if split_left else 0)


def rounds(size: int) -> list[tuple[int, int, int]]:
    """(worker, number of rounds, round in which it first receives) for each worker."""
    total = math.ceil(math.log2(size)) + 1 if size > 1 else 1
    out = []
    for worker in range(size):
        w, s, r = worker, size, 0
        while w:
            k = split_rank(s)
            w, s = (w, k) if w < k else (w - k, s - k)
            r += 1
        out.append((worker, total, r))
    return out


def redistribute(points: PointSet, size: int, at: int | None = None) -> DataFrame:
    """Points with ``side`` (0 less, 1 greater) of their median split and the
    worker (``target``) each goes to: workers below ``at`` share the less side."""
    at = split_rank(size) if at is None else at
    if not 0 < at < size:
        raise ValueError(f"split rank {at} of {size}")
    b = bounds(points)
    d = b.width.index(max(b.width))
    c, k = F.col(f"c{d}"), (b.n + 1) // 2
    v, i = kth(points.df, c, k, b.n)
    side = F.when((c < v) | ((c == v) & (F.col("point_id") <= i)), 0).otherwise(1)
    ranked = global_rank(points.df.withColumn("side", side), ["side", "point_id"])
    target = F.when(F.col("side") == 0, block_of(F.col("rank"), k, at)).otherwise(block_of(F.col("rank") - k, b.n - k, size - at) + at)
    return ranked.withColumn("target", target.cast("int")).drop("rank")


def kd_distribute(points: PointSet, size: int, left_edge: list[float] | None = None, right_edge: list[float] | None = None, periodic: bool = False) -> tuple[DataFrame, list[tuple[int, int, State]]]:
    """Points with the ``worker`` whose region they are in, and (worker, points,
    region) for each. Regions come from repeated median splits; of ``s`` workers,
    ``split_rank(s)`` go to the less side. ``repartition("worker")`` of the result
    is a spatial partitioning."""
    b = bounds(points)
    m = points.ndim
    flags = (periodic,) * m
    root = State("", tuple(b.mins), tuple(b.maxs), tuple(left_edge or b.mins), tuple(right_edge or b.maxs), flags, flags, (None,) * m, (None,) * m)
    todo, done = {root.path: (root, b.n, 0, size)}, []
    placed = points.df.withColumn("subtree", F.lit(root.path))
    while todo:
        done += [(first, n, s) for s, n, first, k in todo.values() if k == 1]
        split = {p: (s, n) for p, (s, n, _, k) in todo.items() if k > 1}
        if not split:
            break
        cuts = cut_level(placed, m, split)
        placed = descend(placed, m, split, cuts)
        after = {}
        for p, (s, n) in split.items():
            (_, _, first, k), half = todo[p], cuts[p][3]
            a, c = s.children(s.split_dim, cuts[p][0])
            r = split_rank(k)
            after[a.path], after[c.path] = (a, half, first, r), (c, n - half, first + r, k - r)
        todo = after
    of = F.broadcast(local_rows(placed.sparkSession, [(s.path, w) for w, _, s in done], "subtree string, worker int"))
    return placed.join(of, "subtree").select(*points.df.columns, "worker"), sorted(done, key=lambda x: x[0])


def region_table(spark, regions: list[tuple[int, int, State]]) -> DataFrame:
    """Regions as boxes with planes, so that adjacency works on them too."""
    return local_rows(
        spark,
        [(w, n, s.path, list(s.left), list(s.right), list(s.periodic_left), list(s.periodic_right), list(s.left_plane), list(s.right_plane)) for w, n, s in regions],
        "leaf_id int, npts long, path string, left_edge array<double>, right_edge array<double>, periodic_left array<boolean>, periodic_right array<boolean>, left_plane array<string>, right_plane array<string>",
    )
