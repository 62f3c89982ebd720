"""Which leaves touch: equi-joins on the split they lie next to and the grid cells
around it, dimension by dimension, plus the boundary pairs of periodic dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwood.functions.boxes import boxes_touch, wraps_to
from boxwood.operators.locate import locate
from boxwood.plans.model import TreeModel


#: Other dimensions whose grid cells join a pair's key.
CELL_DIMS = 2


def _product(a: Column, b: Column, base: int) -> Column:
    """All numbers ``x * base + y``."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * base + y)))


def _cells(boxes: DataFrame, dims: list[int], lo: list[float], hi: list[float], each: int, seam: bool) -> DataFrame:
    """``boxes`` once for each grid cell (``_cell``) that they reach in ``dims``.
    Boxes whose closed intervals meet share a cell: cells grow with the coordinate
    and what lies outside the grid counts as its last cell. With ``seam``, boxes
    at either end of a periodic dimension also reach its cell ``each``."""
    cell: Column | None = None
    for e in dims:
        width = (hi[e] - lo[e]) / each or 1.0
        at = lambda x, e=e, width=width: F.least(F.greatest(F.floor((x - F.lit(lo[e])) / F.lit(width)), F.lit(0)), F.lit(each - 1)).cast("int")
        a, b = at(F.col("left_edge")[e]), at(F.col("right_edge")[e])
        own = F.sequence(F.least(a, b), F.greatest(a, b))
        if seam:
            own = F.when(F.col("periodic_left")[e] | F.col("periodic_right")[e], F.concat(own, F.array(F.lit(each)))).otherwise(own)
        cell = own if cell is None else _product(cell, own, each + 1)
    return boxes.withColumn("_cell", F.explode(cell) if cell is not None else F.lit(0))


def neighbors_of(leaves: DataFrame, ndim: int, periodic: list[bool]) -> DataFrame:
    """``leaf_id, dim, side, neighbor_id`` over any table of boxes with planes.

    Pairs meet at a key of the plane between them and the grid cells that both
    reach in up to ``CELL_DIMS`` other dimensions, so a long plane is many keys."""
    m = range(ndim)
    row = leaves.agg(F.count(F.lit(1)), *[F.min(F.col("left_edge")[d]) for d in m], *[F.max(F.col("right_edge")[d]) for d in m]).first()
    n, lo, hi = row[0], [row[1 + d] or 0.0 for d in m], [row[1 + ndim + d] or 0.0 for d in m]
    each = max(1, int(n ** (1 / ndim)))
    parts = []
    for d in m:
        others = [e for e in m if e != d][:CELL_DIMS]

        def meet(a: DataFrame, b: DataFrame, seam: bool, cond: Column, d=d, others=others) -> None:
            a, b = (_cells(x, others, lo, hi, each, seam).alias(t) for x, t in ((a, "a"), (b, "b")))
            key = (F.col("a._plane") == F.col("b._plane")) & (F.col("a._cell") == F.col("b._cell"))
            parts.append(a.join(b, key & cond).select(F.col("a.leaf_id").alias("lo"), F.lit(d).alias("dim"), F.col("b.leaf_id").alias("hi")))

        # The shared split's path, not the coordinate: planes may coincide.
        plane = lambda side, d=d: leaves.withColumn("_plane", F.col(f"{side}_plane")[d]).filter("_plane IS NOT NULL")
        meet(plane("left"), plane("right"), False, boxes_touch(ndim, d))
        if periodic[d] and ndim > 1:
            edge = lambda side, d=d: leaves.filter(F.col(f"periodic_{side}")[d]).withColumn("_plane", F.lit(d))
            meet(edge("left"), edge("right"), True, wraps_to(ndim, d))
    left = reduce(DataFrame.unionByName, parts)
    sides = F.explode(F.array(F.struct(F.col("lo").alias("leaf_id"), F.lit("left").alias("side"), F.col("hi").alias("neighbor_id")), F.struct(F.col("hi").alias("leaf_id"), F.lit("right").alias("side"), F.col("lo").alias("neighbor_id"))))
    return left.select("dim", sides.alias("x")).select("x.leaf_id", "dim", "x.side", "x.neighbor_id").distinct()


def neighbors(tree: TreeModel) -> DataFrame:
    """``leaf_id, dim, side, neighbor_id`` of a tree."""
    return neighbors_of(tree.leaves, tree.ndim, tree.periodic)


def all_neighbors(tree: TreeModel, include_self: bool = False) -> DataFrame:
    """Distinct ``leaf_id, neighbor_id`` over dimensions and sides. A leaf is its
    own neighbour only where it wraps onto itself, or with ``include_self``."""
    out = neighbors(tree).select("leaf_id", "neighbor_id")
    if include_self:
        out = out.union(tree.leaves.select("leaf_id", "leaf_id"))
    return out.distinct()


def neighbor_lists(tree: TreeModel, include_self: bool = False) -> DataFrame:
    """``leaf_id, neighbors`` as sorted arrays, empty where there are none."""
    got = all_neighbors(tree, include_self).groupBy("leaf_id").agg(F.array_sort(F.collect_set("neighbor_id")).alias("neighbors"))
    return tree.leaves.select("leaf_id").join(got, "leaf_id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<int>")))


def neighbor_ids(tree: TreeModel, positions: DataFrame, coords: list[str]) -> DataFrame:
    """``positions`` with one row per neighbour of the located leaf; positions
    outside give no rows."""
    at = locate(tree, positions, coords).filter("leaf_id IS NOT NULL")
    return at.join(all_neighbors(tree), "leaf_id").select(*positions.columns, "neighbor_id")


def overlapping(boxes: DataFrame, ndim: int) -> DataFrame:
    """Pairs of distinct boxes whose closed boxes meet, smaller id first. The join
    runs on cells of a grid of about sqrt(boxes) slabs along the first dimension."""
    row = boxes.agg(F.count(F.lit(1)), F.min(F.col("left_edge")[0]), F.max(F.col("right_edge")[0])).first()
    n, lo, hi = row[0], row[1] or 0.0, row[2] or 0.0
    slabs = max(1, int(n**0.5))
    width = (hi - lo) / slabs or 1.0
    cell = lambda x: F.floor((x - F.lit(lo)) / F.lit(width)).cast("int")
    spread = boxes.select("leaf_id", "left_edge", "right_edge", F.explode(F.sequence(cell(F.col("left_edge")[0]), cell(F.col("right_edge")[0]))).alias("slab"))
    pairs = spread.alias("a").join(spread.alias("b"), (F.col("a.slab") == F.col("b.slab")) & (F.col("a.leaf_id") < F.col("b.leaf_id")) & boxes_touch(ndim, -1))
    return pairs.select(F.col("a.leaf_id").alias("leaf_id"), F.col("b.leaf_id").alias("other_id")).distinct()
