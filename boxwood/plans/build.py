"""Building the partition tree.

The driver holds the state of the top nodes only. A top level is split by a few
passes over the points, all its nodes together: the median rule by an exact
bracketed selection, the sliding midpoint by conditional aggregates. Once a node has at most ``subtree_points``
points, one grouped pass splits every such subtree to its leaves. Node ids are then
offsets of subtrees (one small row each on the driver) plus positions inside them,
so no step ranks all leaves or all points in one task. A task gets the state of its
own subtree only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwood.functions.points import PointSet, bounds
from boxwood.plans.levels import cut_level, descend
from boxwood.plans.local import State, finish
from boxwood.plans.model import TreeModel
from boxwood.plans.select import global_rank
from boxwood.plans.stage import local_rows, stage

SUBTREE_POINTS = 250_000
#: The nodes that points have reached are written after so many levels.
STAGE_LEVELS = 6
NODE = "subtree string, path string, point_id long, local_leaf int, local_pos long, npts long, split_dim int, split_val double, mins array<double>, maxs array<double>, left_edge array<double>, right_edge array<double>, periodic_left array<boolean>, periodic_right array<boolean>, left_plane array<string>, right_plane array<string>"


def arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in NODE.split(", ")])


#: A node's state as a row.
STATE = "subtree string, " + ", ".join(f for f in NODE.split(", ") if f.split()[0] in ("path", "mins", "maxs", "left_edge", "right_edge", "periodic_left", "periodic_right", "left_plane", "right_plane"))


def _fields(s: State) -> dict:
    return {"path": s.path, "mins": list(s.mins), "maxs": list(s.maxs), "left_edge": list(s.left), "right_edge": list(s.right), "periodic_left": list(s.periodic_left), "periodic_right": list(s.periodic_right), "left_plane": list(s.left_plane), "right_plane": list(s.right_plane)}


def leafsize_for(n: int, leafsize: int, nleaves: int) -> int:
    """``nleaves`` > 0 overrides ``leafsize``: the next power of two of leaves."""
    if nleaves > 0:
        leafsize = n // 2 ** math.ceil(math.log2(nleaves)) + 1
    if leafsize < 2:
        raise ValueError("leafsize must be at least 2")
    return leafsize


def _flags(periodic: bool | list[bool], m: int) -> tuple[bool, ...]:
    out = (periodic,) * m if isinstance(periodic, bool) else tuple(bool(p) for p in periodic)
    if len(out) != m:
        raise ValueError(f"periodic has {len(out)} entries for {m} dimensions")
    return out


def _edges(given: list[float] | None, default: list[float], name: str) -> tuple[float, ...]:
    out = tuple(float(x) for x in (default if given is None else given))
    if len(out) != len(default):
        raise ValueError(f"{name} has {len(out)} entries for {len(default)} dimensions")
    return out


def build(
    points: PointSet,
    left_edge: list[float] | None = None,
    right_edge: list[float] | None = None,
    periodic: bool | list[bool] = False,
    leafsize: int = 10_000,
    nleaves: int = 0,
    data_version: int = 0,
    use_sliding_midpoint: bool = False,
    subtree_points: int = SUBTREE_POINTS,
    start: State | None = None,
) -> TreeModel:
    """The tree over ``points``. ``start`` builds below a given node instead of a
    whole domain (its own bounds, box and flags)."""
    if nleaves <= 0 and leafsize < 2:
        raise ValueError("leafsize must be at least 2")
    b = bounds(points)
    if not b.n:
        raise ValueError("no points")
    leafsize, m = leafsize_for(b.n, leafsize, nleaves), points.ndim
    left, right = _edges(left_edge, b.mins, "left_edge"), _edges(right_edge, b.maxs, "right_edge")
    flags = _flags(periodic, m)
    root = start or State("", tuple(b.mins), tuple(b.maxs), left, right, flags, flags, (None,) * m, (None,) * m)
    top, open_ = {}, {root.path: (root, b.n)}
    subtrees: dict[str, tuple[State, int]] = {}
    placed = points.df.withColumn("subtree", F.lit(root.path))
    level = 0
    while open_:
        split = {}
        for path, (s, n) in sorted(open_.items()):
            if n <= subtree_points or s.is_leaf(n, leafsize):
                subtrees[path] = (s, n)
            else:
                split[path] = (s, n)
        if not split:
            break
        cuts = cut_level(placed, m, split, use_sliding_midpoint)
        placed = descend(placed, m, split, cuts)
        level += 1
        if level % STAGE_LEVELS == 0:
            placed = stage(placed, "placed")
        open_ = {}
        for path, (s, n) in split.items():
            value, _, _, k = cuts[path]
            top[path] = (s, n, s.split_dim, value)
            a, c = s.children(s.split_dim, value)
            open_[a.path], open_[c.path] = (a, k), (c, n - k)
    rows = stage(_finish(points, placed, subtrees, leafsize, use_sliding_midpoint), "tree")
    meta = {"npts": b.n, "ndim": m, "leafsize": leafsize, "use_sliding_midpoint": use_sliding_midpoint, "left_edge": list(root.left), "right_edge": list(root.right), "periodic": [x and y for x, y in zip(root.periodic_left, root.periodic_right, strict=True)], "data_version": data_version}
    return TreeModel.assemble(rows, top, subtrees, meta)


def _finish(points: PointSet, placed: DataFrame, subtrees: dict[str, tuple[State, int]], leafsize: int, sliding: bool) -> DataFrame:
    """Rows of nodes and of points of all subtrees, from one grouped pass. A
    subtree that is already a leaf and too large for a task (equal points) is
    written without gathering it."""
    big = {p for p, (s, n) in subtrees.items() if n > SUBTREE_POINTS and s.is_leaf(n, leafsize)}
    cols = points.coords
    spark, schema = placed.sparkSession, arrow_schema()
    # Beside its points, not in the function: there each process would hold all states.
    states = local_rows(spark, [(p, *_fields(s).values()) for p, (s, _) in subtrees.items() if p not in big], STATE)

    def run(t: pa.Table, own: pa.Table) -> pa.Table:
        state = State(*(tuple(v) if isinstance(v, list) else v for v in own.drop_columns("subtree").to_pylist()[0].values()))
        path, ids = state.path, t.column("point_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = np.column_stack([t.column(c).to_numpy() for c in cols])[order]
        done, ids = finish(x, state, leafsize, sliding), ids[order]
        where, sizes = np.concatenate(done.rows), [len(r) for r in done.rows]
        members = {"subtree": pa.array([path] * len(where)), "point_id": pa.array(ids[where]), "local_leaf": pa.array(np.repeat(np.arange(len(sizes)), sizes).astype(np.int32)), "local_pos": pa.array(np.arange(len(where), dtype=np.int64))}
        leaf_no, pos, recs = 0, 0, []
        for s, n, dim, at in done.nodes:
            recs.append({"subtree": path, "local_leaf": leaf_no if dim is None else None, "local_pos": pos, "npts": n, "split_dim": dim, "split_val": at} | _fields(s))
            if dim is None:
                leaf_no, pos = leaf_no + 1, pos + n
        return pa.concat_tables([pa.Table.from_pylist(recs, schema), pa.table([members[f.name] if f.name in members else pa.nulls(len(where), f.type) for f in schema], schema)])

    grouped = placed.filter(~F.col("subtree").isin(*big)) if big else placed
    out = grouped.groupBy("subtree").cogroup(states.groupBy("subtree")).applyInArrow(run, NODE)
    for path in sorted(big):
        s, n = subtrees[path]
        own = placed.filter(F.col("subtree") == path).select("subtree", "point_id")
        ranked = global_rank(own, ["point_id"], "local_pos").select("subtree", "point_id", F.lit(0).alias("local_leaf"), "local_pos")
        node = local_rows(spark, [tuple(({"subtree": path, "local_leaf": 0, "local_pos": 0, "npts": n} | _fields(s)).get(k) for k in schema.names)], NODE)
        out = out.unionByName(node).unionByName(ranked, allowMissingColumns=True)
    return out
