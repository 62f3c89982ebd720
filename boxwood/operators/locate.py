"""Which leaf holds a position."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from boxwood.functions.boxes import wrap
from boxwood.plans.model import TreeModel
from boxwood.plans.stage import local_rows

#: Trees of at most this many nodes are broadcast, as flat arrays of about 21 bytes a node.
BROADCAST_NODES = 2_000_000
#: Boxes that ``locate_by_box`` compares a position with in one step, and how many
#: boxes of a step are broadcast (some 100 bytes each).
BOX_FAN = 64
BROADCAST_BOXES = 250_000


def wrapped(tree: TreeModel, coords: list[Column]) -> list[Column]:
    """Positions brought into the domain in its periodic dimensions."""
    return [wrap(c, lo, hi) if p else c for c, lo, hi, p in zip(coords, tree.left_edge, tree.right_edge, tree.periodic, strict=True)]


def _inside(tree: TreeModel, coords: list[Column]) -> Column:
    cond = F.lit(True)
    for c, lo, hi in zip(coords, tree.left_edge, tree.right_edge, strict=True):
        cond = cond & (c >= lo) & (c < hi)
    return F.coalesce(cond, F.lit(False))


@dataclass(frozen=True)
class FlatTree:
    """Nodes in depth-first order as flat arrays: a node's less child is the next
    one, ``more`` is its greater child; ``dim`` is -1 at a leaf. 21 bytes a node."""

    dim: np.ndarray
    val: np.ndarray
    more: np.ndarray
    leaf: np.ndarray

    @classmethod
    def of(cls, paths: list[str], dim: np.ndarray, val: np.ndarray, leaf: np.ndarray) -> "FlatTree":
        order = sorted(range(len(paths)), key=paths.__getitem__)
        at = {paths[j]: i for i, j in enumerate(order)}
        more = np.array([at.get(paths[j] + "1", -1) for j in order], np.int32)
        return cls(dim[order].astype(np.int8 if dim.max(initial=0) < 128 else np.int32), val[order], more, leaf[order].astype(np.int32))

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf ids of the rows of ``x``."""
        cur = np.zeros(len(x), np.int64)
        go = np.flatnonzero(self.dim[cur] >= 0)
        while len(go):
            c = cur[go]
            cur[go] = np.where(x[go, self.dim[c]] < self.val[c], c + 1, self.more[c])
            go = go[self.dim[cur[go]] >= 0]
        return self.leaf[cur]


def flat_tree(nodes: pd.DataFrame) -> FlatTree:
    return FlatTree.of(nodes["path"].tolist(), nodes["split_dim"].fillna(-1).to_numpy(np.int64), nodes["split_val"].astype(float).to_numpy(), nodes["leaf_id"].fillna(-1).to_numpy(np.int64))


def locate(tree: TreeModel, positions: DataFrame, coords: list[str], broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """``positions`` with ``leaf_id``: null outside the domain or for a null or NaN
    coordinate. Descends the splits (``x < split`` is less), which differs from
    where a point is stored for the points on split planes.

    Nodes are broadcast up to ``broadcast_nodes``; larger trees are searched in two
    steps, the top of the tree as one expression and then a co-grouped pass per
    subtree.
    """
    if len(coords) != tree.ndim:
        raise AssertionError(f"{len(coords)} coordinates for {tree.ndim} dimensions")
    at = wrapped(tree, [F.col(c).cast("double") for c in coords])
    names = [f"_p{d}" for d in range(tree.ndim)]
    d = positions.withColumns(dict(zip(names, at, strict=True)))
    inside = _inside(tree, [F.col(n) for n in names]) & ~F.greatest(F.lit(False), *[F.coalesce(F.isnan(n), F.lit(True)) for n in names])
    if tree.num_leaves * 2 <= broadcast_nodes:
        table = positions.sparkSession.sparkContext.broadcast(flat_tree(tree.nodes.select("path", "split_dim", "split_val", "leaf_id").toPandas()))

        @F.pandas_udf("int")
        def descend(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            flat = table.value
            for cols in batches:
                yield pd.Series(flat.descend(np.column_stack([c.to_numpy(float) for c in cols])), dtype="int32")

        safe = [F.when(F.col("_in"), F.col(n)).otherwise(F.lit(tree.left_edge[i])) for i, n in enumerate(names)]
        out = d.withColumn("_in", inside).withColumn("leaf_id", F.when(F.col("_in"), descend(*safe)))
        return out.select(*positions.columns, "leaf_id")
    return _two_step(tree, d.withColumn("_in", inside), positions.columns, names)


def _two_step(tree: TreeModel, d: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    subtrees = {r["subtree"] for r in tree.nodes.select("subtree").filter("subtree IS NOT NULL").distinct().collect()}
    top = {r["path"]: (r["split_dim"], r["split_val"]) for r in tree.nodes.filter("subtree IS NULL").select("path", "split_dim", "split_val").collect()}

    def walk(path: str) -> Column:
        if path in subtrees or path not in top:
            return F.lit(path)
        dim, val = top[path]
        return F.when(F.col(names[dim]) < val, walk(path + "0")).otherwise(walk(path + "1"))

    inside = d.filter("_in").withColumn("_sub", walk(""))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inside.select(*keep).schema) + ", leaf_id int"

    def run(points: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        out = points[keep].copy()
        out["leaf_id"] = flat_tree(nodes).descend(points[names].to_numpy(float)) if len(points) else pd.Series([], dtype="int32")
        return out

    part = tree.nodes.filter("subtree IS NOT NULL").select(F.col("subtree").alias("_sub"), "path", "split_dim", "split_val", "leaf_id")
    # A hot subtree's positions are salted over several groups, its nodes copied to each.
    salt = 8
    a = inside.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salt)))
    b = part.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    found = a.groupBy("_sub", "_salt").cogroup(b.groupBy("_sub", "_salt")).applyInPandas(run, schema)
    return found.unionByName(d.filter(~F.col("_in")).select(*keep, F.lit(None).cast("int").alias("leaf_id")))


def locate_by_box(tree: TreeModel, positions: DataFrame, coords: list[str]) -> DataFrame:
    """The located positions only, by range joins on the leaf boxes; it never
    leaves the JVM. For trees whose domain holds all points.

    A large tree is searched in steps: first the boxes around long runs of leaves,
    then those around the shorter runs inside the ones found, then the leaves. Leaf
    ids follow the tree, so a run is a compact part of it and a position meets
    ``BOX_FAN`` boxes a step, and again for each run beside it that spans a split
    above. Steps of many boxes are joined by shuffle."""
    names = [f"_p{d}" for d in range(tree.ndim)]
    at = wrapped(tree, [F.col(c).cast("double") for c in coords])
    found = positions.withColumns(dict(zip(names, at, strict=True)))
    sizes = [1]
    while tree.num_leaves > sizes[0] * BOX_FAN:
        sizes.insert(0, sizes[0] * BOX_FAN)
    for k, size in enumerate(sizes):
        run = F.floor(F.col("leaf_id") / size).cast("int").alias("_run")
        edges = [f(F.col(f"{side}_edge")[d]).alias(f"_{side}{d}") for d in range(tree.ndim) for side, f in (("left", F.min), ("right", F.max))]
        boxes = tree.leaves.groupBy(run).agg(*edges)
        cond = F.lit(True)
        for d, n in enumerate(names):
            cond = cond & (F.col(n) >= F.col(f"_left{d}")) & (F.col(n) < F.col(f"_right{d}"))
        if k:
            cond = (F.col("_of") == F.floor(F.col("_run") / BOX_FAN).cast("int")) & cond
        if not k or tree.num_leaves / size <= BROADCAST_BOXES:
            boxes = F.broadcast(boxes)
        found = found.join(boxes, cond).select(*positions.columns, *names, F.col("_run").alias("_of"))
    return found.select(*positions.columns, F.col("_of").alias("leaf_id"))


def outside(tree: TreeModel, positions: DataFrame, coords: list[str]) -> DataFrame:
    """Positions that no leaf holds: a negated filter, no join."""
    return positions.filter(~_inside(tree, wrapped(tree, [F.col(c).cast("double") for c in coords])))


def get(tree: TreeModel, position: list[float]) -> Row:
    """The leaf of one position; AssertionError on a wrong length, ValueError outside."""
    if len(position) != tree.ndim:
        raise AssertionError(f"position of length {len(position)} in {tree.ndim} dimensions")
    one = local_rows(tree.nodes.sparkSession, [tuple(map(float, position))], ", ".join(f"p{d} double" for d in range(tree.ndim)))
    leaf = locate(tree, one, one.columns).first()["leaf_id"]
    if leaf is None:
        raise ValueError("the position is outside the domain")
    return tree.leaves.filter(F.col("leaf_id") == leaf).first()
