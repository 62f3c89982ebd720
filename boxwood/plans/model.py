"""The built tree: four DataFrames and a few scalars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwood.plans.local import State
from boxwood.plans.stage import local_rows


@dataclass
class TreeModel:
    """``nodes`` (inner and leaf), ``leaves``, ``membership`` and ``meta``;
    adjacency is made from ``leaves`` on demand."""

    nodes: DataFrame
    leaves: DataFrame
    membership: DataFrame
    meta: dict

    @classmethod
    def assemble(cls, rows: DataFrame, top: dict, subtrees: dict[str, tuple[State, int]], meta: dict) -> TreeModel:
        """Number leaves and positions. The driver sees one count per subtree."""
        spark = rows.sparkSession
        is_node = F.col("point_id").isNull()
        counts = {r["subtree"]: r["n"] for r in rows.filter(is_node & F.col("split_dim").isNull()).groupBy("subtree").agg(F.count(F.lit(1)).alias("n")).collect()}
        offsets, leaf, pos = [], 0, 0
        for path in sorted(subtrees):
            offsets.append((path, leaf, pos))
            leaf, pos = leaf + counts.get(path, 0), pos + subtrees[path][1]
        if leaf > 2**31 - 1:
            raise OverflowError("more leaves than leaf ids")
        off = F.broadcast(local_rows(spark, offsets, "subtree string, leaf0 int, pos0 long"))
        numbered = rows.join(off, "subtree")
        leaf_id, start = (F.col("leaf0") + F.col("local_leaf")).cast("int"), (F.col("pos0") + F.col("local_pos")).cast("long")
        box = ["left_edge", "right_edge", "periodic_left", "periodic_right", "left_plane", "right_plane"]
        state = ["mins", "maxs", *box]
        nodes = numbered.filter(is_node).select("path", F.length("path").alias("depth"), F.col("split_dim").isNull().alias("is_leaf"), "split_dim", "split_val", "npts", start.alias("start_idx"), F.when(F.col("split_dim").isNull(), leaf_id).alias("leaf_id"), "subtree", *state)
        if top:
            first = dict((p, q) for p, _, q in offsets)
            begin = lambda path: min(q for p, q in first.items() if p.startswith(path))
            recs = [(p, len(p), False, d, float(v), n, begin(p), None, None, list(s.mins), list(s.maxs), list(s.left), list(s.right), list(s.periodic_left), list(s.periodic_right), list(s.left_plane), list(s.right_plane)) for p, (s, n, d, v) in top.items()]
            nodes = nodes.unionByName(local_rows(spark, recs, nodes.schema))
        leaves = nodes.filter("is_leaf").select("leaf_id", "path", "subtree", "npts", "start_idx", (F.col("start_idx") + F.col("npts")).alias("stop_idx"), *box)
        members = numbered.filter(~is_node).select("point_id", leaf_id.alias("leaf_id"), start.alias("idx_pos"))
        return cls(nodes, leaves, members, meta | {"num_leaves": leaf})

    @property
    def ndim(self) -> int:
        return self.meta["ndim"]

    @property
    def num_leaves(self) -> int:
        return self.meta["num_leaves"]

    @property
    def left_edge(self) -> list[float]:
        return self.meta["left_edge"]

    @property
    def right_edge(self) -> list[float]:
        return self.meta["right_edge"]

    @property
    def periodic(self) -> list[bool]:
        return self.meta["periodic"]

    @property
    def domain_width(self) -> list[float]:
        return [b - a for a, b in zip(self.left_edge, self.right_edge, strict=True)]

    def idx(self) -> DataFrame:
        """The permutation: point ids by position."""
        return self.membership.select("idx_pos", "point_id")

    def leaf_idx(self, leaf_id: int) -> DataFrame:
        """Ids of the points stored in a leaf."""
        if not 0 <= leaf_id < self.num_leaves:
            raise IndexError(f"leaf {leaf_id} of {self.num_leaves}")
        return self.membership.filter(F.col("leaf_id") == leaf_id).select("point_id")

    def leaf_slice(self, start: int, stop: int) -> DataFrame:
        """Ids at positions start <= pos < stop."""
        return self.membership.filter((F.col("idx_pos") >= start) & (F.col("idx_pos") < stop)).select("idx_pos", "point_id")

    def leaf_points(self, points: DataFrame) -> DataFrame:
        """``points`` with the leaf they are stored in."""
        return points.join(self.membership, "point_id")

    def edges(self) -> DataFrame:
        """Box edges of all leaves, ``leaf_id, left_edge, right_edge``."""
        return self.leaves.select("leaf_id", "left_edge", "right_edge")

    def edges_long(self) -> DataFrame:
        """One row per leaf and dimension."""
        return self.leaves.select("leaf_id", F.posexplode(F.arrays_zip("left_edge", "right_edge")).alias("dim", "e")).select("leaf_id", "dim", "e.left_edge", "e.right_edge")

    def subtree_bounds(self) -> DataFrame:
        """Per subtree: points, leaves, box and boundary flags."""
        m = range(self.ndim)
        return self.leaves.groupBy("subtree").agg(
            F.sum("npts").alias("npts"), F.count(F.lit(1)).alias("num_leaves"),
            F.array(*[F.min(F.col("left_edge")[d]) for d in m]).alias("left_edge"), F.array(*[F.max(F.col("right_edge")[d]) for d in m]).alias("right_edge"),
            F.array(*[F.bool_or(F.col("periodic_left")[d]) for d in m]).alias("periodic_left"), F.array(*[F.bool_or(F.col("periodic_right")[d]) for d in m]).alias("periodic_right"),
        )

    def differences(self, other: TreeModel, strict: bool = True) -> list[str]:
        """What differs; ``strict`` compares positions too, else leaf by leaf sets."""
        out = [k for k in self.meta if k != "data_version" and self.meta[k] != other.meta.get(k)]
        shape = ["leaf_id", "npts", "start_idx", "stop_idx", "left_edge", "right_edge", "periodic_left", "periodic_right"]
        member = ["point_id", "leaf_id", *(["idx_pos"] if strict else [])]
        for name, cols in (("leaves", shape), ("membership", member)):
            a, b = getattr(self, name).select(*cols), getattr(other, name).select(*cols)
            if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
                out.append(name)
        return out

    def __repr__(self) -> str:
        return f"TreeModel({self.meta['npts']} points, {self.ndim} dimensions, {self.num_leaves} leaves)"
