"""One query per operator over the generated tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwood import make_tree
from boxwood.functions.boxes import wrap
from boxwood.functions.points import PointSet, arg_extreme, bounds_df
from boxwood.operators import adjacency, distribute, locate, ordering
from boxwood.operators.consolidate import consolidate
from boxwood.plans.build import build
from boxwood.plans.local import State
from boxwood.plans.model import TreeModel
from boxwood.plans.stage import local_rows, shared_dir
from boxwood.sources import segments, store

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _since_first(df: DataFrame, col: str) -> DataFrame:
    """``_us``: microseconds since the table's first timestamp, zone-free."""
    us = F.unix_micros(F.col(col).cast("timestamp"))
    return df.withColumn("_us", us - F.lit(df.agg(F.min(us)).first()[0]))


def point_set(spark: SparkSession, sf: str, name: str) -> PointSet:
    if name == "orders":
        d = _since_first(table(spark, sf, "orders"), "o_orderdate")
        return PointSet.from_df(d, "o_orderkey", [F.col("o_totalprice") / 1000, F.col("_us").cast("double") / 86400000000 / 10])
    if name == "events":
        d = _since_first(table(spark, sf, "events"), "ts")
        most = d.agg(F.max("_us")).first()[0]
        return PointSet.from_df(d, "event_id", [F.col("_us").cast("double") / F.lit(float(most)) * 500, "value", "user_id"])
    if name == "customer":
        return PointSet.from_df(table(spark, sf, "customer"), "c_custkey", ["c_acctbal", "c_custkey"])
    if name == "part":
        return PointSet.from_df(table(spark, sf, "part"), "p_partkey", [F.col("p_size") * 20, "p_retailprice"])
    return PointSet.from_df(table(spark, sf, "embeddings"), "vec_id", [F.col("embedding")[i] for i in range(4)])


#: Trees that several queries use: points, and how they are built.
TREES: dict[str, tuple[str, dict]] = {
    "orders": ("orders", {"leafsize": 500}),
    "orders_wrap": ("orders", {"leafsize": 500, "periodic": True}),
    "events": ("events", {"leafsize": 400}),
    "events_wrap": ("events", {"leafsize": 400, "periodic": [True, True, False]}),
    "part_slide": ("part", {"leafsize": 60, "use_sliding_midpoint": True}),
    "part": ("part", {"leafsize": 60}),
    "customer": ("customer", {"nleaves": 16}),
    "vectors": ("vectors", {"leafsize": 20}),
}


def tree(spark: SparkSession, sf: str, name: str) -> TreeModel:
    points, how = TREES[name]
    return build(point_set(spark, sf, points), **how)


def flat(df: DataFrame, ndim: int, *keep: str, flags: bool = False) -> DataFrame:
    cols = [F.col(f"{side}_edge")[d].alias(f"{side[0]}e{d}") for d in range(ndim) for side in ("left", "right")]
    if flags:
        cols += [F.col(f"periodic_{side}")[d].alias(f"p{side[0]}{d}") for d in range(ndim) for side in ("left", "right")]
    return df.select(*keep, *cols)


def _leaves(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = tree(spark, sf, name)
        return flat(t.leaves, t.ndim, "leaf_id", "path", "npts", "start_idx", "stop_idx", flags=True)

    return run


def _nodes(spark, sf):
    t = build(point_set(spark, sf, "orders"), leafsize=500, subtree_points=4000)
    return t.nodes.filter("NOT is_leaf").select("path", "depth", "split_dim", "split_val", "npts", "start_idx")


def _positions(spark, sf) -> DataFrame:
    """Order positions, some pushed outside or across the boundary by their id."""
    p = point_set(spark, sf, "orders").df
    k = F.pmod("point_id", F.lit(5)).cast("double") - 1
    return p.select("point_id", (F.col("c0") * (k / 2 + 0.5)).alias("x"), (F.col("c1") + k * 50).alias("y"))


def _locate(name: str) -> Query:
    def run(spark, sf):
        got = locate.locate(tree(spark, sf, name), _positions(spark, sf), ["x", "y"])
        return got.filter("leaf_id IS NOT NULL").select("point_id", "leaf_id")

    return run


def _outside(spark, sf):
    return locate.outside(tree(spark, sf, "orders"), _positions(spark, sf), ["x", "y"]).select("point_id")


def _by_box(spark, sf):
    return locate.locate_by_box(tree(spark, sf, "orders"), _positions(spark, sf), ["x", "y"]).select("point_id", "leaf_id")


def _stored_vs_located(spark, sf):
    t = tree(spark, sf, "part")
    at = locate.locate(t, t.leaf_points(point_set(spark, sf, "part").df).withColumnRenamed("leaf_id", "stored"), ["c0", "c1"])
    return at.agg(F.count_if(F.col("leaf_id").isNull()).alias("outside"), F.count_if(F.col("leaf_id") != F.col("stored")).alias("moved"))


def _wrapped(spark, sf):
    p = _positions(spark, sf)
    return p.select("point_id", wrap(F.col("x"), 10.0, 200.0).alias("wx"), wrap(F.col("y"), -20.0, 120.0).alias("wy"))


def _neighbors(name: str) -> Query:
    return lambda spark, sf: adjacency.neighbors(tree(spark, sf, name))


def _neighbor_ids(spark, sf):
    return adjacency.neighbor_ids(tree(spark, sf, "orders"), _positions(spark, sf), ["x", "y"]).select("point_id", "neighbor_id")


def _neighbor_lists(spark, sf):
    return adjacency.neighbor_lists(tree(spark, sf, "part_slide")).select("leaf_id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


def _blocks(spark, sf, size=7):
    return distribute.distribute_blocks(point_set(spark, sf, "orders"), size)


def _kd(spark, sf, periodic=False):
    return distribute.kd_distribute(point_set(spark, sf, "events"), 8, periodic=periodic)


def _kd_regions(spark, sf):
    regions = _kd(spark, sf, True)[1]
    return flat(distribute.region_table(spark, regions), 3, F.col("leaf_id").alias("worker"), "npts", flags=True)


def _kd_adjacency(spark, sf):
    return adjacency.neighbors_of(distribute.region_table(spark, _kd(spark, sf)[1]), 3, [False] * 3)


def _subtrees(spark, sf):
    t = build(point_set(spark, sf, "orders"), leafsize=500, subtree_points=4000)
    return flat(t.subtree_bounds(), 2, "subtree", "npts", "num_leaves")


def _round_trip(spark, sf):
    return flat(_loaded(spark, sf).leaves, 2, "leaf_id", "path", "npts", "start_idx", "stop_idx", flags=True)


def _loaded(spark, sf) -> TreeModel:
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    store.save(tree(spark, sf, "customer"), path, data_version=7)
    return store.load(spark, path, 7)


def _consolidated(spark, sf):
    t = consolidate(tree(spark, sf, "customer"))
    ids = lambda k: t.leaf_idx(k).tolist()
    rows = [(x.leaf_id, x.npts, x.start_idx, x.stop_idx, min(ids(k)), max(ids(k)), sum(ids(k)), ",".join(map(str, t.near[k]))) for k, x in enumerate(t.leaves)]
    return local_rows(spark, rows, "leaf_id int, npts long, start_idx long, stop_idx long, first_id long, last_id long, sum_ids long, neighbors string")


#: Positions asked one by one, some outside, one of the wrong length.
ASKED = ([100.0, 50.0], [250.5, 100.25], [42.0, 7.0], [-1.0, 50.0], [100.0, 1e9], [100.0])


def _get(spark, sf):
    t, local = tree(spark, sf, "orders"), consolidate(tree(spark, sf, "orders"))
    rows = []
    for k, position in enumerate(ASKED):
        try:
            leaf = locate.get(t, position)
            rows.append((k, leaf.leaf_id, leaf.npts, local.get(position) == leaf, None))
        except (ValueError, AssertionError) as e:
            rows.append((k, None, None, None, type(e).__name__))
    return local_rows(spark, rows, "k int, leaf_id int, npts long, same_locally boolean, error string")


def _nproc(spark, sf):
    t = make_tree(point_set(spark, sf, "orders"), nproc=4, leafsize=500)
    return flat(t.leaves, 2, "leaf_id", "path", "npts", "start_idx", "stop_idx", flags=True)


#: A node of a larger domain: its split bounds, box, and flags of either side.
PARTIAL = State("", (0.0, 800.0), (1200.0, 2200.0), (-50.0, 700.0), (1300.0, 2500.0), (True, False), (False, True), (None, None), (None, None))


def _partial(spark, sf):
    t = build(point_set(spark, sf, "part"), leafsize=60, start=PARTIAL)
    return flat(t.leaves, 2, "leaf_id", "path", "npts", "start_idx", "stop_idx", flags=True)


def _equality(spark, sf):
    a, b, c = (build(point_set(spark, sf, "customer"), **how) for how in ({"leafsize": 100}, {"leafsize": 100, "subtree_points": 200}, {"leafsize": 100, "periodic": True}))
    rows = [(name, strict, ",".join(x.differences(y, strict))) for name, x, y in (("other subtrees", a, b), ("other flags", a, c)) for strict in (True, False)]
    return local_rows(spark, rows, "pair string, strict boolean, differences string")


def _errors(spark, sf):
    points = point_set(spark, sf, "customer")
    t = tree(spark, sf, "customer")
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    store.save(t, path, data_version=3)
    cases = {
        "leafsize below 2": lambda: build(points, leafsize=1),
        "edges of another length": lambda: build(points, left_edge=[0.0]),
        "flags of another length": lambda: build(points, periodic=[True]),
        "no points": lambda: build(PointSet(points.df.limit(0), 2)),
        "null coordinate": lambda: build(PointSet(points.df.withColumn("c0", F.lit(None).cast("double")), 2)),
        "leaf out of range": lambda: t.leaf_idx(t.num_leaves),
        "rank out of range": lambda: ordering.select(points, 0, 10**9),
        "split rank out of range": lambda: distribute.redistribute(points, 5, 5),
        "version of another tree": lambda: store.load(spark, path, 4),
        "too large for one place": lambda: consolidate(t, 10),
    }
    rows = []
    for name, run in cases.items():
        try:
            run()
            rows.append((name, None))
        except (ValueError, IndexError, OSError) as e:
            rows.append((name, type(e).__name__))
    return local_rows(spark, rows, "what string, error string")


def _labels(spark, sf):
    t = build(point_set(spark, sf, "orders"), leafsize=500, subtree_points=4000)
    return segments.leaf_segments(t.leaves)


def _pivot(spark, sf):
    q, value, point = ordering.pivot(point_set(spark, sf, "customer"), 0)
    return local_rows(spark, [(q, value, point)], "q long, value double, point_id long")


@lru_cache(1)
def queries() -> dict[str, Query]:
    ps = point_set
    return {
        "tree_leaves_2d": _leaves("orders"),
        "tree_leaves_3d": _leaves("events"),
        "tree_leaves_4d": _leaves("vectors"),
        "tree_leaves_midpoint": _leaves("part_slide"),
        "tree_nleaves": _leaves("customer"),
        "tree_nodes": _nodes,
        "tree_membership": lambda s, d: tree(s, d, "orders").membership,
        "tree_edges": lambda s, d: tree(s, d, "orders").edges_long(),
        "subtree_bounds": _subtrees,
        "leaf_points": lambda s, d: tree(s, d, "orders").leaf_points(ps(s, d, "orders").df).filter("leaf_id = 3").select("point_id", "c0", "c1", "idx_pos"),
        "leaf_idx": lambda s, d: tree(s, d, "orders").leaf_idx(2),
        "leaf_slice": lambda s, d: tree(s, d, "orders").leaf_slice(1000, 2500),
        "pts_bounds": lambda s, d: bounds_df(ps(s, d, "events")),
        "argmax_slice": lambda s, d: arg_extreme(ps(s, d, "customer"), 0, 20, 120, True),
        "argmin_slice": lambda s, d: arg_extreme(ps(s, d, "customer"), 0, 20, 120, False),
        "order_dim": lambda s, d: ordering.order_dim(ps(s, d, "part"), 1),
        "pivot_groups5": _pivot,
        "partition_element": lambda s, d: ordering.partition_at(ps(s, d, "part"), 0, 77),
        "partition_value": lambda s, d: ordering.partition_value(ps(s, d, "part"), 1, 950.0),
        "select_t": lambda s, d: ordering.select(ps(s, d, "part"), 0, 123),
        "split_median": lambda s, d: ordering.split(ps(s, d, "part")),
        "split_midpoint": lambda s, d: ordering.split(ps(s, d, "part"), use_sliding_midpoint=True),
        "split_slide_min": lambda s, d: ordering.split(ps(s, d, "part"), [-1e5, 0.0], [10.0, 1.0], True),
        "split_slide_max": lambda s, d: ordering.split(ps(s, d, "part"), [0.0, 0.0], [1e5, 1.0], True),
        "wrap_positions": _wrapped,
        "locate_batch": _locate("orders"),
        "locate_by_box": _by_box,
        "locate_periodic": _locate("orders_wrap"),
        "locate_outside": _outside,
        "stored_vs_located": _stored_vs_located,
        "neighbors_2d": _neighbors("orders"),
        "neighbors_midpoint": _neighbors("part_slide"),
        "neighbors_periodic_2d": _neighbors("orders_wrap"),
        "neighbors_periodic_3d": _neighbors("events_wrap"),
        "all_neighbors": lambda s, d: adjacency.all_neighbors(tree(s, d, "orders_wrap")),
        "neighbor_lists": _neighbor_lists,
        "neighbor_ids_of_positions": _neighbor_ids,
        "box_overlap": lambda s, d: adjacency.overlapping(tree(s, d, "part").leaves, 2),
        "distribute_blocks": lambda s, d: _blocks(s, d).select("point_id", "block"),
        "pivot_of_blocks": lambda s, d: distribute.pivot_of_blocks(_blocks(s, d), 0),
        "select_by_block": lambda s, d: distribute.select_by_block(_blocks(s, d), 1, 1234),
        "split_by_block": lambda s, d: distribute.split_by_block(_blocks(s, d), 2),
        "redistribute_sides": lambda s, d: distribute.redistribute(ps(s, d, "orders"), 5).select("point_id", "side", "target"),
        "split_rounds": lambda s, d: local_rows(s, distribute.rounds(13), "worker int, n_rounds int, first_round int"),
        "kd_distribute": lambda s, d: _kd(s, d)[0].select("point_id", "worker"),
        "kd_regions": _kd_regions,
        "subtree_adjacency": _kd_adjacency,
        "save_load_roundtrip": _round_trip,
        "save_load_membership": lambda s, d: _loaded(s, d).membership,
        "consolidated_tree": _consolidated,
        "get_position": _get,
        "make_tree_nproc": _nproc,
        "tree_partial_domain": _partial,
        "tree_equality": _equality,
        "tree_errors": _errors,
        "tree_repr": lambda s, d: local_rows(s, [(repr(tree(s, d, "orders")),)], "text string"),
        "leaf_labels": _labels,
        "leaf_segments": lambda s, d: segments.leaf_segments(tree(s, d, "customer").leaves).drop("label"),
    }
