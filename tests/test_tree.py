"""Building, adjacency, location and storage, on fixtures and against invariants."""

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from boxwood import PointSet, build, make_tree
from boxwood.operators import adjacency, locate
from boxwood.plans.build import leafsize_for
from boxwood.plans.stage import local_rows
from boxwood.sources import store

LEFT = {False: [[[], [0], [1], [2], [], [], [4, 5], [5]], [[], [], [], [], [0, 1], [4], [1, 2, 3], [6]]], True: [[[3], [0], [1], [2], [6], [6, 7], [4, 5], [5]], [[5], [5, 7], [7], [7], [0, 1], [4], [1, 2, 3], [6]]]}


def golden():
    rng = np.random.RandomState(100)
    rng.rand(100, 2), rng.rand(100, 3)
    return rng.rand(50, 2)


def points(spark, x):
    m = x.shape[1]
    return PointSet(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "point_id long, " + ", ".join(f"c{d} double" for d in range(m))), m)


def test_golden_leaves(spark):
    t = build(points(spark, golden()), [0, 0], [1, 1], leafsize=10)
    rows = t.leaves.orderBy("leaf_id").collect()
    assert [r.path for r in rows] == ["000", "001", "010", "011", "100", "101", "110", "111"]
    assert [r.npts for r in rows] == [7, 6, 6, 6, 7, 6, 6, 6]
    assert [r.start_idx for r in rows] == [0, 7, 13, 19, 25, 32, 38, 44]
    assert np.allclose(rows[6].left_edge, [0.379888, 0.406996], atol=1e-6)


@pytest.mark.parametrize("periodic", [False, True])
def test_golden_adjacency(spark, periodic):
    t = build(points(spark, golden()), [0, 0], [1, 1], periodic, leafsize=10)
    got = {(d, i): [] for d in range(2) for i in range(8)}
    for r in adjacency.neighbors(t).filter("side = 'left'").collect():
        got[r["dim"], r["leaf_id"]].append(r["neighbor_id"])
    assert [[sorted(got[d, i]) for i in range(8)] for d in range(2)] == LEFT[periodic]


@pytest.mark.parametrize("sliding", [False, True])
def test_top_levels_equal_local(spark, sliding):
    r = np.random.RandomState(1)
    x = np.round(r.rand(300, 3) ** 3 * 20)  # heavy ties, clustered
    a = build(points(spark, x), leafsize=8, use_sliding_midpoint=sliding, periodic=[True, False, True])
    b = build(points(spark, x), leafsize=8, use_sliding_midpoint=sliding, periodic=[True, False, True], subtree_points=60)
    assert b.nodes.filter("subtree IS NULL").count() > 2
    assert a.differences(b) == []
    assert adjacency.neighbors(a).exceptAll(adjacency.neighbors(b)).isEmpty()
    assert a.membership.agg(F.count_distinct("point_id"), F.count_distinct("idx_pos")).first()[:] == (300, 300)


def test_tasks_get_no_other_subtrees(spark, monkeypatch):
    sizes = []
    for kind in (GroupedData, PandasCogroupedOps):

        def seen(self, func, schema, run=kind.applyInArrow):
            sizes.append(len(cloudpickle.dumps(func)))
            return run(self, func, schema)

        monkeypatch.setattr(kind, "applyInArrow", seen)
    x = np.random.RandomState(6).rand(2000, 2)
    one, many = (build(points(spark, x), leafsize=10, subtree_points=k) for k in (2000, 20))
    assert one.differences(many) == []
    assert sizes[1] < 1.1 * sizes[0]


def test_local_rows(spark):
    schema = "a string, b array<double>, c array<boolean>, d int, e double, f array<string>"
    rows = [("", [0.1, float("inf")], [True, False], 1, -0.0, [None, "0"]), (None, None, None, None, None, None)]
    got = local_rows(spark, rows, schema)
    assert got.collect() == spark.createDataFrame(rows, schema).collect() and got.schema == spark.createDataFrame(rows, schema).schema
    assert "LocalTableScan" in got._jdf.queryExecution().executedPlan().toString()  # no RDD, which Python processes would read
    assert local_rows(spark, [], schema).collect() == []


def brute_adjacent(leaves, nodes, m):
    """The literal descent: each leaf's less sibling of its deepest split per dim."""
    inner = {n.path: n for n in nodes if not n.is_leaf}
    out = set()
    for a in leaves:
        for d in range(m):
            anc = [a.path[:k] for k in range(len(a.path)) if inner[a.path[:k]].split_dim == d and a.path[k] == "1"]
            if not anc:
                continue
            todo = [anc[-1] + "0"]
            while todo:
                p = todo.pop()
                if p not in inner:
                    out.add((a.leaf_id, d, p))
                    continue
                n = inner[p]
                if n.split_dim == d:
                    todo.append(p + "1")
                else:
                    if n.split_val >= a.left_edge[n.split_dim]:
                        todo.append(p + "0")
                    if n.split_val <= a.right_edge[n.split_dim]:
                        todo.append(p + "1")
    ids = {x.path: x.leaf_id for x in leaves}
    return {(i, d, ids[p]) for i, d, p in out}


@pytest.mark.parametrize("sliding", [False, True])
def test_adjacency_with_equal_planes(spark, sliding):
    r = np.random.RandomState(3)
    t = build(points(spark, r.randint(0, 9, (200, 2)).astype(float)), leafsize=6, use_sliding_midpoint=sliding)
    got = {(x.leaf_id, x.dim, x.neighbor_id) for x in adjacency.neighbors(t).filter("side = 'left'").collect()}
    assert got == brute_adjacent(t.leaves.collect(), t.nodes.collect(), 2)


def test_locate(spark):
    x = golden()
    t = build(points(spark, x), [0, 0], [1, 1], [True, False], leafsize=10)
    q = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.5, 0.5), (2, -0.5, 0.5), (3, 0.5, 1.0), (4, 0.0, 0.0), (5, None, 0.1), (6, float("nan"), 0.1), (7, -1.0, 0.2)], "k int, x double, y double")
    got = {r.k: r.leaf_id for r in locate.locate(t, q, ["x", "y"]).collect()}
    assert got[0] == got[1] == got[2] == 6 and got[3] is None and got[4] == 0 and got[5] is None and got[6] is None and got[7] == 0
    assert {r.k: r.leaf_id for r in locate.locate_by_box(t, q, ["x", "y"]).collect()} == {k: v for k, v in got.items() if v is not None}
    two = build(points(spark, x), [0, 0], [1, 1], [True, False], leafsize=10, subtree_points=20)
    assert {r.k: r.leaf_id for r in locate.locate(two, q, ["x", "y"], broadcast_nodes=0).collect()} == got
    assert {r.k for r in locate.outside(t, q, ["x", "y"]).collect()} >= {3, 5}
    assert locate.get(t, [0.5, 0.5]).leaf_id == 6
    with pytest.raises(ValueError):
        locate.get(t, [0.5, 1.0])
    with pytest.raises(AssertionError):
        locate.get(t, [0.5])


@pytest.mark.parametrize("sliding", [False, True])
@pytest.mark.parametrize("broadcast_boxes", [0, locate.BROADCAST_BOXES])
def test_locate_by_box_in_large_trees(spark, monkeypatch, sliding, broadcast_boxes):
    monkeypatch.setattr(locate, "BROADCAST_BOXES", broadcast_boxes)
    r = np.random.RandomState(4)
    x = np.round(r.rand(9000, 2) ** 3 * 2000)  # clustered, with ties
    t = build(points(spark, x), periodic=[True, False], leafsize=3, use_sliding_midpoint=sliding, subtree_points=2000)
    assert t.num_leaves > locate.BOX_FAN**2
    q = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(np.vstack([x[:2000], r.rand(2000, 2) * 2400 - 200]))] + [(-1, None, 1.0), (-2, float("nan"), 1.0)], "k int, x double, y double")
    got = locate.locate_by_box(t, q, ["x", "y"])
    want = locate.locate(t, q, ["x", "y"]).filter("leaf_id IS NOT NULL")
    assert got.schema == want.schema
    assert sorted(got.collect()) == sorted(want.collect())


def test_sizes():
    assert leafsize_for(100, 10, 4) == 26 and leafsize_for(101, 10, 4) == 26
    with pytest.raises(ValueError):
        leafsize_for(10, 1, 0)


@pytest.mark.parametrize(("n", "k", "leaves"), [(100, 4, 4), (101, 4, 5), (101, 3, 5), (1000, 8, 8), (1001, 8, 9)])
def test_nleaves(spark, n, k, leaves):
    assert build(points(spark, np.random.RandomState(0).rand(n, 2)), nleaves=k).num_leaves == leaves


def test_degenerate(spark):
    same = build(points(spark, np.ones((40, 2))), leafsize=5)
    assert same.num_leaves == 1 and same.leaves.first().npts == 40
    line = build(points(spark, np.column_stack([np.zeros(40), np.arange(40.0)])), leafsize=5)
    assert {r.split_dim for r in line.nodes.filter("NOT is_leaf").collect()} == {1}
    one = build(points(spark, np.array([[0.5]])), leafsize=2, periodic=True)
    assert one.num_leaves == 1
    flat = build(points(spark, np.arange(30.0)[:, None]), leafsize=4, periodic=True)
    assert adjacency.neighbors(flat).filter("leaf_id = 0 AND side = 'left'").count() == 0
    for bad in (float("nan"), None):
        with pytest.raises(ValueError):
            build(PointSet(spark.createDataFrame([(1, bad)], "point_id long, c0 double"), 1))
    with pytest.raises(ValueError):
        build(points(spark, golden()), left_edge=[0.0], leafsize=5)


@pytest.mark.parametrize("m", [1, 2, 4])
def test_store(spark, tmp_path, m):
    t = make_tree(points(spark, np.random.RandomState(100).rand(100, m)), leafsize=10, periodic=True, data_version=m + 12)
    store.save(t, f"{tmp_path}/t")
    assert store.load(spark, f"{tmp_path}/t", m + 12).differences(t) == []
    with pytest.raises(OSError):
        store.load(spark, f"{tmp_path}/t", 1)
