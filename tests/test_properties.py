"""Invariants of trees on random point sets, and units of the ordering operators."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxwood import PointSet, build
from boxwood.functions.points import arg_extreme, bounds
from boxwood.operators import adjacency, distribute, locate, ordering
from boxwood.plans.local import State, finish
from boxwood.plans.select import global_rank, kth


def points(spark, x):
    m = x.shape[1]
    return PointSet(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "point_id long, " + ", ".join(f"c{d} double" for d in range(m))), m)


def root_of(x, periodic=False):
    m = x.shape[1]
    lo, hi = tuple(map(float, x.min(0))), tuple(map(float, x.max(0)))
    return State("", lo, hi, lo, hi, (periodic,) * m, (periodic,) * m, (None,) * m, (None,) * m)


@given(st.integers(1, 4), st.integers(1, 200), st.integers(2, 20), st.booleans(), st.integers(1, 30), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_local_tree(m, n, leafsize, sliding, grid, seed):
    x = np.random.RandomState(seed).randint(0, grid, (n, m)).astype(float)
    done = finish(x, root_of(x), leafsize, sliding)
    leaves = [(s, k) for s, k, dim, _ in done.nodes if dim is None]
    assert sorted(np.concatenate(done.rows).tolist()) == list(range(n))
    assert [k for _, k in leaves] == [len(r) for r in done.rows]
    assert [s.path for s, _ in leaves] == sorted(s.path for s, _ in leaves)
    for (s, k), rows in zip(leaves, done.rows, strict=True):
        assert k < leafsize or max(b - a for a, b in zip(s.mins, s.maxs)) == 0
        assert (x[rows] >= np.array(s.left)).all() and (x[rows] <= np.array(s.right)).all()
    # The boxes tile the domain: their volumes add up to it.
    volume = lambda s: np.prod([b - a for a, b in zip(s.left, s.right)])
    assert np.isclose(sum(volume(s) for s, _ in leaves), volume(root_of(x)))


@pytest.mark.parametrize("periodic", [False, True])
def test_adjacency_is_symmetric_and_positions_are_found_once(spark, periodic):
    x = np.random.RandomState(8).rand(500, 3)
    t = build(points(spark, x), [0.0] * 3, [1.0] * 3, periodic, leafsize=30)
    nb = adjacency.neighbors(t).cache()
    swapped = nb.select("neighbor_id", "dim", F.when(F.col("side") == "left", "right").otherwise("left"), "leaf_id")
    assert nb.exceptAll(swapped.toDF(*nb.columns)).isEmpty()
    assert adjacency.all_neighbors(t).filter("leaf_id = neighbor_id").isEmpty()
    with_self = adjacency.all_neighbors(t, include_self=True)
    assert with_self.filter("leaf_id = neighbor_id").count() == t.num_leaves
    at = locate.locate(t, t.leaf_points(points(spark, x).df).select("point_id", "c0", "c1", "c2"), ["c0", "c1", "c2"])
    boxes = at.join(t.edges(), "leaf_id")
    inside = F.lit(True)
    for d in range(3):
        inside = inside & (F.col(f"c{d}") >= F.col("left_edge")[d]) & (F.col(f"c{d}") < F.col("right_edge")[d])
    assert boxes.count() == 500 and boxes.filter(~inside).isEmpty()


@pytest.mark.parametrize("n", [1, 10, 11, 50])
@pytest.mark.parametrize("m", [2, 3])
def test_ordering_units(spark, n, m):
    x = np.random.RandomState(10).rand(n, m)
    p, d = points(spark, x), m - 1
    rank = np.argsort(np.argsort(x[:, d], kind="stable"), kind="stable")
    assert {r.point_id: r["rank"] for r in ordering.order_dim(p, d).collect()} == dict(enumerate(rank.tolist()))
    q, value, i = ordering.pivot(p, d)
    assert q == rank[i] and value == x[i, d] and max(q, n - 1 - q) <= 0.7 * n + 6
    got = ordering.partition_at(p, d, i).collect()
    assert all(r.q == q and r.side == np.sign(rank[r.point_id] - q) for r in got)
    t = n // 2 + n % 2
    assert {r.point_id for r in ordering.select(p, d, t).collect()} == set(np.argsort(x[:, d], kind="stable")[:t].tolist())
    one = ordering.split(p).first()
    widest = int((x.max(0) - x.min(0)).argmax())
    assert n == 1 or (one.q, one.split_dim, one.split_val) == (t - 1, widest, np.sort(x[:, widest])[t - 1])


def test_slide_units(spark):
    x = np.random.RandomState(3).rand(20, 2)
    low = ordering.split(points(spark, x), [-1.0, -1.0], [-0.5, -1.0], True).first()
    assert low.q == 0 and low.split_val == x[:, 0].min()
    high = ordering.split(points(spark, x), [0.0, 0.0], [4.0, 2.0], True).first()
    assert high.q == 18 and high.split_val == np.sort(x[:, 0])[-2]
    assert ordering.split(PointSet(points(spark, x).df.limit(0), 2)).isEmpty()
    assert ordering.split(points(spark, np.ones((5, 2)))).first().split_dim is None
    assert ordering.pivot(PointSet(points(spark, x).df.limit(0), 2), 0)[0] == -1
    assert ordering.select(points(spark, x), 0, 0).isEmpty()


def test_extremes(spark):
    x = np.array([[3.0], [1.0], [3.0], [2.0], [1.0]])
    p = points(spark, x)
    assert arg_extreme(p, 0, 0, 4, True).first().pos == 0 and arg_extreme(p, 0, 0, 4, False).first().pos == 1
    assert arg_extreme(p, 0, 2, -1, False, size=5).first().pos == 4 and arg_extreme(p, 0, 3, 3, True).first().pos == 3
    with pytest.raises(IndexError):
        arg_extreme(p, 0, 0, 9, True, size=5)
    b = bounds(p)
    assert (b.n, b.mins, b.maxs, b.width) == (5, [1.0], [3.0], [2.0])


@pytest.mark.parametrize("rows", [10, 400])
def test_selection_in_rounds(spark, monkeypatch, rows):
    from boxwood.plans import select

    monkeypatch.setattr(select, "BRACKET_ROWS", rows)
    x = np.random.RandomState(5).randint(0, 40, (2000, 1)).astype(float)
    p = points(spark, x)
    order = np.lexsort((np.arange(2000), x[:, 0]))
    for k in (1, 1000, 2000):
        assert kth(p.df, "c0", k) == (x[order[k - 1], 0], order[k - 1])
    ranked = {r.point_id: r["rank"] for r in global_rank(p.df, ["c0", "point_id"]).collect()}
    assert all(ranked[int(i)] == k for k, i in enumerate(order))
    with pytest.raises(IndexError):
        kth(p.df, "c0", 2001)


@pytest.mark.parametrize("values", [1, 2, 3, 10])
def test_every_rank_of_tied_values(spark, monkeypatch, values):
    from boxwood.plans import select

    monkeypatch.setattr(select, "BRACKET_ROWS", 3)
    n = 24
    rows = [(i * 7 % 29, float(i * 5 % values)) for i in range(n)]
    order = sorted((v, i) for i, v in rows)
    # A group for each rank, all of the same rows.
    d = spark.createDataFrame([(str(k), v, i) for k in range(1, n + 1) for i, v in rows], "g string, v double, i long")
    got = select.kth_by_group(d, {str(k): (k, n) for k in range(1, n + 1)})
    assert [got[str(k)] for k in range(1, n + 1)] == order


def test_repeated_points_have_a_rank(spark, monkeypatch):
    from boxwood.plans import select

    monkeypatch.setattr(select, "BRACKET_ROWS", 3)
    d = spark.createDataFrame([(1.0, 5)] * 9 + [(2.0, 1)], "v double, point_id long")
    assert kth(d, "v", 4) == (1.0, 5) and kth(d, "v", 10) == (2.0, 1)


@pytest.mark.parametrize("sliding", [False, True])
@pytest.mark.parametrize("values", [2, 3, 10])
def test_tree_of_tied_values_beyond_the_bracket(spark, monkeypatch, values, sliding):
    from boxwood.plans import select

    monkeypatch.setattr(select, "BRACKET_ROWS", 20)
    n = 400
    x = np.column_stack([np.arange(n) % values, np.linspace(0, values, n)[np.random.RandomState(1).permutation(n)]]).astype(float)
    t = build(points(spark, x), leafsize=60, subtree_points=50, use_sliding_midpoint=sliding)
    nodes = {r.path: r for r in t.nodes.collect()}
    assert all(r.is_leaf or r.npts == nodes[p + "0"].npts + nodes[p + "1"].npts for p, r in nodes.items())
    members = t.membership.collect()
    assert sorted(r.point_id for r in members) == sorted(r.idx_pos for r in members) == list(range(n))
    sizes = {r.leaf_id: r.npts for r in t.leaves.collect()}
    assert sizes == {k: sum(r.leaf_id == k for r in members) for k in sizes}
    assert t.differences(build(points(spark, x), leafsize=60, use_sliding_midpoint=sliding)) == []


def test_local_tree(spark):
    from boxwood.operators.consolidate import consolidate

    x = np.random.RandomState(4).rand(300, 2)
    t = build(points(spark, x), [0.0, 0.0], [1.0, 1.0], [True, False], leafsize=20)
    local = consolidate(t)
    for at in ([0.5, 0.5], [1.25, 0.1], [-0.75, 0.999], [0.0, 0.0]):
        assert local.get(at) == locate.get(t, at)
        assert set(local.leaf_idx(local.find(at)).tolist()) == {r.point_id for r in t.leaf_idx(local.find(at)).collect()}
    assert sorted(local.idx.tolist()) == list(range(300)) and local.neighbor_ids([0.5, 1.0]) == []
    lists = {r.leaf_id: r.neighbors for r in adjacency.neighbor_lists(t).collect()}
    assert local.near == [lists[k] for k in range(t.num_leaves)]
    with pytest.raises(ValueError):
        local.get([0.5, 1.0])
    with pytest.raises(AssertionError):
        local.get([0.5])


@pytest.mark.parametrize("size", [3, 4, 5])
def test_distribution(spark, size):
    x = np.random.RandomState(size).rand(50, 2)
    p = points(spark, x)
    counts = [r["count"] for r in distribute.distribute_blocks(p, size).groupBy("block").count().orderBy("block").collect()]
    assert counts == [50 // size + (k < 50 % size) for k in range(size)]
    placed, regions = distribute.kd_distribute(p, size, [0.0, 0.0], [1.0, 1.0])
    boxes = {w: s for w, _, s in regions}
    rows = placed.collect()
    assert sum(n for _, n, _ in regions) == 50 and {r.worker for r in rows} == set(range(size))
    assert all(boxes[r.worker].left[d] <= r[f"c{d}"] <= boxes[r.worker].right[d] for r in rows for d in range(2))
    sides = distribute.redistribute(p, size).collect()
    assert all((r.side == 0) == (r.target < distribute.split_rank(size)) for r in sides)
    with pytest.raises(ValueError):
        distribute.redistribute(p, size, size)


def test_rounds():
    assert [distribute.split_rank(n) for n in (2, 3, 4, 5)] == [1, 2, 2, 3] and distribute.split_rank(5, False) == 2
    assert distribute.rounds(1) == [(0, 1, 0)]
    assert {n for _, n, _ in distribute.rounds(5)} == {4} and {n for _, n, _ in distribute.rounds(4)} == {3}


def test_stream(spark, tmp_path):
    from boxwood.streaming import locate as streaming

    x = np.random.RandomState(2).rand(60, 2)
    t = build(points(spark, x), [0.0, 0.0], [1.0, 1.0], leafsize=10)
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(60, 2.0, 2.0)]
    spark.createDataFrame(rows, "k int, x double, y double").selectExpr("k", "x", "y", "timestamp_seconds(k * 60) AS ts").write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("k int, x double, y double, ts timestamp").parquet(f"{tmp_path}/in")

    def finished(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = finished(streaming.locate_stream(t, source(), ["x", "y"]), "at", "append")
    want = {r.k: r.leaf_id for r in locate.locate(t, spark.read.parquet(f"{tmp_path}/in"), ["x", "y"]).collect()}
    assert {r.k: r.leaf_id for r in got} == want and want[60] is None
    counts = finished(streaming.counts_by_leaf(t, source(), ["x", "y"], "ts"), "counts", "complete")
    assert sum(r.n for r in counts) == 60


def test_segments(spark):
    from boxwood.sources.segments import leaf_segments, svg

    t = build(points(spark, np.random.RandomState(1).rand(40, 2)), [0.0, 0.0], [1.0, 1.0], leafsize=10)
    s = leaf_segments(t.leaves).collect()
    assert len(s) == 4 * t.num_leaves and {r.seg for r in s} == {0, 1, 2, 3}
    assert all((r.x0 == r.x1) or (r.y0 == r.y1) for r in s)
    assert repr(t).startswith("TreeModel(40 points")
    drawn = svg(t, points(spark, np.random.RandomState(1).rand(40, 2)).df, label_boxes=True)
    assert drawn.count("<line") == 4 * t.num_leaves and drawn.count("<circle") == 40 and drawn.count("<text") == t.num_leaves
    with pytest.raises(ValueError):
        svg(build(points(spark, np.random.RandomState(1).rand(40, 3)), leafsize=10))


settings.register_profile("quiet", suppress_health_check=[HealthCheck.too_slow])
settings.load_profile("quiet")
