"""DuckDB SQL for every query: trees unrolled level by level as CTEs."""

from __future__ import annotations

POINTS = {
    "orders": ("SELECT o_orderkey AS point_id, o_totalprice::DOUBLE / 1000::DOUBLE AS c0, (epoch_us(o_orderdate) - (SELECT min(epoch_us(o_orderdate)) FROM orders))::DOUBLE / 86400000000::DOUBLE / 10::DOUBLE AS c1 FROM orders", 2),
    "events": ("SELECT event_id AS point_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))::DOUBLE / (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events)::DOUBLE * 500::DOUBLE AS c0, value::DOUBLE AS c1, user_id::DOUBLE AS c2 FROM events", 3),
    "customer": ("SELECT c_custkey AS point_id, c_acctbal::DOUBLE AS c0, c_custkey::DOUBLE AS c1 FROM customer", 2),
    "part": ("SELECT p_partkey AS point_id, (p_size * 20)::DOUBLE AS c0, p_retailprice::DOUBLE AS c1 FROM part", 2),
    "vectors": ("SELECT vec_id AS point_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS c{i}" for i in range(4)) + " FROM embeddings", 4),
}


def _each(m: int, text: str) -> str:
    return ", ".join(text.format(d=d) for d in range(m))


def tree(points: str, leafsize: str, levels: int, periodic: list[bool] | bool = False, sliding: bool = False, root: dict | None = None) -> str:
    """CTEs ``pts``, ``nodes`` and ``leaves``. A row per point carries its node's
    state; each level splits the nodes that are not leaves. ``root`` replaces the
    state of the first node (mn, mx, le, re, pl, pr by dimension)."""
    source, m = POINTS[points]
    flags = [periodic] * m if isinstance(periodic, bool) else periodic
    own = lambda k, d, else_: else_ if root is None else f"{str(root[k][d]).lower()}{'' if k[0] == 'p' else '::DOUBLE'}"
    first = [(k, d, e) for d, f in enumerate(flags) for k, e in (("mn", f"min(c{d}) OVER ()"), ("mx", f"max(c{d}) OVER ()"), ("le", f"min(c{d}) OVER ()"), ("re", f"max(c{d}) OVER ()"), ("pl", str(f).lower()), ("pr", str(f).lower()))]
    root_ = "SELECT p.*, ''::VARCHAR AS path, count(*) OVER () AS n, " + ", ".join(f"{own(k, d, e)} AS {k}{d}" for k, d, e in first) + ", " + _each(m, "NULL::VARCHAR AS lp{d}, NULL::VARCHAR AS rp{d}") + " FROM p"
    out = [f"p AS MATERIALIZED ({source})", f"s0 AS MATERIALIZED ({root_})"]
    spread = _each(m, "mx{d} - mn{d}")
    widest = "CASE " + " ".join(f"WHEN mx{d} - mn{d} = greatest({spread}) THEN {d}" for d in range(m)) + " END"
    pick = lambda t: "CASE d " + " ".join(f"WHEN {d} THEN {t.format(d=d)}" for d in range(m)) + " END"
    for k in range(levels):
        out.append(f"a{k} AS (SELECT *, CASE WHEN n < {leafsize} OR greatest({spread}) = 0 THEN NULL ELSE {widest} END AS d FROM s{k})")
        out.append(f"b{k} AS (SELECT *, {pick('c{d}')} AS x, ({pick('mn{d}')} + {pick('mx{d}')}) / 2::DOUBLE AS mid FROM a{k})")
        out.append(f"r{k} AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY x, point_id) AS rk, count(*) FILTER (x <= mid) OVER (PARTITION BY path) AS cnt FROM b{k})")
        kk = "CASE WHEN cnt = 0 THEN 1 WHEN cnt = n THEN n - 1 ELSE cnt END" if sliding else "(n + 1) // 2"
        out.append(f"k{k} AS (SELECT *, {kk} AS kk FROM r{k})")
        s = "max(CASE WHEN rk = kk THEN x END) OVER (PARTITION BY path)"
        s = f"CASE WHEN cnt = 0 OR cnt = n THEN {s} ELSE mid END" if sliding else s
        out.append(f"t{k} AS MATERIALIZED (SELECT *, {s} AS s, rk <= kk AS lo FROM k{k})")
        new = ", ".join(
            f"CASE WHEN d = {d} AND NOT lo THEN s ELSE mn{d} END AS mn{d}, CASE WHEN d = {d} AND lo THEN s ELSE mx{d} END AS mx{d}, CASE WHEN d = {d} AND NOT lo THEN s ELSE le{d} END AS le{d}, CASE WHEN d = {d} AND lo THEN s ELSE re{d} END AS re{d}, "
            f"CASE WHEN d = {d} AND NOT lo THEN false ELSE pl{d} END AS pl{d}, CASE WHEN d = {d} AND lo THEN false ELSE pr{d} END AS pr{d}, CASE WHEN d = {d} AND NOT lo THEN path ELSE lp{d} END AS lp{d}, CASE WHEN d = {d} AND lo THEN path ELSE rp{d} END AS rp{d}"
            for d in range(m)
        )
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT point_id, {_each(m, 'c{d}')}, CASE WHEN d IS NULL THEN path WHEN lo THEN path || '0' ELSE path || '1' END AS path, CASE WHEN d IS NULL THEN n WHEN lo THEN kk ELSE n - kk END AS n, {new} FROM t{k})")
    state = _each(m, "any_value(le{d}) AS le{d}, any_value(re{d}) AS re{d}, any_value(pl{d}) AS pl{d}, any_value(pr{d}) AS pr{d}, any_value(lp{d}) AS lp{d}, any_value(rp{d}) AS rp{d}")
    out.append(f"pts AS (SELECT * FROM s{levels})")
    out.append("nodes AS (" + " UNION ALL ".join(f"SELECT path, any_value(d) AS d, any_value(s) AS s, any_value(n) AS n FROM t{k} WHERE d IS NOT NULL GROUP BY path" for k in range(levels)) + ")")
    out.append(f"g AS (SELECT path, any_value(n) AS npts, {state} FROM pts GROUP BY path)")
    out.append("leaves AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY path) - 1)::INTEGER AS leaf_id, (sum(npts) OVER (ORDER BY path) - npts)::BIGINT AS start_idx, * FROM g)")
    return "WITH " + ",\n".join(out)


def _box(m: int) -> str:
    return _each(m, "le{d}, re{d}")


def _leaves(m: int) -> str:
    return f"SELECT leaf_id, path, npts::BIGINT AS npts, start_idx, (start_idx + npts)::BIGINT AS stop_idx, {_box(m)}, {_each(m, 'pl{d}, pr{d}')} FROM leaves"


def _touch(m: int, skip: int) -> str:
    return " AND ".join(["true", *(f"a.le{e} <= b.re{e} AND a.re{e} >= b.le{e}" for e in range(m) if e != skip)])


def _adjacent(m: int, periodic: list[bool], boxes: str = "leaves", key: str = "leaf_id") -> str:
    """CTE body: lo, dim, hi."""
    parts = []
    for d in range(m):
        parts.append(f"SELECT a.{key} AS lo, {d} AS dim, b.{key} AS hi FROM {boxes} a JOIN {boxes} b ON a.lp{d} = b.rp{d} AND {_touch(m, d)}")
        if periodic[d] and m > 1:
            rest = [e for e in range(m) if e != d]
            ok = " AND ".join(f"NOT (a.le{e} >= b.re{e} AND NOT (a.pr{e} AND b.pl{e})) AND NOT (a.re{e} <= b.le{e} AND NOT (b.pr{e} AND a.pl{e}))" for e in rest)
            esc = " + ".join(f"(a.le{e} >= b.re{e})::INT + (a.re{e} <= b.le{e})::INT" for e in rest)
            parts.append(f"SELECT a.{key}, {d}, b.{key} FROM {boxes} a JOIN {boxes} b ON a.{key} <= b.{key} AND a.pl{d} AND b.pr{d} AND {ok} AND {esc} < {m - 1}")
    return " UNION ALL ".join(parts)


def _sides(adj: str) -> str:
    return f",\nadj AS ({adj}),\nnb AS (SELECT lo AS leaf_id, dim, 'left' AS side, hi AS neighbor_id FROM adj UNION SELECT hi, dim, 'right', lo FROM adj)\n"


K = "((point_id % 5)::DOUBLE - 1::DOUBLE)"
Q = f"q AS (SELECT point_id, c0 * ({K} / 2::DOUBLE + 0.5::DOUBLE) AS x, c1 + {K} * 50::DOUBLE AS y FROM p)"
WRAP = "CASE WHEN CASE WHEN {c} < {l} THEN {r} - (({r} - {c}) % ({r} - {l})) ELSE {l} + (({c} - {l}) % ({r} - {l})) END >= {r} THEN {l} WHEN {c} < {l} THEN {r} - (({r} - {c}) % ({r} - {l})) ELSE {l} + (({c} - {l}) % ({r} - {l})) END"


def _wrap(c: str, lo: str, hi: str) -> str:
    return WRAP.format(c=c, l=lo, r=hi)


def _located(pos: str = "q") -> str:
    return f"SELECT {pos}.point_id, leaf_id FROM {pos} JOIN leaves ON x >= le0 AND x < re0 AND y >= le1 AND y < re1"


def _split(sliding: bool, mins: list[float] | None = None, maxs: list[float] | None = None) -> str:
    src, m = POINTS["part"]
    lo = [f"{mins[d]}::DOUBLE" if mins else f"(SELECT min(c{d}) FROM p)" for d in range(m)]
    hi = [f"{maxs[d]}::DOUBLE" if maxs else f"(SELECT max(c{d}) FROM p)" for d in range(m)]
    dim = f"CASE WHEN {hi[0]} - {lo[0]} >= {hi[1]} - {lo[1]} THEN 0 ELSE 1 END"
    k = "CASE WHEN cnt = 0 THEN 1 WHEN cnt = n THEN n - 1 ELSE cnt END" if sliding else "(n + 1) // 2"
    val = "CASE WHEN cnt = 0 OR cnt = n THEN x ELSE mid END" if sliding else "x"
    return f"""WITH p AS ({src}), d AS (SELECT {dim} AS dim), v AS (SELECT *, CASE dim WHEN 0 THEN c0 ELSE c1 END AS x, CASE dim WHEN 0 THEN ({lo[0]} + {hi[0]}) / 2 ELSE ({lo[1]} + {hi[1]}) / 2 END AS mid FROM p, d),
r AS (SELECT *, row_number() OVER (ORDER BY x, point_id) AS rk, count(*) OVER () AS n, count(*) FILTER (x <= mid) OVER () AS cnt FROM v)
SELECT ({k} - 1)::BIGINT AS q, dim::INTEGER AS split_dim, {val} AS split_val FROM r WHERE rk = {k}"""


def _blocks(size: int = 7) -> str:
    return f"WITH p AS ({POINTS['orders'][0]}), bl AS (SELECT *, (ntile({size}) OVER (ORDER BY point_id) - 1)::INTEGER AS block FROM p)"


def _pivot() -> str:
    out = [f"p AS ({POINTS['customer'][0]})", "s0 AS (SELECT point_id, c0 AS value, row_number() OVER (ORDER BY point_id) - 1 AS pos FROM p)"]
    for k in range(8):
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT point_id, value, grp AS pos FROM (SELECT *, pos // 5 AS grp, row_number() OVER (PARTITION BY pos // 5 ORDER BY value, point_id) AS r, count(*) OVER (PARTITION BY pos // 5) AS n FROM s{k}) WHERE r = (n + 1) // 2)")
    return "WITH " + ",\n".join(out) + " SELECT (SELECT count(*) FROM p WHERE c0 < value OR (c0 = value AND p.point_id < s8.point_id))::BIGINT AS q, value, point_id FROM s8"


ROUNDS = """WITH RECURSIVE w(worker, me, size, r) AS (SELECT i::INTEGER, i, 13::BIGINT, 0 FROM range(13) t(i) UNION ALL
SELECT worker, CASE WHEN me < size - size // 2 THEN me ELSE me - (size - size // 2) END, CASE WHEN me < size - size // 2 THEN size - size // 2 ELSE size // 2 END, r + 1 FROM w WHERE me > 0)
SELECT worker, (ceil(log2(13)) + 1)::INTEGER AS n_rounds, max(r)::INTEGER AS first_round FROM w GROUP BY worker"""


def oracle_sql() -> dict[str, str]:
    orders, wrapped = tree("orders", "500", 10), tree("orders", "500", 10, True)
    events, events_wrap = tree("events", "400", 9), tree("events", "400", 9, [True, True, False])
    part, slide = tree("part", "60", 10), tree("part", "60", 14, sliding=True)
    customer = tree("customer", "((SELECT count(*) FROM p) // 16 + 1)", 6)
    kd = tree("events", "2", 3, True)
    kd_plain = tree("events", "2", 3)
    bits = "((substr(path, 1, 1)::INTEGER * 4) + (substr(path, 2, 1)::INTEGER * 2) + substr(path, 3, 1)::INTEGER)::INTEGER"
    member = "m AS (SELECT point_id, c0, c1, leaf_id, (row_number() OVER (ORDER BY pts.path, point_id) - 1)::BIGINT AS idx_pos FROM pts JOIN leaves USING (path))"
    top = "WITH p AS ({0}), r AS (SELECT *, row_number() OVER (ORDER BY {1}, point_id) AS rk, count(*) OVER () AS n FROM p)"
    by_part = lambda c: top.format(POINTS["part"][0], c)
    arg = lambda o: f"WITH p AS ({POINTS['customer'][0]}) SELECT point_id AS pos, c0 AS value FROM p WHERE point_id BETWEEN 20 AND 120 ORDER BY c0 {o}, point_id LIMIT 1"
    ev, m3 = POINTS["events"]
    dom = ", dom AS (SELECT min(c0) AS l0, max(c0) AS r0, min(c1) AS l1, max(c1) AS r1 FROM p)"
    qw = f", qw AS (SELECT point_id, {_wrap('x', 'l0', 'r0')} AS x, {_wrap('y', 'l1', 'r1')} AS y FROM q, dom)"
    sides = (("le0", "le1", "re0", "le1"), ("re0", "le1", "re0", "re1"), ("le0", "re1", "re0", "re1"), ("le0", "le1", "le0", "re1"))
    seg = " UNION ALL ".join(f"SELECT leaf_id, {i}::INTEGER AS seg, {a} AS x0, {b} AS y0, {c} AS x1, {d} AS y1 FROM leaves" for i, (a, b, c, d) in enumerate(sides))
    asked = "(0, 100::DOUBLE, 50::DOUBLE), (1, 250.5::DOUBLE, 100.25::DOUBLE), (2, 42::DOUBLE, 7::DOUBLE), (3, -1::DOUBLE, 50::DOUBLE), (4, 100::DOUBLE, 1e9::DOUBLE), (5, 100::DOUBLE, NULL::DOUBLE)"
    stored = f"{part}, w AS (SELECT pts.point_id, l.leaf_id AS stored, h.leaf_id AS found FROM pts JOIN leaves l USING (path) LEFT JOIN leaves h ON c0 >= h.le0 AND c0 < h.re0 AND c1 >= h.le1 AND c1 < h.re1) SELECT count(*) FILTER (found IS NULL) AS outside, count(*) FILTER (found <> stored) AS moved FROM w"
    depth = "length(path)::INTEGER AS depth"
    begin = "(SELECT min(start_idx) FROM leaves l WHERE starts_with(l.path, nodes.path))::BIGINT AS start_idx"
    top4 = "(CASE WHEN n0 <= 4000 THEN '' WHEN n0 <= 8000 THEN substr(path, 1, 1) WHEN n0 <= 16000 THEN substr(path, 1, 2) WHEN n0 <= 32000 THEN substr(path, 1, 3) WHEN n0 <= 64000 THEN substr(path, 1, 4) WHEN n0 <= 128000 THEN substr(path, 1, 5) ELSE substr(path, 1, 6) END)"
    return {
        "tree_leaves_2d": f"{orders} {_leaves(2)}",
        "tree_leaves_3d": f"{events} {_leaves(3)}",
        "tree_leaves_4d": f"{tree('vectors', '20', 9)} {_leaves(4)}",
        "tree_leaves_midpoint": f"{slide} {_leaves(2)}",
        "tree_nleaves": f"{customer} {_leaves(2)}",
        "tree_nodes": f"{orders} SELECT path, {depth}, d::INTEGER AS split_dim, s AS split_val, n::BIGINT AS npts, {begin} FROM nodes",
        "tree_membership": f"{orders}, {member} SELECT point_id, leaf_id, idx_pos FROM m",
        "tree_edges": f"{orders} " + " UNION ALL ".join(f"SELECT leaf_id, {d}::INTEGER AS dim, le{d} AS left_edge, re{d} AS right_edge FROM leaves" for d in range(2)),
        "subtree_bounds": f"{orders}, t AS (SELECT *, {top4} AS subtree FROM leaves, (SELECT count(*) AS n0 FROM p)) SELECT subtree, sum(npts)::BIGINT AS npts, count(*) AS num_leaves, min(le0) AS le0, max(re0) AS re0, min(le1) AS le1, max(re1) AS re1 FROM t GROUP BY subtree",
        "leaf_points": f"{orders}, {member} SELECT point_id, c0, c1, idx_pos FROM m WHERE leaf_id = 3",
        "leaf_idx": f"{orders}, {member} SELECT point_id FROM m WHERE leaf_id = 2",
        "leaf_slice": f"{orders}, {member} SELECT idx_pos, point_id FROM m WHERE idx_pos >= 1000 AND idx_pos < 2500",
        "pts_bounds": f"WITH p AS ({ev}) SELECT count(*) AS n, {_each(m3, 'min(c{d}) AS min_{d}, max(c{d}) AS max_{d}, max(c{d}) - min(c{d}) AS width_{d}')} FROM p",
        "argmax_slice": arg("DESC"),
        "argmin_slice": arg("ASC"),
        "order_dim": f"{by_part('c1')} SELECT point_id, c1 AS value, (rk - 1)::BIGINT AS rank FROM r",
        "pivot_groups5": _pivot(),
        "partition_element": f"{by_part('c0')}, v AS (SELECT rk AS k FROM r WHERE point_id = 77) SELECT point_id, sign(rk - k)::INTEGER AS side, (k - 1)::BIGINT AS q FROM r, v",
        "partition_value": f"WITH p AS ({POINTS['part'][0]}) SELECT point_id, c1 <= 950::DOUBLE AS less, (SELECT count(*) - 1 FROM p WHERE c1 <= 950::DOUBLE)::BIGINT AS q FROM p",
        "select_t": f"{by_part('c0')} SELECT point_id, c0 AS value FROM r WHERE rk <= 123",
        "split_median": _split(False),
        "split_midpoint": _split(True),
        "split_slide_min": _split(True, [-1e5, 0.0], [10.0, 1.0]),
        "split_slide_max": _split(True, [0.0, 0.0], [1e5, 1.0]),
        "wrap_positions": f"WITH p AS ({POINTS['orders'][0]}), {Q} SELECT point_id, {_wrap('x', '10::DOUBLE', '200::DOUBLE')} AS wx, {_wrap('y', '(-20)::DOUBLE', '120::DOUBLE')} AS wy FROM q",
        "locate_batch": f"{orders}, {Q} {_located()}",
        "locate_by_box": f"{orders}, {Q} {_located()}",
        "locate_periodic": f"{wrapped}, {Q}{dom}{qw} {_located('qw')}",
        "locate_outside": f"WITH p AS ({POINTS['orders'][0]}), {Q}{dom} SELECT point_id FROM q, dom WHERE NOT (x >= l0 AND x < r0 AND y >= l1 AND y < r1)",
        "stored_vs_located": stored,
        "neighbors_2d": f"{orders}{_sides(_adjacent(2, [False] * 2))} SELECT * FROM nb",
        "neighbors_midpoint": f"{slide}{_sides(_adjacent(2, [False] * 2))} SELECT * FROM nb",
        "neighbors_periodic_2d": f"{wrapped}{_sides(_adjacent(2, [True] * 2))} SELECT * FROM nb",
        "neighbors_periodic_3d": f"{events_wrap}{_sides(_adjacent(3, [True, True, False]))} SELECT * FROM nb",
        "all_neighbors": f"{wrapped}{_sides(_adjacent(2, [True] * 2))} SELECT DISTINCT leaf_id, neighbor_id FROM nb",
        "neighbor_lists": f"{slide}{_sides(_adjacent(2, [False] * 2))}, u AS (SELECT DISTINCT leaf_id, neighbor_id FROM nb) SELECT leaves.leaf_id, coalesce(string_agg(neighbor_id::VARCHAR, ',' ORDER BY neighbor_id), '') AS neighbors FROM leaves LEFT JOIN u USING (leaf_id) GROUP BY leaves.leaf_id",
        "neighbor_ids_of_positions": f"{orders}{_sides(_adjacent(2, [False] * 2))}, {Q}, here AS ({_located()}) SELECT DISTINCT point_id, neighbor_id FROM here JOIN nb USING (leaf_id)",
        "box_overlap": f"{part} SELECT a.leaf_id, b.leaf_id AS other_id FROM leaves a JOIN leaves b ON a.leaf_id < b.leaf_id AND {_touch(2, -1)}",
        "distribute_blocks": f"{_blocks()} SELECT point_id, block FROM bl",
        "pivot_of_blocks": f"{_blocks()}, md AS (SELECT block, quantile_disc(c0, 0.5) AS m FROM bl GROUP BY block) SELECT quantile_disc(m, 0.5) AS pivot FROM md",
        "select_by_block": f"{_blocks()}, r AS (SELECT *, row_number() OVER (ORDER BY c1, point_id) AS rk FROM bl) SELECT block, (count(*) FILTER (rk <= 1234) - 1)::BIGINT AS q, (SELECT c1 FROM r WHERE rk = 1234) AS pivot FROM r GROUP BY block",
        "split_by_block": f"{_blocks()}, w AS (SELECT CASE WHEN max(c0) - min(c0) >= max(c1) - min(c1) THEN 0 ELSE 1 END AS dim, (count(*) + 1) // 2 AS k FROM bl), r AS (SELECT *, CASE dim WHEN 0 THEN c0 ELSE c1 END AS x, row_number() OVER (ORDER BY CASE dim WHEN 0 THEN c0 ELSE c1 END, point_id) AS rk FROM bl, w) SELECT block, (count(*) FILTER (rk <= k) - 1)::BIGINT AS q, any_value(dim)::INTEGER AS split_dim, (SELECT x FROM r WHERE rk = k) AS split_val FROM r GROUP BY block",
        "redistribute_sides": f"WITH p AS ({POINTS['orders'][0]}), w AS (SELECT CASE WHEN max(c0) - min(c0) >= max(c1) - min(c1) THEN 0 ELSE 1 END AS dim, (count(*) + 1) // 2 AS k FROM p), r AS (SELECT point_id, CASE WHEN row_number() OVER (ORDER BY CASE dim WHEN 0 THEN c0 ELSE c1 END, point_id) <= k THEN 0 ELSE 1 END AS side FROM p, w) SELECT point_id, 0::INTEGER AS side, (ntile(3) OVER (ORDER BY point_id) - 1)::INTEGER AS target FROM r WHERE side = 0 UNION ALL SELECT point_id, 1, (ntile(2) OVER (ORDER BY point_id) + 2)::INTEGER FROM r WHERE side = 1",
        "split_rounds": ROUNDS,
        "kd_distribute": f"{kd_plain} SELECT point_id, {bits} AS worker FROM pts",
        "kd_regions": f"{kd} SELECT {bits} AS worker, npts::BIGINT AS npts, {_box(3)}, {_each(3, 'pl{d}, pr{d}')} FROM leaves",
        "subtree_adjacency": f"{kd_plain}{_sides(_adjacent(3, [False] * 3))} SELECT * FROM nb",
        "save_load_roundtrip": f"{customer} {_leaves(2)}",
        "save_load_membership": f"{customer}, {member} SELECT point_id, leaf_id, idx_pos FROM m",
        "consolidated_tree": f"{customer}{_sides(_adjacent(2, [False] * 2))}, {member}, u AS (SELECT DISTINCT leaf_id, neighbor_id FROM nb), s AS (SELECT leaf_id, string_agg(neighbor_id::VARCHAR, ',' ORDER BY neighbor_id) AS neighbors FROM u GROUP BY leaf_id), i AS (SELECT leaf_id, min(point_id) AS first_id, max(point_id) AS last_id, sum(point_id)::BIGINT AS sum_ids FROM m GROUP BY leaf_id) SELECT leaf_id, npts::BIGINT AS npts, start_idx, (start_idx + npts)::BIGINT AS stop_idx, first_id, last_id, sum_ids, coalesce(neighbors, '') AS neighbors FROM leaves JOIN i USING (leaf_id) LEFT JOIN s USING (leaf_id)",
        "get_position": f"{orders}, a(k, x, y) AS (VALUES {asked}) SELECT k::INTEGER AS k, leaf_id, npts::BIGINT AS npts, CASE WHEN leaf_id IS NOT NULL THEN true END AS same_locally, CASE WHEN y IS NULL THEN 'AssertionError' WHEN leaf_id IS NULL THEN 'ValueError' END AS error FROM a LEFT JOIN leaves ON x >= le0 AND x < re0 AND y >= le1 AND y < re1",
        "make_tree_nproc": f"{orders} {_leaves(2)}",
        "tree_partial_domain": f"{tree('part', '60', 11, root={'mn': [0.0, 800.0], 'mx': [1200.0, 2200.0], 'le': [-50.0, 700.0], 're': [1300.0, 2500.0], 'pl': [True, False], 'pr': [False, True]})} {_leaves(2)}",
        "tree_equality": "SELECT * FROM (VALUES ('other subtrees', true, ''), ('other subtrees', false, ''), ('other flags', true, 'periodic,leaves'), ('other flags', false, 'periodic,leaves')) t(pair, strict, differences)",
        "tree_errors": "SELECT * FROM (VALUES ('leafsize below 2', 'ValueError'), ('edges of another length', 'ValueError'), ('flags of another length', 'ValueError'), ('no points', 'ValueError'), ('null coordinate', 'ValueError'), ('leaf out of range', 'IndexError'), ('rank out of range', 'IndexError'), ('split rank out of range', 'ValueError'), ('version of another tree', 'OSError'), ('too large for one place', 'ValueError')) t(what, error)",
        "tree_repr": f"{orders} SELECT 'TreeModel(' || sum(npts)::BIGINT || ' points, 2 dimensions, ' || count(*) || ' leaves)' AS text FROM leaves",
        "leaf_labels": f"{orders}, t AS (SELECT *, {top4} AS subtree FROM leaves, (SELECT count(*) AS n0 FROM p)) " + " UNION ALL ".join(f"SELECT leaf_id, subtree AS label, {i}::INTEGER AS seg, {a} AS x0, {b} AS y0, {c} AS x1, {d} AS y1 FROM t" for i, (a, b, c, d) in enumerate(sides)),
        "leaf_segments": f"{customer} {seg}",
    }
