"""Approximate nearest neighbours: one navigable small-world hierarchy per shard.

Equal vectors are one node that carries its ``k + 1`` smallest ids (no query needs
more), so a vector shared by a third of all rows is one node. Nodes are dealt to
shards by hash; a shard's graph is built and stored as flat neighbour arrays, one
per layer. Queries visit every shard and the shards' results are merged.

Nearness is the inner product. For the graph, vectors get one more component that
gives all of them the shard's largest length, which makes inner products and
distances agree; scores are inner products of the original vectors in double
precision. Insertion and search advance many vectors in step: each round takes the
best unvisited candidates of every search, so the arithmetic is on whole arrays.

Defined results
    vectors that are null, zero, or hold null or non-finite components take no
    part, neither as queries nor as candidates; nor do null ids or vectors whose
    length differs from the table's most common one.
    repeated ids count once per distinct vector, and never match their own id.
    fewer candidates than ``k``: all of them. No rows or no queries: no rows.
    vectors of any length; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwood.llm.common import stash

LINKS, BUILD_WIDTH, SEARCH_WIDTH, STEP = 16, 64, 96, 4
#: Bytes of vectors (8 a component) in a shard and in a block of queries: an index
#: is one cell of about twice that, far from a cell's 2 GB.
SHARD_BYTES, LEAST_SHARDS, QUERY_BYTES = 64 << 20, 8, 8 << 20


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` (doubles) of the rows that take part."""
    d = df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return d.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and similarities found for each query, best first (-1 where none).
    ``graph``: neighbours by node, padded with -1; ``entry``: start nodes by query."""
    m, n = len(queries), len(x)
    ids = np.full((m, width), -1, np.int64)
    sims = np.full((m, width), -np.inf, np.float32)
    done = np.ones((m, width), bool)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    rows = np.arange(m)[:, None]
    e = entry[:, :width]
    ids[:, : e.shape[1]] = e
    sims[:, : e.shape[1]] = np.where(e >= 0, np.einsum("md,mkd->mk", queries, x[np.maximum(e, 0)]), -np.inf)
    done[:, : e.shape[1]] = e < 0
    seen[rows, np.where(e >= 0, e, n)] = True
    active = np.arange(m)
    while len(active):
        open_ = np.where(done[active], -np.inf, sims[active])
        pick = np.argpartition(-open_, min(STEP, width - 1), axis=1)[:, :STEP] if width > STEP else np.argsort(-open_, axis=1)
        good = np.take_along_axis(open_, pick, 1) > -np.inf
        keep = good.any(1)
        active, pick, good = active[keep], pick[keep], good[keep]
        if not len(active):
            break
        chosen = np.where(good, ids[active[:, None], pick], -1)
        d = done[active]
        np.put_along_axis(d, pick, True, 1)
        done[active] = d
        near = np.where(chosen[:, :, None] >= 0, graph[np.maximum(chosen, 0)], -1).reshape(len(active), -1)
        near = np.sort(np.where(near >= 0, near, n), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near = np.where(seen[active[:, None], near], n, near)
        seen[active[:, None], near] = True
        fresh = near < n
        s = np.where(fresh, np.einsum("md,mkd->mk", queries[active], x[np.where(fresh, near, 0)]), -np.inf).astype(np.float32)
        all_ids, all_sims = np.hstack([ids[active], np.where(fresh, near, -1)]), np.hstack([sims[active], s])
        all_done = np.hstack([done[active], ~fresh])
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[active], sims[active], done[active] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _layer(x: np.ndarray, width: int, degree: int) -> np.ndarray:
    """A navigable graph over ``x``: batches are searched in the graph so far and
    linked both ways, each node keeping its nearest ``degree``."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    have = 0
    while have < n:
        size = min(n - have, max(512, have // 2), 4096)
        new = np.arange(have, have + size)
        for a in range(0, size, 512):
            part = new[a : a + 512]
            own = x[part] @ x[new].T
            own[np.arange(len(part)), part - have] = -np.inf
            k = min(degree, size - 1)
            ids, sims = np.zeros((len(part), 0), np.int64), np.zeros((len(part), 0), np.float32)
            if k > 0:
                top = np.argpartition(-own, k - 1, axis=1)[:, :k]
                ids, sims = new[top], np.take_along_axis(own, top, 1)
            if have:
                starts = np.linspace(0, have - 1, min(have, 8)).astype(np.int64)
                old, old_sims = search(x[:have], graph[:have], x[part], np.tile(starts, (len(part), 1)), width)
                ids, sims = np.hstack([ids, old]), np.hstack([sims, old_sims])
            if not ids.shape[1]:
                continue
            best = np.argsort(-np.where(ids >= 0, sims, -np.inf), axis=1, kind="stable")[:, : degree // 2]
            graph[part, : best.shape[1]] = np.take_along_axis(ids, best, 1)
        _back_links(x, graph, new)
        have += size
    return graph


def _back_links(x: np.ndarray, graph: np.ndarray, new: np.ndarray) -> None:
    """Links from the neighbours of ``new`` back to them; full nodes keep the nearest."""
    degree = graph.shape[1]
    src, dst = np.repeat(new, degree), graph[new].reshape(-1)
    src, dst = src[dst >= 0], dst[dst >= 0]
    touched = np.unique(dst)
    old = graph[touched]
    pair_a = np.concatenate([np.repeat(touched, degree)[old.reshape(-1) >= 0], dst])
    pair_b = np.concatenate([old.reshape(-1)[old.reshape(-1) >= 0], src])
    code = np.unique(pair_a * len(x) + pair_b)
    pair_a, pair_b = code // len(x), code % len(x)
    sim = np.concatenate([np.einsum("nd,nd->n", x[pair_a[i : i + 65536]], x[pair_b[i : i + 65536]]) for i in range(0, len(pair_a), 65536)]) if len(pair_a) else np.zeros(0)
    order = np.lexsort((-sim, pair_a))
    pair_a, pair_b = pair_a[order], pair_b[order]
    first = np.concatenate([[True], pair_a[1:] != pair_a[:-1]])
    rank = np.arange(len(pair_a)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    keep = rank < degree
    graph[touched] = -1
    graph[pair_a[keep], rank[keep]] = pair_b[keep]


def build(v: np.ndarray) -> dict:
    """Index of one shard: scaled vectors and, from the top layer down, its nodes
    and flat neighbour array."""
    lengths = np.sqrt((v * v).sum(1))
    x = np.hstack([v, np.sqrt(np.maximum(lengths.max() ** 2 - lengths**2, 0))[:, None]]).astype(np.float32)
    order = np.random.Generator(np.random.PCG64(13)).permutation(len(x))
    layers, size = [], len(x)
    while True:
        nodes = order[:size]
        layers.append((nodes.astype(np.int32), _layer(x[nodes], BUILD_WIDTH, 2 * LINKS).astype(np.int32)))
        if size <= 4 * LINKS:
            break
        size //= LINKS
    return {"x": x, "layers": layers[::-1]}


def find(index: dict, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
    """Up to ``width`` nodes for each query, nearest first, -1 where none."""
    x = index["x"]
    q = np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32)
    entry = None
    for nodes, graph in index["layers"]:
        nodes, graph = nodes.astype(np.int64), graph.astype(np.int64)
        last = len(nodes) == len(x)
        if entry is None:
            start = np.tile(np.arange(min(len(nodes), 8)), (len(q), 1))
        else:
            place = np.full(len(x), -1, np.int64)
            place[nodes] = np.arange(len(nodes))
            start = np.where(entry >= 0, place[np.maximum(entry, 0)], -1)
        got, _ = search(x[nodes], graph, q, start, min(width if last else 8, max(len(nodes), 2)))
        entry = np.where(got >= 0, nodes[np.maximum(got, 0)], -1)
    return entry


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found."""
    good = usable(vectors, id_col, vec_col)
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 0
    good = good.filter(F.size("v") == dim)
    first = good.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    nodes = stash(first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "nodes")
    n = nodes.count()
    asked = stash(usable(queries, id_col, vec_col).filter(F.size("v") == dim).distinct(), "asked")
    shards, blocks = max(LEAST_SHARDS, -(-n * dim * 8 // SHARD_BYTES)), max(1, -(-asked.count() * dim * 8 // QUERY_BYTES))

    def make(t: pa.Table) -> pa.Table:
        v = np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)
        ids = t.column("ids").to_pylist()
        return pa.table({"shard": t.column("shard").slice(0, 1), "index": pa.array([pickle.dumps((v, ids, build(v)))], pa.binary())})

    shard = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard")
    index = stash(nodes.select(shard, "v", "ids").groupBy("shard").applyInArrow(make, "shard int, index binary"), "index")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = index.select("shard", every.alias("part"), "index")
    right = asked.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "v").select("shard", "part", "id", "v")

    def ask(a: pa.Table, b: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if a.num_rows and b.num_rows:
            v, ids, built = pickle.loads(a.column("index")[0].as_buffer())
            q_ids = b.column("id").to_numpy()
            q_all = np.array(b.column("v").combine_chunks().flatten()).reshape(b.num_rows, -1)
            for at in range(0, len(q_ids), 256):
                q = q_all[at : at + 256]
                got = find(built, q)
                for i, row in enumerate(got):
                    row = row[row >= 0]
                    s = (v[row] * q[i]).sum(1)
                    best = sorted((-float(y), j) for x, y in zip(row, s, strict=True) for j in ids[x] if j != q_ids[at + i])[:k]
                    out_q += [q_ids[at + i]] * len(best)
                    out_v += [j for _, j in best]
                    out_s += [-y for y, _ in best]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(ask, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
