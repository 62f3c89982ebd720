"""Near-duplicate detection: MinHash with tensored banding, links confirmed.

Two collections of ``TABLES`` hash values are made for each set, each value from
``ROWS`` minhashes. A table key joins one value of the first collection with one
of the second, so 2 * 10 values (60 minhashes) give 100 tables of six-minhash
keys: a pair is missed only if a whole collection disagrees, which at similarity
0.85 is (1 - 0.85**3)**10 = 7e-5 for each collection.

Texts with equal sets are one class, found first by a group-by with partial sums,
so thousands of copies are one row from then on. Classes that share a key are
joined to the key's smallest class; the components of these edges are candidate
clusters, and a class's whole set goes to its cluster once. There links are
confirmed exactly, skipping pairs that are already connected. Clusters of more
than ``GRID`` classes are cut into parts, with the smallest class in each; only
the classes that are outside the cluster's largest component after that go on to
meet every part. Confirmed links are joined up by a second components pass.

Defined results
    null, empty or wordless text: 0 shingles, linked with nothing, kept.
    fewer words than a shingle: the whole sequence is the one shingle.
    repeated rows and repeated ids: each row gets its own result row.
    a null ``doc_id`` never is a component's smallest id unless it has no other;
    such a row has a null component and is kept only then.
    extra columns are ignored. Shingles are compared as 64-bit fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwood.llm import blocks as B
from boxwood.llm.common import row_key, sized, small_batches, stash
from boxwood.llm.components import connected, with_least

ROWS, TABLES, GRID, MOST_TABLES = 3, 10, 400, 16
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, (2 * MOST_TABLES * ROWS, 2), dtype=np.uint64) * B.U64(2) + B.U64(1)
#: Text hashed at a time (or one document).
CHUNK_BYTES = 1 << 20


def shingle_sets(lengths: np.ndarray, data: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints, by document, and where each document's begin
    (one more entry than documents)."""
    n = len(lengths)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    data = B.lower_bytes(data)
    starts, ends, doc = B.words_of(data, offsets)
    hashes = B.word_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    h = B.rolling(hashes, words)
    fits = np.flatnonzero(doc[: len(h)] == doc[words - 1 :]) if len(h) else np.zeros(0, np.int64)
    of, values = [doc[fits]], [h[fits]]
    for k in range(1, words):
        few = np.flatnonzero(count == k)
        if len(few):
            of.append(few)
            values.append(B.rolling(hashes, k)[first[few]] + B.U64(k))
    of_, values_ = np.concatenate(of), np.concatenate(values)
    order = np.lexsort((values_, of_))
    of_, values_ = of_[order], values_[order]
    new = np.ones(len(of_), bool)
    new[1:] = (of_[1:] != of_[:-1]) | (values_[1:] != values_[:-1])
    return values_[new], np.concatenate([[0], np.cumsum(np.bincount(of_[new], minlength=n))]).astype(np.int64)


def _class_of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    a = np.add.reduceat(B.mix(values ^ B.U64(0x5BF03635D1BD2AE7)), at)
    b = np.add.reduceat(B.mix(values ^ B.U64(0xA24BAED4963EE407)), at)
    return B.mix(a + B.mix(b)).view(np.int64)


def _chunks(batch: pa.RecordBatch):
    lengths, data = B.arrow_bytes(batch.column(1))
    ends, i = np.cumsum(lengths), 0
    while i < len(lengths):
        start = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, start + CHUNK_BYTES, "right")))
        yield batch.column(0).slice(i, j - i), lengths[i:j], data[start : ends[j - 1]]
        i = j


def signatures(docs: DataFrame, words: int, tables: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, k, cls, n, a, b``: row key, class, set size, the two collections."""

    def run(batches):
        B.lean()
        for batch in batches:
            at0 = 0
            for ids, lengths, data in _chunks(batch):
                values, at = shingle_sets(lengths, data, words)
                n = np.diff(at)
                some = np.flatnonzero(n)
                cls, sigs = np.zeros(len(n), np.int64), np.zeros((len(n), 2 * tables), np.int64)
                if len(some):
                    begin = at[:-1][some]
                    cls[some] = _class_of(values, begin)
                    for t in range(2 * tables):
                        v = np.full(len(some), B.U64(t + 1))
                        for r in range(ROWS):
                            a, b = _SEEDS[t * ROWS + r]
                            v = B.mix(v * B.U64(0x9E3779B97F4A7C15) + np.minimum.reduceat((values ^ b) * a, begin))
                        sigs[some, t] = v.view(np.int64)
                half = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), tables).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(at0, len(ids)), pa.array(cls, mask=n == 0), pa.array(n.astype(np.int64)), half(np.ascontiguousarray(sigs[:, :tables])), half(np.ascontiguousarray(sigs[:, tables:]))], ["doc_id", "k", "cls", "n", "a", "b"])
                at0 += len(ids)

    return stash(small_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), row_key(id_col, text_col)).mapInArrow(run, "doc_id long, k long, cls long, n long, a array<long>, b array<long>"), "signatures")


def shared_values(classes: DataFrame, tables: int) -> DataFrame:
    """``cls, a, b``: of both collections, the places whose value another class has
    too. A table key can only be shared by classes that share both its values, so
    these few make all the keys that matter."""
    each = classes.select("cls", F.posexplode(F.concat("a", "b")).alias("i", "v"))
    often = stash(each.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("i", "v"), "values")
    mine = each.join(sized(often), ["i", "v"])
    kept = mine.groupBy("cls").agg(F.collect_list(F.struct("i", "v")).alias("x"))
    sides = F.filter("x", lambda y: y["i"] < tables).alias("a"), F.filter("x", lambda y: y["i"] >= tables).alias("b")
    return kept.select("cls", *sides).filter((F.size("a") > 0) & (F.size("b") > 0))


def candidate_edges(classes: DataFrame, tables: int) -> DataFrame:
    """``(a, b)``: each class with the smallest class it shares a table key with. The
    smallest comes from partial sums; a key that very many classes have is a row a
    task there, and split over tasks in the join back."""
    keys = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x["i"], x["v"], y["i"], y["v"]))))
    k = stash(shared_values(classes, tables), "shared").select(F.col("cls").alias("v"), F.explode(keys).alias("u"))
    return with_least(k, "keys").filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def link(names: np.ndarray, sets: list[np.ndarray], num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of links (den * intersection >= num * union) that joins what all
    links among ``sets`` join. Pairs already connected, by the forest so far or by
    equal labels in ``known``, are not compared."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    flag = np.zeros(int(codes.max()) + 1, np.int64)
    order = np.argsort(sizes, kind="stable")
    rank = np.empty(len(sets), np.int64)
    rank[order] = np.arange(len(sets))
    comp, out = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1], []
    for i in order:
        todo = (comp != comp[i]) & (rank > rank[i]) & (num * sizes <= den * sizes[i])
        if not todo.any():
            continue
        flag[codes[at[i] : at[i + 1]]] = 1
        some = np.flatnonzero(todo)
        if len(some) * 4 < len(sets):
            common = np.array([flag[codes[at[j] : at[j + 1]]].sum() for j in some])
        else:
            common = np.add.reduceat(flag[codes], at[:-1])[some]
        flag[codes[at[i] : at[i + 1]]] = 0
        for j in some[den * common >= num * (sizes[some] + sizes[i] - common)]:
            if comp[j] != comp[i]:
                out.append((int(names[i]), int(names[j])))
                comp[comp == comp[j]] = comp[i]
    return out


def _sets_of(docs: DataFrame, members: DataFrame, words: int, id_col: str, text_col: str, more: str = "") -> DataFrame:
    """``members(cls, id, root, parts, ...)`` with ``shingles``: the set of each class,
    packed, made from one of its documents."""
    extra = [f.split()[0] for f in more.split(", ")] if more else []
    source = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).cast("string").alias("text_"))
    wanted = source.join(members, source.id_.eqNullSafe(members.id)).select("id_", "text_", "cls", "root", "parts", *extra)

    def sets(batches):
        B.lean()
        for batch in batches:
            at0 = 0
            for ids, lengths, data in _chunks(batch):
                values, at = shingle_sets(lengths, data, words)
                n = np.diff(at)
                want = batch.column(2).slice(at0, len(ids)).to_numpy()
                some = np.flatnonzero(n)
                own = np.zeros(len(n), np.int64)
                if len(some):
                    own[some] = _class_of(values, at[:-1][some])
                good = np.flatnonzero((n > 0) & (own == want))
                take = pa.array(good + at0)
                kept = [batch.column(c).take(take) for c in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([B.pack_sorted(values[at[i] : at[i + 1]]) for i in good], pa.binary())], ["cls", "root", "parts", *extra, "shingles"])
                at0 += len(ids)

    return wanted.mapInArrow(sets, "cls long, root long, parts int, " + (more + ", " if more else "") + "shingles binary")


def _part(parts: str, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(parts)).cast("int")


def _placed_by_part(shipped: DataFrame) -> DataFrame:
    """``root, i, j, cls, comp, shingles``: each class in its part of the cluster, and
    the root in all parts: one set that most others of a dense cluster link with."""
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    at = F.when(F.col("cls") == F.col("root"), everywhere).otherwise(F.array(_part("parts")))
    return shipped.select("root", F.explode(at).alias("i"), F.lit(0).alias("j"), "cls", F.col("cls").alias("comp"), "shingles")


def _across_parts(large: DataFrame, linked: DataFrame) -> DataFrame:
    """``cls, id, root, parts, comp, part, lane, lanes`` of the classes of clusters of
    several parts. Those outside the cluster's largest component have a lane, some
    ``GRID`` to one; only they can have links that are not found yet."""
    comp = large.join(linked.select(F.col("node").alias("n"), F.col("root").alias("r")), F.col("cls") == F.col("n"), "left").select("cls", "id", "root", "parts", F.coalesce("r", "cls").alias("comp"))
    sizes = comp.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("root").agg(F.max(F.struct("size", "comp")).alias("most"), F.sum("size").alias("all"))
    lanes = most.select("root", F.col("most.comp").alias("main"), F.ceil((F.col("all") - F.col("most.size")) / GRID).cast("int").alias("lanes"))
    lane = F.when(F.col("comp") != F.col("main"), _part("lanes", 1))
    return comp.join(lanes, "root").filter("lanes > 0").select("cls", "id", "root", "parts", "comp", _part("parts").alias("part"), lane.alias("lane"), "lanes")


def _placed_across(shipped: DataFrame) -> DataFrame:
    """Every lane meets every part of its cluster in a cell of its own."""
    as_part = F.transform(F.sequence(F.lit(0), F.col("lanes") - 1), lambda i: F.struct(i.alias("i"), F.col("part").alias("j")))
    as_lane = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.col("lane").alias("i"), j.alias("j")))
    cells = F.when(F.col("lane").isNull(), as_part).otherwise(F.array_distinct(F.concat(as_part, as_lane)))
    return shipped.withColumn("cell", F.explode(cells)).select("root", "cell.i", "cell.j", "cls", "comp", "shingles")


def confirmed(placed: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: a forest of the links between classes that share a cell."""

    def confirm(t: pa.Table) -> pa.Table:
        B.lean()
        names, first = np.unique(t.column("cls").to_numpy(), return_index=True)
        known = t.column("comp").to_numpy()[first]
        got = link(names, [B.unpack_sorted(t.column("shingles")[int(i)].as_py()) for i in first], num, den, known) if len(names) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    return placed.groupBy("root", "i", "j").applyInArrow(confirm, "a long, b long")


def grouped(docs: DataFrame, words: int, num: int, den: int, tables: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, k, n, comp, component``: the row's key, set size, the
    component it is in (null without words) and that component's smallest id."""
    sig = signatures(docs, words, tables, id_col, text_col)
    classes = stash(sig.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("id"), F.first("a").alias("a"), F.first("b").alias("b")), "classes")
    clusters = stash(connected(candidate_edges(classes, tables)), "clusters")
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / GRID).cast("int").alias("parts"))
    members = classes.select("cls", "id").join(clusters, F.col("cls") == F.col("node")).join(sizes, "root").select("cls", "id", "root", "parts")
    first = stash(confirmed(_placed_by_part(_sets_of(docs, members, words, id_col, text_col)), num, den), "links")
    linked = connected(first)
    large = stash(members.filter("parts > 1"), "large")
    if not large.isEmpty():  # clusters of several parts: what is apart still is compared across parts
        wide = stash(_across_parts(large, linked), "across")
        if not wide.filter("lane IS NOT NULL").isEmpty():
            more = confirmed(_placed_across(_sets_of(docs, wide, words, id_col, text_col, "comp long, part int, lane int, lanes int")), num, den)
            linked = connected(first.union(more))
    comp = classes.select("cls", "id").join(linked, F.col("cls") == F.col("node"), "left").select("cls", "id", F.coalesce("root", "cls").alias("comp"))
    least = comp.groupBy("comp").agg(F.min("id").alias("component"))
    of = comp.join(least, "comp").select(F.col("cls").alias("c"), "comp", "component")
    return sig.select("doc_id", "k", "n", "cls").join(of, F.col("cls") == F.col("c"), "left").select("doc_id", "k", "n", "comp", "component")


def near_duplicates(docs: DataFrame, words: int = 3, num: int = 85, den: int = 100, tables: int = TABLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``."""
    out = grouped(docs, words, num, den, tables, id_col, text_col)
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, tables: int = 12) -> DataFrame:
    """``docs`` (``doc_id``, ``text`` and any other columns, of any names) with one
    row of each group: the smallest id, null last, and of rows that agree in id and
    text the first. Rows without words are in no group and all stay."""
    rows = grouped(docs, words, num, den, tables).filter(F.col("comp").isNotNull())
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k")).alias("m")).select(F.col("m.k").alias("_k"), F.col("m.doc_id").alias("_id"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # One struct holds the row, so no column of it can clash with ours.
    own = docs.filter(has_words).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("own"), F.col("doc_id").alias("id"))
    kept = own.join(first, (F.col("own") == F.col("_k")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["own", "id"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).union(docs.filter(~has_words))


#: All pairs that share a shingle, compared exactly, and their components.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT k, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM d),
one AS MATERIALIZED (SELECT min(k) AS c, list_sort(s) AS s FROM sh WHERE len(s) > 0 GROUP BY list_sort(s)),
cls AS MATERIALIZED (SELECT sh.k, one.c FROM sh JOIN one ON list_sort(sh.s) = one.s),
e AS (SELECT c, len(s) AS n, unnest(s) AS x FROM one),
link AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.x = b.x AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT c, c FROM one UNION SELECT r.a, CASE WHEN l.a = r.b THEN l.b ELSE l.a END FROM reach r JOIN link l ON l.a = r.b OR l.b = r.b),
comp AS (SELECT a AS c, min(b) AS r FROM reach GROUP BY a),
least AS (SELECT r, min(doc_id) AS component_id FROM cls JOIN comp USING (c) JOIN d USING (k) GROUP BY r)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN c IS NULL THEN doc_id ELSE component_id END AS component_id, doc_id IS NOT DISTINCT FROM (CASE WHEN c IS NULL THEN doc_id ELSE component_id END) AS kept
FROM d JOIN sh USING (k) LEFT JOIN cls USING (k) LEFT JOIN comp USING (c) LEFT JOIN least USING (r)"""
