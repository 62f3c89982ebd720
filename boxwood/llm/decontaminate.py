"""Benchmark decontamination over a stored positional inverted index.

A posting is a row ``(document, place, term)``; only terms of the benchmark have
postings. A window's terms are ranked by how often the documents have them, and
lists are intersected from the rarest up:

1. One pass counts the benchmark's terms. A window with a term that no document
   has cannot occur.
2. One pass stores the postings of the ``RARE`` rarest terms of each window. Those
   of the rarest term lead; the lists of the next ones are intersected with them
   within reach. Few leads are left, and few documents have any.
3. The postings of all terms are stored for the documents that have leads left.
   A phrase match is a lead at whose start all terms stand at their offsets; a
   proximity match is one around which all stand within ``window + slop``
   consecutive words, in any order.

Every intersection is an equi-join on document, term and place (or a cell of
places), so nothing longer than a posting is shuffled.

Defined results
    null or wordless text: no words, no hits, ``contaminated`` false.
    items without words: they have no window and never occur.
    an item of fewer than ``window`` words: one window of all its words.
    repeated rows and repeated ids: each input row gets its own result row,
    computed from that row's text. A null ``doc_id`` is a value like another.
    repeated item ids: their windows are pooled under that id.
    A null ``item_id`` never counts.
    texts of any length: a posting a word. Extra columns are ignored, or kept as
    they are where rows are filtered; their names may be anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwood.llm.common import lower_ascii, row_key, stash

#: What lies between words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A word that no text holds; one posting of it closes each document.
CLOSE, CLOSE_ID = "\x00", -1

#: A table is broadcast if it has at most so many rows and bytes (8 a number, the
#: length of strings); beyond, Catalyst shuffles both sides.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20

#: Extra words that a proximity match may spread over.
SLOP = 2

#: Terms of a window whose lists are stored for all documents.
RARE = 3


def words(col: Column) -> Column:
    """Lower-cased words. Splitting lower-cased text makes one string per word
    and stays in generated code."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(col, F.lit(""))), BETWEEN), "")


def _fits(df: DataFrame) -> bool:
    """Whether a stored table may be broadcast, by its measured size."""
    size = sum((F.octet_length(c) if kind == "string" else F.lit(8) for c, kind in df.dtypes), F.lit(0))
    row = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return row[0] <= BROADCAST_ROWS and (row[1] or 0) <= BROADCAST_BYTES


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _fits(df) else df


class Windows:
    """Every window of every item: ``terms`` (``term, tid``, and the closing one),
    stored and marked for broadcast if it is small enough, ``places`` (``wid, n, off, tid``) and ``owners``
    (``wid, item_id``)."""

    def __init__(self, items: DataFrame, window: int = 8):
        w = items.select("item_id", words(F.col("text")).alias("w")).filter((F.size("w") > 0) & F.col("item_id").isNotNull())
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
        owned = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("win"))
        number = F.monotonically_increasing_id()  # fixed by writing it
        unique = stash(owned.groupBy("win").agg(F.collect_set("item_id").alias("items")).select("win", "items", number.alias("wid")), "windows")
        self.owners = unique.select("wid", F.explode("items").alias("item_id"))
        each = unique.select("wid", F.size("win").alias("n"), F.posexplode("win").alias("off", "term"))
        close = items.sparkSession.createDataFrame([(CLOSE, CLOSE_ID)], "term string, tid long")
        terms = stash(each.select("term").distinct().select("term", number.alias("tid")).union(close), "terms")
        self.places = each.join(terms, "term").select("wid", "n", "off", "tid")
        self.terms = _sized(terms)


def document_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(tid, df)``: places in ``docs`` of each of ``terms``. Partial counts are
    combined before the shuffle, so a frequent term is one row a task."""
    each = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return each.join(terms, "term").groupBy("tid").agg(F.count(F.lit(1)).alias("df"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(k, doc_id, pos, tid)``: each place (from 0) of each of ``terms`` in
    ``docs``, written to the shared folder; if the closing term is among them, for
    each document a row of ``CLOSE_ID`` whose ``pos`` is its number of words."""
    # No lambda up to the join: the scan, the explode and the probe share one generated loop.
    each = docs.select(row_key().alias("k"), "doc_id", F.posexplode(F.array_append(words(F.col("text")), CLOSE)).alias("pos", "term"))
    return stash(each.join(terms, "term").select("k", "doc_id", "pos", "tid"), "postings")


def ranked_windows(places: DataFrame, df: DataFrame) -> DataFrame:
    """``(wid, n, tids, at)`` of the windows that can occur: their distinct terms,
    the rarest first, and their terms with offsets."""
    known = places.join(df, "tid").groupBy("wid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "tid", "off"))).alias("t"))
    tids = F.array_distinct(F.transform("t", lambda x: x["tid"]))
    return stash(known.filter(F.size("t") == F.col("n")).select("wid", "n", tids.alias("tids"), F.transform("t", lambda x: F.struct(x["tid"].alias("tid"), x["off"].alias("off"))).alias("at")), "ranked")


def _same(tid: str = "tid") -> Column:
    """A row's document and term are those of a posting (``p*``)."""
    return (F.col("k") == F.col("pk")) & F.col("doc_id").eqNullSafe(F.col("pdoc")) & (F.col(tid) == F.col("ptid"))


def _postings(index: DataFrame) -> DataFrame:
    return index.filter(F.col("tid") != CLOSE_ID).select(F.col("k").alias("pk"), F.col("doc_id").alias("pdoc"), "pos", F.col("tid").alias("ptid"))


def leads_of(index: DataFrame, ranked: DataFrame, reach: int) -> DataFrame:
    """``(k, doc_id, wid, lead)``: places of a window's rarest term that have its
    next ``RARE - 1`` terms less than ``reach`` words away."""
    # A window of fewer terms repeats its last, which is found where it was found.
    nth = [F.col("tids")[F.least(F.lit(q), F.size("tids") - 1)].alias(f"t{q}") for q in range(RARE)]
    head = _sized(stash(ranked.select("wid", *nth), "rarest"))
    p = _postings(index)
    leads = p.join(head, F.col("ptid") == F.col("t0")).select(F.col("pk").alias("k"), F.col("pdoc").alias("doc_id"), "wid", F.col("pos").alias("lead"), *[f"t{q}" for q in range(1, RARE)]).distinct()
    # Places are cut into cells, so a term's places far from a lead never meet it,
    # however often a document has the term.
    cell = lambda c: F.floor(c / (4 * reach))
    celled = p.withColumn("pcell", cell(F.col("pos")))
    for q in range(1, RARE):
        cells = F.explode(F.array_distinct(F.array(cell(F.col("lead") - reach), cell(F.col("lead") + reach))))
        wanted = leads.withColumn("cell", cells)
        met = wanted.join(celled, _same(f"t{q}") & (F.col("cell") == F.col("pcell")) & (F.abs(F.col("pos") - F.col("lead")) < reach))
        leads = met.select(*leads.columns).distinct()
    return stash(leads.select("k", "doc_id", "wid", "lead"), "leads")


def postings_of(docs: DataFrame, leads: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of all ``terms`` for the documents that have leads."""
    some = _sized(stash(leads.select(F.col("k").alias("lk"), F.col("doc_id").alias("ldoc")).distinct(), "documents"))
    return _postings(build_index(docs.join(some, (row_key() == F.col("lk")) & F.col("doc_id").eqNullSafe(F.col("ldoc")), "left_semi"), terms)).distinct()


def phrase_matches(local: DataFrame, ranked: DataFrame, leads: DataFrame) -> DataFrame:
    """``(k, doc_id, wid, n, start)`` of the windows that occur."""
    at = ranked.select("wid", "n", F.explode(F.filter("at", lambda x: x["tid"] == F.col("tids")[0])).alias("x"))
    starts = leads.join(at, "wid").select("k", "doc_id", "wid", "n", (F.col("lead") - F.col("x.off")).alias("start")).filter("start >= 0").distinct()
    wanted = starts.join(ranked.select("wid", F.explode("at").alias("x")), "wid").select("k", "doc_id", "wid", "n", "start", F.col("x.tid").alias("tid"), (F.col("start") + F.col("x.off")).alias("place"))
    met = wanted.join(local, _same() & (F.col("place") == F.col("pos"))).groupBy("k", "doc_id", "wid", "n", "start").agg(F.count(F.lit(1)).alias("met"))
    return stash(met.filter(F.col("met") == F.col("n")).drop("met"), "phrases")


def proximity_matches(local: DataFrame, ranked: DataFrame, leads: DataFrame, window: int, slop: int) -> DataFrame:
    """``(k, doc_id, wid)``: all terms of the window within ``n + slop`` consecutive
    words, one of them at a lead."""
    reach, wide = F.col("n") + slop, 4 * (window + slop)
    cell = lambda c: F.floor(c / wide)
    cells = F.explode(F.array_distinct(F.array(cell(F.col("lead") - window - slop), cell(F.col("lead") + window + slop))))
    near = leads.join(ranked.select("wid", "n", F.explode("tids").alias("tid")), "wid").withColumn("cell", cells)
    met = near.join(local.withColumn("pcell", cell(F.col("pos"))), _same() & (F.col("cell") == F.col("pcell")) & (F.abs(F.col("pos") - F.col("lead")) < reach))
    starts = F.explode(F.sequence(F.greatest("pos", "lead") - reach + 1, F.least("pos", "lead")))
    stretch = met.select("k", "doc_id", "wid", "tid", starts.alias("s")).distinct()
    full = stretch.groupBy("k", "doc_id", "wid", "s").agg(F.count(F.lit(1)).alias("met"))
    return full.join(ranked.select("wid", F.size("tids").alias("need")), "wid").filter("met = need").select("k", "doc_id", "wid").distinct()


class Search:
    """The benchmark's windows looked up in ``docs``."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = 8, slop: int = SLOP):
        docs = docs.select("doc_id", "text")
        self.window, self.slop = window, slop
        wins = Windows(benchmark, window)
        self.owners = wins.owners
        self.ranked = ranked_windows(wins.places, document_frequency(docs, wins.terms))
        rare = self.ranked.select(F.explode(F.slice("tids", 1, RARE)).alias("tid")).union(benchmark.sparkSession.range(1).select(F.lit(CLOSE_ID).cast("long"))).distinct()
        self.index = build_index(docs, _sized(stash(wins.terms.join(rare, "tid", "left_semi").select("term", "tid"), "rare")))
        self.leads = leads_of(self.index, self.ranked, window + slop)
        self.local = postings_of(docs, self.leads, wins.terms)
        self.phrases = phrase_matches(self.local, self.ranked, self.leads)

    def items(self) -> DataFrame:
        """``(k, doc_id, item_id)``: items of which a window occurs."""
        return self.phrases.select("k", "doc_id", "wid").distinct().join(self.owners, "wid").select("k", "doc_id", "item_id").distinct()

    def near_items(self, exact: DataFrame) -> DataFrame:
        """Items of which no window occurs, but one does by proximity."""
        known = exact.select(F.col("k").alias("ek"), F.col("doc_id").alias("edoc"), F.col("item_id").alias("eitem"))
        same = (F.col("k") == F.col("ek")) & F.col("doc_id").eqNullSafe(F.col("edoc")) & (F.col("item_id") == F.col("eitem"))
        owners = self.owners
        open_ = self.leads.join(owners, "wid").join(known, same, "left_anti").drop("item_id").distinct()
        found = proximity_matches(self.local, self.ranked, open_, self.window, self.slop)
        return found.join(owners, "wid").join(known, same, "left_anti").select("k", "doc_id", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, slop: int = SLOP) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated`` (at least ``min_items`` items have an occurring window), and
    ``n_near``: items of which no window occurs, but one does by proximity."""
    s = Search(docs, benchmark, window, slop)
    exact = stash(s.items(), "items")
    places = s.phrases.select("k", "doc_id", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct()
    none = {"n_hit": F.lit(None).cast("long"), "items": F.lit(None).cast("array<string>"), "n_near": F.lit(None).cast("long")}
    told = lambda df, name, agg: df.groupBy("k", "doc_id").agg(agg.alias("x")).select(F.col("k").alias("fk"), F.col("doc_id").alias("fid"), *[(F.col("x") if c == name else none[c]).alias(c) for c in none])
    got = told(places, "n_hit", F.count(F.lit(1))).union(told(exact, "items", F.array_sort(F.collect_list(F.col("item_id").cast("string"))))).union(told(s.near_items(exact), "n_near", F.count(F.lit(1))))
    got = got.groupBy("fk", "fid").agg(*[F.max(c).alias(c) for c in none])
    base = s.index.filter(F.col("tid") == CLOSE_ID).select("k", "doc_id", F.col("pos").cast("long").alias("n_words"))
    n_items = F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long")
    return base.join(got, (F.col("k") == F.col("fk")) & F.col("doc_id").eqNullSafe(F.col("fid")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 1) -> DataFrame:
    """``docs`` (``doc_id``, ``text`` and any other columns) without the rows that
    hold a window of ``min_items`` items or more: one passage is enough. What is
    joined back is one small row per contaminated text."""
    items = Search(docs, benchmark, window).items().groupBy("k", "doc_id").agg(F.count(F.lit(1)).alias("items"))
    bad = _sized(stash(items.filter(F.col("items") >= min_items).select(F.col("k").alias("bk"), F.col("doc_id").alias("bid")), "contaminated"))
    # One struct holds the row, so no column of it can clash with ours.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("k"), F.col("doc_id").alias("id"))
    return own.join(bad, (F.col("k") == F.col("bk")) & F.col("id").eqNullSafe(F.col("bid")), "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS MATERIALIZED (SELECT DISTINCT item_id, w[i:i+7] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
short AS (SELECT DISTINCT len(win) AS n FROM win),
grams AS (SELECT k, i, n, w[i:i+n-1] AS win FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, short WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT g.k, g.i, g.n, win.item_id FROM grams g JOIN win USING (win)),
cov AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY k),
its AS (SELECT k, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY k),
wt AS MATERIALIZED (SELECT DISTINCT item_id, win, len(win) AS n, unnest(win) AS term FROM win),
post AS MATERIALIZED (SELECT k, pos, w[pos] AS term FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS pos FROM d) WHERE w[pos] IN (SELECT term FROM wt)),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
rare AS (SELECT item_id, win, n, arg_min(term, df) AS term FROM wt JOIN df USING (term) GROUP BY ALL),
lead AS (SELECT p.k, r.item_id, r.win, r.n, p.pos AS at FROM rare r JOIN post p USING (term) WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.k = p.k AND h.item_id = r.item_id)),
met AS (SELECT DISTINCT l.k, l.item_id, l.win, wt.term, unnest(range(greatest(p.pos, l.at) - l.n - {SLOP} + 1, least(p.pos, l.at) + 1)) AS s
  FROM lead l JOIN wt ON wt.item_id = l.item_id AND wt.win = l.win JOIN post p ON p.k = l.k AND p.term = wt.term AND abs(p.pos - l.at) < l.n + {SLOP}),
full_ AS (SELECT k, item_id, win FROM met GROUP BY k, item_id, win, s HAVING count(*) = len(list_distinct(win))),
near AS (SELECT k, count(DISTINCT item_id) AS n_near FROM full_ GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN cov USING (k) LEFT JOIN its USING (k) LEFT JOIN near USING (k)
"""
