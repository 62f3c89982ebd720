"""Main text of HTML pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of elements (a small tolerant parser: raw-text elements,
comments, optional end tags). Each element gets features: hashed words of its tag,
class, id and role, the same of its parent, depth, sibling statistics, and
densities of text, links, markup and paragraphs in its subtree. Gradient-boosted
trees give the log-odds that an element belongs to the main text. Decoding picks
the best consistent set: an element can be kept only below a kept one, or as the
root of a kept region, so a menu inside an article goes with all it holds and a
paragraph inside a footer cannot come back; scores are weighed by the text
they decide about.

The model is trained here. Its rows are pages of a bounded sample (``SAMPLE``, a
documented parameter) whose structure says what is main (article, main), and
variants of them in which the container loses its telling name and menus, notices,
adverts, sidebars, forms and reader comments are put around and into it.

Defined results
    null or empty html, or no main text: empty text, 0 code points.
    elements that are never text (script, style, head, form, nav, ...) go whatever
    the model says. ``br`` is white space. Null or repeated ``page_id``: one result
    row per input row. Whole pages are read, of any length; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwood.llm.common import small_batches

SAMPLE = 150
#: What opens markup, and what a tag holds up to its ``>``; neither is tried twice at a place.
OPENS = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+")
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"script", "style", "head", "title", "template", "noscript", "iframe", "svg", "canvas", "object", "form", "button", "select", "textarea", "input", "nav", "footer", "aside", "menu", "dialog", "noembed", "noframes"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
SAME = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
TOKENS = ("ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "cookie", "consent", "notice", "popup", "modal", "alert", "nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "copyright", "sidebar", "aside", "widget", "related", "share", "social", "newsletter", "subscribe", "signup", "login", "form", "search", "comment", "comments", "reply", "replies", "disqus", "pagination", "pager", "tags", "meta", "byline", "article", "post", "entry", "content", "main", "body", "story", "text", "page", "wrapper", "container")
BAD = set(TOKENS[: TOKENS.index("meta")]) | {"adverts", "recommended", "trending", "toolbar", "skip", "legal", "disclaimer", "respond", "discussion"}
TAGS = ("html", "body", "article", "main", "section", "div", "header", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "a", "b", "i", "em", "strong", "span", "table", "td", "tr", "blockquote", "pre", "code", "figure", "figcaption", "dl")
WORDS = re.compile(r"[a-z]+")
TAG_AT, TOKEN_AT = {t: i for i, t in enumerate(TAGS)}, {t: i for i, t in enumerate(TOKENS)}


class Node:
    __slots__ = ("tag", "attrs", "parent", "block", "kids", "parts", "depth", "words", "n_text", "n_link", "n_tags", "n_p", "n_stops")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids, self.parts = tag, attrs, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.block: Node = self if parent is None or tag in BLOCK else parent.block
        self.words: set[str] = set()
        self.n_text = self.n_link = self.n_tags = self.n_p = self.n_stops = 0


def attr_words(attrs: str) -> set[str]:
    out: set[str] = set()
    if attrs and attrs.strip():
        for m in ATTR.finditer(attrs):
            name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                split = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
                out |= set(WORDS.findall(split))
            elif name in ("hidden", "aria-hidden"):
                if name == "hidden" or value == "true":
                    out.add("_hidden")
    return out


def tokens(page: str):
    """Texts as strings, tags as (name, closing, attributes), in one pass. Raw-text
    elements give their text as one string. Every search goes on where the last
    one ended, so the time is linear in the page, whatever is left open in it."""
    at, end, raw = 0, len(page), None
    while at < end:
        if raw:
            m = RAW_END[raw].search(page, at)
            yield page[at : m.start() if m else end]
            raw = None
            if not m:
                return
            at = m.start()
        m = OPENS.search(page, at)
        if not m:
            yield page[at:]
            return
        if m.start() > at:
            yield page[at : m.start()]
        at, mark = m.start(), m.group()
        if mark[1] in "!?":
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(mark, ">")
            to = page.find(close, m.end())
            if mark == "<![CDATA[":
                yield page[m.end() : to if to >= 0 else end]
            at = to + len(close) if to >= 0 else end
            continue
        name = NAME.match(page, at)
        inner = INSIDE.match(page, name.end())
        to = inner.end()
        if to < end and page[to] != ">":  # a quote that is never closed
            to = page.find(">", to)
            to = to if to >= 0 else end
        tag, closing = name.group(1).lower(), mark[1] == "/"
        attrs = page[name.end() : to]
        at = to + 1
        if to >= end:
            return  # the page ends inside a tag
        yield tag, closing, attrs
        if tag in RAW and not closing:
            raw = tag


def parse(page: str) -> Node:
    """The element tree; ``parts`` holds texts and child nodes in page order."""
    root = Node("#root", "", None)
    top, open_ = root, Counter()

    def leave(node: Node) -> Node:
        """Closes all up to ``node``; its parent is on top then."""
        at = top
        while True:
            open_[at.tag] -= 1
            if at is node:
                return node.parent
            at = at.parent

    for token in tokens(page):
        if isinstance(token, str):
            top.parts.append(token)
            continue
        tag, closing, attrs = token
        if closing:
            if open_[tag]:
                node = top
                while node is not root and node.tag != tag:
                    if node.tag in ("table", "article", "body") and tag not in ("body", "html", "article", "main"):
                        node = root
                        break
                    node = node.parent
                if node is not root:
                    top = leave(node)
            continue
        if tag in CLOSES_P and top.block.tag == "p":
            top = leave(top.block)
        if tag in SAME:
            node, close = top, None
            while node is not root and node.tag not in SAME[tag]:
                if node.tag == tag or (tag in ("dd", "dt") and node.tag in ("dd", "dt")) or (tag in ("td", "th") and node.tag in ("td", "th")):
                    close = node
                    break
                node = node.parent
            if close is not None:
                top = leave(close)
        node = Node(tag, attrs, top)
        top.kids.append(node)
        top.parts.append(node)
        if tag not in VOID and not (attrs.rstrip().endswith("/") and tag not in RAW):
            top = node
            open_[tag] += 1
    return root


def order(root: Node) -> list[Node]:
    """Nodes, parents before children, without recursion."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(reversed(n.kids))
    return out


def measure(nodes: list[Node]) -> None:
    for n in nodes:
        n.words = attr_words(n.attrs)
    for n in reversed(nodes):
        for p in n.parts:
            if isinstance(p, str):
                s = len(p) - p.count(" ")
                n.n_text += s
                n.n_stops += p.count(".") + p.count(",")
        for k in n.kids:
            if k.tag in ("script", "style", "head", "title"):
                continue
            n.n_text += k.n_text
            n.n_link += k.n_text if k.tag == "a" else k.n_link
            n.n_tags += k.n_tags + 1
            n.n_p += k.n_p + (k.tag == "p")
            n.n_stops += k.n_stops


def dropped(n: Node) -> bool:
    return n.tag in NEVER or "_hidden" in n.words


def features(nodes: list[Node]) -> np.ndarray:
    total, base, kinds = max(nodes[0].n_text, 1), 16, len(TAGS) + len(TOKENS)
    out = np.zeros((len(nodes), base + 2 * kinds), np.float32)
    numbers, up, rows, cols = [], [], [], []
    place: dict[int, int] = {}
    told: list[float] = []
    same: dict[int, dict[str, int]] = {}
    for i, n in enumerate(nodes):
        place[id(n)] = i
        p = n.parent
        j = place[id(p)] if p else i
        up.append(j)
        if id(p) not in same:
            count = same[id(p)] = {}
            for k in p.kids if p else [n]:
                count[k.tag] = count.get(k.tag, 0) + 1
        kin, text, bad = len(p.kids) if p else 1, n.n_text, float(not BAD.isdisjoint(n.words))
        above = max(told[j], numbers[j][11]) if p else 0.0
        told.append(above)
        numbers.append((n.depth, text, text / total, n.n_link / max(text, 1), text / (n.n_tags + 1), n.n_p, n.n_stops / max(text, 1), len(n.kids), kin, text / max(p.n_text, 1) if p else 1.0, same[id(p)][n.tag] / kin, bad, float("copyright" in n.words), above, 0.0, n.n_p / (n.n_tags + 1)))
        if n.tag in TAG_AT:
            rows.append(i), cols.append(base + TAG_AT[n.tag])
        for w in n.words:
            if w in TOKEN_AT:
                rows.append(i), cols.append(base + len(TAGS) + TOKEN_AT[w])
    out[:, :16] = numbers
    out[rows, cols] = 1
    out[1:, base + kinds :] = out[up, base : base + kinds][1:]
    for i in range(1, len(nodes)):
        if nodes[i].parent.tag in ("article", "main") or out[up[i], 14]:
            out[i, 14] = 1
    return out


@dataclass
class Boosted:
    """Gradient-boosted regression trees for log-odds, as flat arrays per tree:
    feature (-1 at a leaf), threshold, left child (right = left + 1), value."""

    bias: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feat, cut, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (feat[at] >= 0).any():
                f = feat[at]
                go = np.where(f >= 0, left[at] + (x[rows, np.maximum(f, 0)] > cut[at]), at)
                at = go
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24) -> Boosted:
    """Second-order boosting with per-feature quantile cuts."""
    p0 = float(np.clip((w * y).sum() / w.sum(), 0.01, 0.99))
    bias = float(np.log(p0 / (1 - p0)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(np.unique(x[:, j])) > 2 else np.array([0.5]) for j in range(x.shape[1])]
    live = [j for j in range(x.shape[1]) if x[:, j].min() != x[:, j].max()]
    code = {j: np.searchsorted(cuts[j], x[:, j], "left") for j in live}
    f, trees = np.full(len(x), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
        feat, cut, left, value = [-1], [0.0], [0], [0.0]
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            at, rows, d = todo.pop()
            G, H = g[rows].sum(), h[rows].sum()
            value[at] = rate * G / (H + 1)
            best = (1e-3, None, None)
            if d < depth and len(rows) > 20:
                for j in live:
                    c = code[j][rows]
                    gs, hs = np.cumsum(np.bincount(c, g[rows], len(cuts[j]) + 1))[:-1], np.cumsum(np.bincount(c, h[rows], len(cuts[j]) + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                    gain[(hs < 1) | (H - hs < 1)] = 0
                    k = int(gain.argmax()) if len(gain) else 0
                    if len(gain) and gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] is None:
                continue
            j, k = best[1], best[2]
            feat[at], cut[at], left[at] = j, float(cuts[j][k]), len(feat)
            for side in (code[j][rows] <= k, code[j][rows] > k):
                todo.append((len(feat), rows[side], d + 1))
                feat.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
        tree = (np.array(feat), np.array(cut), np.array(left), np.array(value))
        trees.append(tree)
        f += Boosted(0.0, [tree])(x)
    return Boosted(bias, trees)


def decode(nodes: list[Node], odds: np.ndarray) -> list[Node]:
    """Roots of kept regions and, inside them, what is cut: the assignment with
    the greatest weighed log-odds in which no kept node has a dropped ancestor
    below its region's root and no dropped node has kept ones above and below."""
    place = {id(n): i for i, n in enumerate(nodes)}
    texts = np.array([sum([len(p) for p in n.parts if isinstance(p, str)]) for n in nodes])
    own = (np.sqrt(texts + 1.0) * np.clip(odds, -6, 6)).tolist()
    inside, outside, lost = [0.0] * len(nodes), [0.0] * len(nodes), [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        kids = [place[id(k)] for k in n.kids]
        lost[i] = -own[i] + sum(lost[k] for k in kids)
        inside[i] = float('-inf') if dropped(n) else own[i] + sum(max(inside[k], lost[k]) for k in kids)
        outside[i] = lost[i] if n.tag in NEVER else max(inside[i], -own[i] + sum(outside[k] for k in kids))
    kept: list[Node] = []
    todo = [(nodes[0], False)]
    while todo:
        n, within = todo.pop()
        i = place[id(n)]
        if within:
            if inside[i] < lost[i]:
                continue
            kept.append(n)
        elif n.tag in NEVER:
            continue
        elif n.parent is not None and inside[i] >= -own[i] + sum(outside[place[id(k)]] for k in n.kids):
            within = True
            kept.append(n)
        todo.extend((k, within) for k in reversed(n.kids))
    return kept


def text_of(root: Node, kept: list[Node]) -> str:
    """Blocks of kept nodes in page order."""
    keep = {id(n) for n in kept}
    blocks: list[list[str]] = [[]]
    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        else:
            block = x.tag in BLOCK or x.tag == "#root"
            if block:
                blocks.append([])
                todo.append(None)
            if x.tag == "br":
                blocks[-1].append(" ")
            mine = id(x) in keep
            for p in reversed(x.parts):
                if not isinstance(p, str) or mine:
                    todo.append(p)
    out = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(b for b in out if b)


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """Main texts; the model runs once over the nodes of all ``pages``."""
    trees = []
    for page in pages:
        nodes = order(parse(page or ""))
        measure(nodes)
        trees.append(nodes)
    if not trees:
        return []
    odds = model(np.concatenate([features(t) for t in trees]))
    ends = np.cumsum([len(t) for t in trees])
    return [text_of(t[0], decode(t, odds[e - len(t) : e])) for t, e in zip(trees, ends, strict=True)]


def _variants(page: str, rng: np.random.Generator) -> list[str]:
    """The page, and pages made from it with other names and more around it."""
    m = re.search(r"(?s)<(article|main)\b[^>]*>(.*?)</\1>", page)
    if not m:
        return []
    body = m.group(2)
    words = re.sub(r"<[^>]*>|&\w+;", " ", body).split() or ["text"]
    say = lambda n: " ".join(rng.choice(words, n))
    pick = lambda *x: x[rng.integers(len(x))]
    out = [page]
    for _ in range(3):
        junk = lambda cls, n=12: f'<div {pick("class", "id")}="{cls}"><p>{say(n)}</p><p>{say(n)}</p></div>'
        opens, closes = pick(("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<ul class="nav">', "</ul>"))
        nav = opens + "".join(f'<li><a href="/{i}">{say(2)}</a></li>' for i in range(6)) + closes
        head = pick(("<header>", "</header>"), ('<div class="header">', "</div>"))
        inner = body + pick("", f'<div class="{pick("ad", "share", "related", "newsletter", "comments")}"><p>{say(14)}</p></div>', f'<section id="comments"><h3>{say(2)}</h3>' + "".join(f'<div class="comment"><p>{say(15)}</p></div>' for _ in range(3)) + "</section>")
        holder = pick(("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content" data-m>', "</div>"), ('<div id="main" data-m>', "</div>"), ('<div class="post-body" data-m>', "</div>"), ('<section class="story" data-m>', "</section>"), ("<div data-m>", "</div>"))
        open_ = holder[0] if "data-m" in holder[0] else holder[0].replace(">", " data-m>")
        out.append(f'<html><head><title>{say(5)}</title></head><body>{head[0]}<p>{say(4)}</p>{head[1]}{nav}{junk(pick("cookie-notice", "banner", "ad"))}{open_}{inner}{holder[1]}{junk(pick("sidebar", "widget", "related-posts", "comments", "subscribe"))}<div class="footer"><p>{say(6)}</p></div></body></html>')
    return out


def training_rows(pages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng, xs, ys, ws = np.random.Generator(np.random.PCG64(17)), [], [], []
    for page in pages:
        for variant in _variants(page, rng):
            nodes = order(parse(variant))
            measure(nodes)
            main: dict[int, bool] = {}
            for n in nodes:
                above = n.parent is not None and main[id(n.parent)]
                main[id(n)] = (above or n.tag in ("article", "main") or "data-m" in n.attrs) and not dropped(n) and not (above and bool(n.words & BAD))
            usable = [i for i, n in enumerate(nodes) if n.tag not in NEVER]
            xs.append(features(nodes)[usable])
            ys.append(np.array([main[id(nodes[i])] for i in usable], float))
            ws.append(np.array([1.0 + np.log1p(nodes[i].n_text) for i in usable]))
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)


def _rows_or_rule(pages: list[str]) -> Boosted:
    """Without a page that tells its main part, one built-in page stands in."""
    telling = [p for p in pages if re.search(r"<(article|main)\b", p)]
    if not telling:
        telling = ["<html><body><nav><ul><li><a>x</a></li></ul></nav><article><h1>Some title here</h1>" + "".join(f"<p>{'some words of running text, and more. ' * n}</p>" for n in range(1, 9)) + "</article><footer>foot</footer></body></html>"] * 20
    x, y, w = training_rows(telling)
    return boost(x, y, w)


def train(pages: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Fit on about ``sample`` pages picked by a hash of the page id."""
    n = pages.count()
    share = int(min(1.0, sample / max(n, 1)) * 1_000_000)
    some = pages.filter(F.col("html").isNotNull()).filter(F.pmod(F.xxhash64("page_id", F.lit(5)), F.lit(1_000_000)) < share).select("html").collect()
    return _rows_or_rule(sorted({r.html for r in some}))


def main_text(pages: DataFrame, model: Boosted) -> DataFrame:
    """Per row: ``page_id, url, text, n_chars``."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                texts = extract(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
