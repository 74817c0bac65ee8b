"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded over the tree.

A page is parsed into a tree of its block elements; each run of text between
block boundaries is a leaf.  Every node gets features of its subtree (text,
words, links, punctuation and their densities), its tag and attribute tokens,
depth and siblings, and its ancestors.  Boosted trees give the probability that
a node holds main text.  Decoding picks the likeliest consistent choice by
dynamic programming from the leaves up: a node that is out takes its whole
subtree out, so nothing is kept below a rejected ancestor, and the kept leaves
are the blocks of the result.

Training needs no hand-made labels: from a bounded sample (the ``SAMPLE`` pages
with the smallest id hashes) each page with a marked article is read as it is,
labelled by that mark, and ``VARIANTS`` times more rearranged: its article under other
names and its other parts, mixed with sentences of the page, as menus, notices,
comments, forms, side bars and so on.  The fit is one Spark group of that size.

Defined results for odd input: null and empty html give the empty text; plain
text without tags is one block and kept; a head without an end tag ends where
something stands that a head cannot hold; other unclosed and stray tags are repaired as browsers do for paragraphs, list items and cells;
an open svg, select or option ends where a block begins; a button, object or canvas that never ends hides nothing; a stray quote
in a tag is part of the tag; pages of any length and nesting are read in time that follows their length;
rows that repeat and null ids are rows like any other; without any page to
learn from, blocks outside excluded elements are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from halcyon.llm.common import table
from halcyon.plans.registry import register

SAMPLE = 300
#: rearranged versions of each sampled page
VARIANTS = 2
TREES, DEPTH, RATE, BINS = 40, 4, 0.2, 32
#: weight (second derivatives) on either side of a split at least
LEAST = 3.0
#: pages whose nodes are scored at once
CHUNK = 200

# What HTML calls block elements, elements without an end, and text that is not shown.
BLOCKS = ("html body main article section div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
          "tfoot tr td th caption blockquote pre figure figcaption address details summary dialog hgroup center hr").split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
HIDDEN = "script style noscript template textarea select option button svg iframe object head title canvas".split()
RAW = "script style textarea title noscript template iframe".split()
IN_HEAD = frozenset("base link meta title script style noscript template head html".split())
# The tags and attribute tokens that are features of their own.
TAGS = "article main section div nav header footer aside form p h1 h2 h3 h4 ul li td blockquote pre figure".split()
TOKENS = ("content article post main entry story body text nav menu header footer sidebar side aside ad ads advert advertisement promo banner sponsor "
          "cookie consent notice alert share social related recommend comment comments reply replies discussion respond form login search subscribe "
          "newsletter signup popup modal widget breadcrumb breadcrumbs pagination pager tags meta byline copyright legal toolbar skip").split()

MAIN_TOKENS = "content article post main entry story body text tags meta byline".split()
NOT_MAIN_TAGS = frozenset("nav aside form footer".split())

NOT_MAIN = frozenset(TOKENS) - frozenset(MAIN_TOKENS)
_TAG = {t: i for i, t in enumerate(TAGS)}
_TOKEN = {t: i for i, t in enumerate(TOKENS)}
_BLOCKS, _VOID, _HIDDEN = frozenset(BLOCKS), frozenset(VOID), frozenset(HIDDEN)
#: start tags that end an open element of these kinds (up to the list or table around it)
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
         "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = frozenset("ul ol dl table html body article section div td th".split())
#: a comment, a declaration, a tag (a quote counts only behind an equals sign, and only if it is closed), or text; nothing is tried twice
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]+|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label|data-main)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: elements that a block ends, wherever they were left open: a browser goes back to the page there
_LEFT_BY_BLOCKS = ("svg", "select", "option")
_TABLE_PARTS = frozenset("tr td th thead tbody tfoot".split())


class Node:
    __slots__ = ("tag", "parent", "tokens", "text", "chars", "words", "link", "marks", "leaves", "depth", "index", "kids", "label")

    def __init__(self, tag, parent, tokens=(), text=None, label=None):
        self.tag, self.parent, self.tokens, self.text, self.label = tag, parent, tokens, text, label
        self.chars = self.words = self.link = self.marks = self.leaves = self.kids = self.depth = self.index = 0


def _attributes(source: str):
    tokens, label = [], None
    for name, value in _ATTRIBUTE.findall(source):
        value = html.unescape(value.strip("\"'"))
        if name.lower() == "data-main":
            label = value == "1"
        else:
            tokens += [t.lower() for t in _SPLIT.split(value) if t]
    return tuple(tokens), label


def parse(page: str) -> list[Node]:
    """The page's block elements and text leaves in page order (parents first); parent is an index."""
    nodes = [Node("html", -1)]
    stack = [("html", 0)]  # open elements; inline ones share the index of their block
    places: dict[str, list[int]] = {}  # where in the stack each kind is open, so that nothing walks through the stack
    blocks: list[int] = []
    last_end: dict[str, int] = {}
    lower = None
    pieces: list[str] = []
    linked, hidden, links = 0, 0, 0

    def open_at(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                leaf = Node("#", stack[-1][1], (), text)
                leaf.chars, leaf.words, leaf.leaves = len(text), text.count(" ") + 1, 1
                leaf.link = min(linked, len(text))
                leaf.marks = sum(map(text.count, ".,;:!?"))
                nodes.append(leaf)
            pieces.clear()
        linked = 0

    def close(to: int):
        nonlocal hidden, links
        while len(stack) > to:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag in _BLOCKS:
                blocks.pop()
            hidden -= tag in _HIDDEN
            links -= tag == "a"

    at, size = 0, len(page)
    while at < size:
        m = _PIECE.match(page, at)
        at = m.end()
        tag = m.group(2)
        if m.group(4) is not None:
            if stack[-1][0] == "head" and m.group(4).strip():
                close(len(stack) - 1)
            if not hidden:
                pieces.append(m.group(4))
                linked += len(m.group(4)) if links else 0
            continue
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in _BLOCKS
        if m.group(1):
            k = open_at((tag,))
            # an inline end tag does not reach out of its block
            if k and (block or not blocks or blocks[-1] < k):
                if block:
                    flush()
                close(k)
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag == "br":
            pieces.append(" ")
            continue
        if block:
            flush()
            while hidden and (k := open_at(_LEFT_BY_BLOCKS)) > open_at(("foreignobject",)):
                close(k)
            ends = ("p", *_ENDS.get(tag, ()))
            around = open_at(("table",) if tag in _TABLE_PARTS else _SCOPE.difference(ends))
            while (k := open_at(ends)) > around:
                close(k)
        if tag in ("html", "body"):
            continue
        if tag in _VOID or m.group(3).endswith("/") and tag not in _BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in _HIDDEN and tag != "head" and tag not in _LEFT_BY_BLOCKS:
            if tag not in last_end:
                lower = page.lower() if lower is None else lower
                last_end[tag] = lower.rfind("</" + tag)
            if last_end[tag] < at:
                continue  # never closed: it hides nothing
        where = stack[-1][1]
        if block and not hidden:
            tokens, label = _attributes(m.group(3))
            nodes.append(Node(tag, where, tokens, None, label))
            where = len(nodes) - 1
        places.setdefault(tag, []).append(len(stack))
        if block:
            blocks.append(len(stack))
        stack.append((tag, where))
        hidden += tag in _HIDDEN
        links += tag == "a"
    flush()
    _measure(nodes)
    return nodes


def _measure(nodes: list[Node]) -> None:
    """Subtree sums, depths and places among siblings."""
    for n in nodes[1:]:
        parent = nodes[n.parent]
        n.depth, n.index = parent.depth + 1, parent.kids
        parent.kids += 1
    for k in range(len(nodes) - 1, 0, -1):
        n, parent = nodes[k], nodes[nodes[k].parent]
        parent.chars += n.chars
        parent.words += n.words
        parent.link += n.link
        parent.marks += n.marks
        parent.leaves += n.leaves


N_FEATURES = 20 + 3 * len(TAGS) + 2 * len(TOKENS)


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node but the root."""
    out = np.zeros((len(nodes) - 1, N_FEATURES), dtype=np.float32)
    tags, tokens = [0] * len(nodes), [0] * len(nodes)  # of a node and its ancestors, as bit sets
    total = nodes[0]
    at_tag, at_tokens = 20, 20 + 3 * len(TAGS)
    seen = 0
    for k in range(1, len(nodes)):
        n, parent = nodes[k], nodes[nodes[k].parent]
        own = n if n.text is None else parent  # a leaf shows its element's tag and tokens
        row = out[k - 1]
        chars = n.chars + 1
        row[:20] = (n.text is not None, n.chars, n.words, n.link / chars, n.marks / chars * 100, n.chars / (n.leaves + 1), n.words / (n.leaves + 1), n.leaves,
                    n.depth, n.index, parent.kids, n.index / max(1, parent.kids - 1), n.kids, chars / (parent.chars + 1),
                    chars / (total.chars + 1), seen / (total.chars + 1), parent.link / (parent.chars + 1), parent.chars / (parent.leaves + 1),
                    parent.marks / (parent.chars + 1) * 100, len(n.tokens))
        seen += n.chars if n.text is not None else 0
        bits, marks = tags[n.parent], tokens[n.parent]
        if n.text is None:
            if n.tag in _TAG:
                bits |= 1 << _TAG[n.tag]
            for t in n.tokens:
                t = _TOKEN.get(t)
                if t is not None:
                    marks |= 1 << t
        tags[k], tokens[k] = bits, marks
        if own.tag in _TAG:
            row[at_tag + _TAG[own.tag]] = 1
        if parent.tag in _TAG:
            row[at_tag + len(TAGS) + _TAG[parent.tag]] = 1
        for t in own.tokens:
            t = _TOKEN.get(t)
            if t is not None:
                row[at_tokens + t] = 1
        t = bits
        while t:
            low = t & -t
            row[at_tag + 2 * len(TAGS) + low.bit_length() - 1] = 1
            t ^= low
        t = marks
        while t:
            low = t & -t
            row[at_tokens + len(TOKENS) + low.bit_length() - 1] = 1
            t ^= low
    return out


# ---- boosting ----

def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Trees for the log loss: second-order gains on binned features, complete trees of ``depth`` levels."""
    flags = np.flatnonzero([(np.isin(c, (0, 1))).all() for c in x.T])
    rest = np.setdiff1d(np.arange(x.shape[1]), flags)
    on = x[:, flags].astype(np.float64)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in rest]
    binned = [np.searchsorted(c, x[:, k], side="left") for c, k in zip(cuts, rest)]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    z = np.full(len(y), base)
    feature, limit, value = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        f, t = np.zeros(2 ** depth - 1, np.int32), np.full(2 ** depth - 1, np.inf)
        for level in range(depth):
            width = 2 ** level
            key = node - (width - 1)
            total_g, total_h = np.bincount(key, g, width)[:, None], np.bincount(key, h, width)[:, None]
            best, rows = np.full(width, 1e-6), np.arange(width)

            def offer(gr, hr, features, limits):
                """Takes the best of splits given by the sums of their right sides."""
                gl, hl = total_g - gr, total_h - hr
                gain = gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - total_g ** 2 / (total_h + 1)
                gain[(hl < LEAST) | (hr < LEAST)] = 0
                at = gain.argmax(axis=1)
                for q in np.flatnonzero(gain[rows, at] > best):
                    best[q], f[width - 1 + q], t[width - 1 + q] = gain[q, at[q]], features[at[q]], limits[at[q]]

            if len(flags):
                member = np.zeros((width, len(y)))
                member[key, np.arange(len(y))] = 1
                offer((member * g) @ on, (member * h) @ on, flags, np.full(len(flags), 0.5))
            for k, c, column in zip(rest, cuts, binned):
                if len(c):
                    b = len(c) + 1
                    sums = [np.bincount(key * b + column, v, width * b).reshape(width, b) for v in (g, h)]
                    right = [(v.sum(axis=1, keepdims=True) - v.cumsum(axis=1))[:, :-1] for v in sums]
                    offer(*right, np.full(len(c), k), c)
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        leaf = node - (2 ** depth - 1)
        v = -rate * np.bincount(leaf, g, 2 ** depth) / (np.bincount(leaf, h, 2 ** depth) + 1)
        z += v[leaf]
        feature.append(f)
        limit.append(t)
        value.append(v)
    return {"base": base, "feature": np.stack(feature), "limit": np.stack(limit), "value": np.stack(value)}


def margins(x: np.ndarray, model: dict) -> np.ndarray:
    z, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for f, t, v in zip(model["feature"], model["limit"], model["value"]):
        node = np.zeros(len(x), dtype=np.int64)
        while node.size and node[0] < len(f):
            node = 2 * node + 1 + (x[rows, f[node]] > t[node])
        z += v[node - len(f)]
    return z


def decode(nodes: list[Node], z: np.ndarray) -> str:
    """The text of the kept leaves under the likeliest choice in which out nodes have nothing kept below
    (all of it if the page has no elements)."""
    if all(n.text is not None for n in nodes[1:]):
        return "\n".join(n.text for n in nodes[1:])
    log_in, log_out = -np.logaddexp(0, -z), -np.logaddexp(0, z)
    keep, drop = [0.0, *log_in.tolist()], [0.0, *log_out.tolist()]
    gain = [0.0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        # keep[k], drop[k] now hold the whole subtree
        parent = nodes[k].parent
        drop[parent] += drop[k]
        gain[k] = keep[k] - drop[k]
        keep[parent] += max(keep[k], drop[k])
    kept, out = [True] * len(nodes), []
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and gain[k] > 0
        if kept[k] and nodes[k].text is not None:
            out.append(nodes[k].text)
    return "\n".join(out)


# ---- training pages ----

_ARTICLE = re.compile(r"<(article|main)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
# How other pages name their parts (tag, attributes); "" stands for an element without attributes.
MAIN_NAMES = [("article", ""), ("main", ""), ("div", 'class="post-content"'), ("div", 'id="content"'), ("div", 'class="entry"'), ("section", 'class="story-body"'),
              ("div", 'role="main"'), ("div", ""), ("div", 'class="article-text"')]
MENU_NAMES = [("nav", ""), ("div", 'class="menu"'), ("ul", 'class="nav"'), ("div", 'class="breadcrumbs"'), ("div", 'class="pagination"'), ("div", 'id="toolbar"')]
OTHER_NAMES = [("aside", ""), ("aside", 'class="sidebar"'), ("div", 'class="sidebar"'), ("div", 'class="ad"'), ("div", 'class="advert banner"'), ("div", 'class="promo"'),
               ("div", 'class="cookie-notice"'), ("div", 'class="notice"'), ("div", 'role="alert"'), ("section", 'class="comments"'), ("div", 'id="comments"'),
               ("div", 'class="comment"'), ("div", 'class="reply"'), ("div", 'class="related"'), ("div", 'class="share social"'), ("div", 'class="newsletter"'), ("div", 'class="widget"'),
               ("form", ""), ("form", 'class="search"'), ("div", 'class="subscribe"'), ("footer", ""), ("div", 'id="footer"'), ("header", ""), ("div", 'class="header"'),
               ("div", 'class="sponsor"'), ("div", 'class="popup modal"'), ("div", 'class="copyright legal"'), ("div", 'class="consent"')]


def _rearranged(page: str, inner: str, rng) -> str:
    """The page's article under another name among made-up parts that hold sentences of the page."""
    leaves = [n.text for n in parse(page) if n.text]
    sentences = [s for t in leaves for s in re.findall(r"[^.!?]+[.!?]?", t) if len(s) > 8] or ["x"]

    def some(n):
        return " ".join(html.escape(sentences[int(rng.integers(len(sentences)))].strip()) for _ in range(n))

    def part(names, inside):
        tag, attributes = names[int(rng.integers(len(names)))]
        return f'<{tag} data-main="0" {attributes}>{inside}</{tag}>'

    def other():
        kind = int(rng.integers(3))
        if kind == 0:
            return part(MENU_NAMES, "<ul>" + "".join(f'<li><a href="#">{some(1)[:int(rng.integers(4, 30))]}</a></li>' for _ in range(int(rng.integers(2, 8)))) + "</ul>")
        if kind == 1:
            return part(OTHER_NAMES, some(int(rng.integers(1, 4))))
        return part(OTHER_NAMES, "".join(f"<p>{some(int(rng.integers(1, 5)))}</p>" for _ in range(int(rng.integers(1, 4)))))

    # parts between the article's blocks too
    blocks = re.split(r"(?=<p\b)", inner)
    for _ in range(int(rng.integers(0, 3))):
        blocks.insert(int(rng.integers(1, len(blocks) + 1)), other())
    tag, attributes = MAIN_NAMES[int(rng.integers(len(MAIN_NAMES)))]
    bare = rng.integers(8) == 0  # the article's blocks right in the page
    before, after = ("".join(other() for _ in range(int(rng.integers(1, 5)))) for _ in range(2))
    body = f'{before}<{tag} data-main="1" {attributes}>{"".join(blocks)}</{tag}>{after}'
    if bare:
        body = before + "".join(re.sub(r"^(\s*)<(p|h1)\b", r'\1<\2 data-main="1"', b) for b in blocks) + after
    if rng.integers(2):
        body = f'<div class="{["page", "wrapper", "container"][int(rng.integers(3))]}">{body}</div>'
    return f"<html><head><title>x</title></head><body>{body}</body></html>"


def _labels(nodes: list[Node]) -> np.ndarray:
    """1 for nodes that hold main text: leaves by the nearest labelled ancestor (an element named as something
    else within an article is not main), elements if they hold such a leaf."""
    label, inside = [False] * len(nodes), [0] * len(nodes)
    for k in range(1, len(nodes)):
        n = nodes[k]
        other = n.tag in NOT_MAIN_TAGS or not NOT_MAIN.isdisjoint(n.tokens)
        label[k] = n.label if n.label is not None else label[n.parent] and not other
    for k in range(len(nodes) - 1, 0, -1):
        inside[k] += label[k] and nodes[k].text is not None
        inside[nodes[k].parent] += inside[k]
    return np.array([i > 0 for i in inside[1:]], dtype=float)


def fit(pages: list[str]) -> dict | None:
    """The boosted trees from pages with a marked article; None if there is none."""
    rng = np.random.default_rng(5)
    xs, ys = [], []
    for page in pages:
        m = _ARTICLE.search(page or "")
        if not m:
            continue
        marked = page[:m.start()] + f'<{m.group(1)} data-main="1"' + page[m.start() + 1 + len(m.group(1)):]
        for p in (marked, *[_rearranged(page, m.group(2), rng) for _ in range(VARIANTS)]):
            nodes = parse(p)
            if len(nodes) > 1:
                xs.append(features(nodes))
                ys.append(_labels(nodes))
    if not xs or len(np.unique(np.concatenate(ys))) < 2:
        return None
    return boost(np.concatenate(xs), np.concatenate(ys))


def _fit_group(rows: pa.Table) -> pa.Table:
    model = fit(rows.sort_by([("h", "ascending"), ("page_id", "ascending")]).column("html").to_pylist())
    if model is None:
        return pa.table({k: pa.array([], t) for k, t in (("base", pa.float64()), ("feature", pa.list_(pa.int32())), ("limit", pa.list_(pa.float64())), ("value", pa.list_(pa.float64())))})
    return pa.table({"base": pa.array([model["base"]]), "feature": pa.array([model["feature"].ravel().tolist()], pa.list_(pa.int32())),
                     "limit": pa.array([model["limit"].ravel().tolist()]), "value": pa.array([model["value"].ravel().tolist()])})


def train(pages: DataFrame, sample: int = SAMPLE) -> dict | None:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where("html IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("page_id", F.length("html"))).orderBy("h", "page_id").limit(sample)
    got = rows.groupBy(F.lit(0).alias("one")).applyInArrow(lambda t: _fit_group(t), "base double, feature array<int>, limit array<double>, value array<double>").collect()
    if not got:
        return None
    trees = len(got[0]["value"]) // 2 ** DEPTH
    return {"base": got[0]["base"], **{k: np.array(got[0][k]).reshape(trees, -1) for k in ("feature", "limit", "value")}}


def _plain(nodes: list[Node]) -> np.ndarray:
    """Without a model: everything outside elements that never hold main text."""
    bad = {"nav", "header", "footer", "aside", "form"}
    out = [False]
    for n in nodes[1:]:
        out.append(out[n.parent] or n.tag in bad)
    return np.where(out[1:], -9.0, 9.0)


def extract(pages: list[str | None], model: dict | None) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p or "") for p in pages]
    x = [features(n) for n in parsed]
    z = margins(np.concatenate(x), model) if model and x else None
    out, at = [], 0
    for nodes in parsed:
        out.append(decode(nodes, _plain(nodes) if z is None else z[at:at + len(nodes) - 1]))
        at += len(nodes) - 1
    return out


def main_texts(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, sample))

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, CHUNK):
                part = b.slice(a, CHUNK)
                texts = extract(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


@register("op2_html")
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
