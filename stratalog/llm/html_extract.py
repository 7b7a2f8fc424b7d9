"""Operator 4, HTML extraction: gradient-boosted trees over DOM nodes, decoded down the tree.

A page is read into a tree of block elements; inline markup belongs to the block around it. Each node is described
by its subtree (text, density, links, punctuation), its attribute tokens and those above it, its depth and its
siblings. Boosted trees give each node the log odds of holding main text; decoding keeps the set of nodes with the
largest sum in which every kept node's parent is kept, so no choice contradicts one above or below it.

Training: about ``TRAIN_PAGES`` pages of the corpus, never more than twice as many, labelled by their own semantic elements, and the same texts
laid out again in generated templates whose parts are known. The fit is small and runs once; every page is scored.

Defined cases: null and empty pages have an empty text; broken and cut-off markup is read as far as it goes;
equal pages are extracted alike; an empty table gives no row; a corpus without any semantic element trains on
generated layouts of its longest blocks; other columns are not carried.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .encode import chunks

#: Pages that the trees are fitted on, and layouts generated out of each.
TRAIN_PAGES = 300
LAYOUTS = 3
TREES = 60
DEPTH = 4
RATE = 0.25
BINS = 32

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template title textarea svg math iframe object canvas select option button audio video datalist".split())
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}
#: Blocks that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul p".split())
BOILER_TAGS = frozenset("nav aside footer header form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_TOKENS = frozenset("article content main post entry story body text prose page single blog hentry".split())
BOILER_TOKENS = frozenset(
    "ad ads advert advertisement adverts banner bar breadcrumb breadcrumbs byline comment comments cookie cookies copyright discussion disqus dropdown foot footer form gdpr head header legal links login"
    " masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup privacy promo promoted recommended related replies reply search share sharing side sidebar signup social"
    " sponsor sponsored subscribe tags teaser toolbar topbar tracking trending widget".split()
)
SKIP = -1

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {k: re.compile(rf"</{k}\b[^>]*>", re.IGNORECASE) for k in HIDDEN}
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "parent", "depth", "children", "tokens", "blocks", "chars", "linked", "marks")

    def __init__(self, tag: str, parent: int, depth: int, tokens: tuple[str, ...]):
        self.tag, self.parent, self.depth, self.tokens = tag, parent, depth, tokens
        self.children: list[int] = []
        self.blocks: list[tuple[int, str]] = []  # place in the page, text
        self.chars = self.linked = self.marks = 0


def _tokens(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(t.lower() for m in _ATTRIBUTE.finditer(attributes) for t in _TOKEN.findall(html.unescape(m[1] or m[2] or m[3] or "")))


def parse(source: str) -> list[Node]:
    """Block nodes, parents before children; node 0 is the page."""
    nodes = [Node("#page", -1, 0, ())]
    stack, open_links, at, place = [0], 0, 0, 0
    pieces: list[str] = []

    def flush() -> None:
        nonlocal place
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                node = nodes[stack[-1]]
                node.blocks.append((place, text))
                node.chars += len(text)
                node.marks += len(_PUNCTUATION.findall(text))
                place += 1

    def close(tags: set[str] | frozenset[str], within: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in tags:
                del stack[k:]
                return
            if tag in within:
                return

    borders = frozenset("table ul ol dl".split())
    while True:
        m = _TAG.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text:
            pieces.append(text)
            if open_links:
                nodes[stack[-1]].linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        ending, tag = (m[1] or m[4]) == "/", name.lower()
        if tag in INLINE:
            if tag == "a":
                open_links = max(0, open_links + (-1 if ending else 1))
            continue
        if tag in HIDDEN:
            if not ending and not (m[3] or m[6] or "").endswith("/"):
                end = _END[tag].search(source, at)
                at = end.end() if end else len(source)
            continue
        flush()
        if ending:
            close({tag}, frozenset())
        elif tag not in VOID:
            open_links = 0
            if tag in CLOSES:
                close(CLOSES[tag], borders)
            if tag in ENDS_P:
                close({"p"}, borders)
            parent = stack[-1]
            nodes[parent].children.append(len(nodes))
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, _tokens(m[3] or m[6] or "")))
            stack.append(len(nodes) - 1)
    flush()
    return nodes


FEATURES = 30


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node, in the order of ``parse``."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    own = np.array([x.chars for x in nodes], float)
    # Sums over subtrees: size, text, linked text, punctuation, paragraphs.
    sub = np.stack([np.ones(n), own, [min(x.linked, x.chars) for x in nodes], [x.marks for x in nodes], [x.tag == "p" for x in nodes]]).astype(float)
    for i in range(n - 1, 0, -1):
        sub[:, parent[i]] += sub[:, i]
    size, text, linked, marks, paragraphs = sub
    plus = np.array([sum(t in MAIN_TOKENS for t in x.tokens) for x in nodes], float)
    minus = np.array([sum(t in BOILER_TOKENS for t in x.tokens) for x in nodes], float)
    boiler = np.array([x.tag in BOILER_TAGS for x in nodes], float)
    main = np.array([x.tag in MAIN_TAGS for x in nodes], float)
    lists = np.array([x.tag in ("ul", "ol", "li", "dl", "dd", "dt") for x in nodes], float)
    above = np.zeros((5, n))
    for i in range(1, n):
        p = parent[i]
        above[:, i] = above[:, p] + (plus[p], minus[p], boiler[p], main[p], lists[p])
    place, count, mean = np.zeros(n), np.ones(n), np.zeros(n)
    for x in nodes:
        if x.children:
            c = x.children
            place[c] = np.arange(len(c)) / len(c)
            count[c] = len(c)
            mean[c] = text[c].mean()
    up = np.maximum(parent, 0)
    tag = [x.tag for x in nodes]
    is_ = lambda *names: np.array([t in names for t in tag], float)
    rows = [
        np.log1p(own), np.log1p(text), text / size, linked / np.maximum(text, 1), np.array([x.linked for x in nodes]) / np.maximum(own, 1), [x.depth for x in nodes], [len(x.children) for x in nodes],
        place, count, np.log1p(mean), text / np.maximum(text[up], 1), text / max(text[0], 1), marks / np.maximum(text, 1), paragraphs, np.log1p(size),
        plus, minus, boiler, main, *above, is_("p"), is_("h1", "h2", "h3", "h4", "h5", "h6"), lists, is_("table", "tr", "td", "th", "tbody"), is_("div", "section"), is_("body", "html", "#page"),
    ]
    return np.stack([np.asarray(r, float) for r in rows], axis=1)


# Boosted trees


class Trees:
    """Logistic gradient boosting with histogram splits; full binary trees of one depth, so scoring is array lookups."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.depth = depth
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        code = self._codes(x)
        base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, total = float(np.log(base / (1 - base))), np.full(len(y), 0.0)
        total += self.base
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            feature, cut, at = self._grow(code, y - p, p * (1 - p))
            g, h = np.bincount(at, y - p, 1 << depth), np.bincount(at, p * (1 - p), 1 << depth)
            leaf = rate * g / (h + 1.0)
            total += leaf[at]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def _grow(self, code: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feature, cut = np.zeros((1 << self.depth) - 1, int), np.full((1 << self.depth) - 1, BINS)
        at = np.zeros(len(code), int)
        for level in range(self.depth):
            width, first = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-6)
            for f in range(code.shape[1]):
                key = at * BINS + code[:, f]
                g, h = (np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (grad, hess))
                gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better], cut[first : first + width][better] = f, k[better]
            at = 2 * at + (code[np.arange(len(code)), feature[first + at]] > cut[first + at])
        return feature, cut, at

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        code, out, row = self._codes(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for level in range(self.depth):
                k = (1 << level) - 1 + at
                at = 2 * at + (code[row, feature[k]] > cut[k])
            out += leaf[at]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the best sum of log odds in which a kept node's parent is kept. The page itself stays."""
    gain = np.clip(odds, -6, 6) * np.log2([2 + x.chars for x in nodes])
    best = gain.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and best[i] > 0
    return keep


def text_of(nodes: list[Node], keep: np.ndarray) -> str:
    return " ".join(t for _, t in sorted(b for x, k in zip(nodes, keep, strict=True) if k for b in x.blocks))


# Labelled pages


def own_labels(nodes: list[Node]) -> np.ndarray | None:
    """1 for nodes inside a semantic main element or above one, without boilerplate inside; None if there is none."""
    label = np.zeros(len(nodes), int)
    for i, x in enumerate(nodes):
        up = label[x.parent] if i else 0
        label[i] = 0 if x.tag in BOILER_TAGS and x.tag != "header" else 1 if x.tag in MAIN_TAGS or up else 0
    if not label.any():
        return None
    for i in range(len(nodes) - 1, 0, -1):
        label[nodes[i].parent] |= label[i]
    return label


def layout(r: np.random.Generator, main: list[str], other: list[str]) -> str:
    """A page in a random layout; every block of the main text carries data-main, which labels it and is cut off."""
    esc, pick = html.escape, lambda *x: x[r.integers(len(x))]
    some = lambda n: " ".join(other[r.integers(len(other))] for _ in range(n))
    few = lambda: esc(" ".join(some(1).split()[: r.integers(1, 6)]))
    name = lambda *x: (f' {pick("class", "id", "class")}="{pick("", "", "site-", "c-", "js-")}{pick(*x)}{pick("", "", "-wrap", "__inner", " x1")}"' if r.random() < 0.96 else "")
    links = lambda: "".join(f'<li><a href="#">{few()}</a></li>' for _ in range(r.integers(2, 9)))
    sentence = lambda: esc(some(1)[: r.integers(30, 260)])

    def block(*names: str, tags: tuple[str, ...] = ("div", "section"), inner: str | None = None) -> str:
        tag = pick(*tags)
        return f"<{tag}{name(*names)}>{inner if inner is not None else pick('<p>', '<div>', '') + sentence()}</{tag}>"

    menu = lambda: block("nav", "menu", "navbar", "navigation", "breadcrumb", tags=("nav", "div", "nav"), inner=f"<ul>{links()}</ul>")
    top = lambda: block("header", "masthead", "topbar", tags=("header", "div"), inner=f"<h{pick(1, 2)}>{few()}</h1>" + (menu() if r.random() < 0.5 else f"<p>{few()}</p>"))
    side = lambda: block("sidebar", "side", "widget", "related", "trending", tags=("aside", "div"), inner=f"<h3>{few()}</h3><ul>{links()}</ul>" + (f"<p>{sentence()}</p>" if r.random() < 0.5 else ""))
    foot = lambda: block("footer", "foot", "copyright", "legal", tags=("footer", "div", "footer"), inner=f"{pick('&copy; ', '')}{sentence()}")
    notice = lambda: block("cookie-notice", "notice", "banner", "gdpr", "newsletter", "popup", tags=("div", "section", "aside"), inner=f"<p>{sentence()}</p>")
    advert = lambda: block("ad", "ads", "advert", "sponsored", "promo", "ad-banner", tags=("div", "aside", "section"))
    form = lambda: f"<form{name('search', 'subscribe', 'login', 'signup')}><label>{few()}</label><input name=q><p>{few()}</p></form>"
    talk = lambda: block("comments", "comment-list", "discussion", "replies", "disqus", inner=f"<h3>{few()}</h3>" + "".join(f"<{t}{name('comment', 'reply')}><p><b>{few()}</b></p><p>{sentence()}</p></{t}>" for t in [pick("div", "article", "li", "div")] * r.integers(1, 7)))
    extras = (advert, notice, side, form, talk)
    body, inside = [], []
    for i, text in enumerate(main):
        tag = "h1" if i == 0 and r.random() < 0.6 else pick("p", "p", "p", "p", "p", "h2", "blockquote", "li", "div", "td") if len(text) > 3 else "p"
        words = esc(text).split(" ")
        if len(words) > 4 and r.random() < 0.3:
            k = int(r.integers(len(words)))
            words[k] = pick(f"<b>{words[k]}</b>", f'<a href="#">{words[k]}</a>', f"<em>{words[k]}</em>")
        line = f"<{tag} data-main>{' '.join(words)}</{tag}>"
        inside.append(f"<ul>{line}</ul>" if tag == "li" else f"<table><tr>{line}</tr></table>" if tag == "td" else line)
        if r.random() < 0.05:
            inside.append(pick(*extras)())
    holder = pick(("article", ""), ("article", name("post", "entry", "story")), ("main", ""), ("div", name("content", "article-body", "post-content", "entry", "main", "story")), ("section", name("content", "story", "text")), ("div", ""))
    inner = f"<{holder[0]}{holder[1]}>{''.join(inside)}</{holder[0]}>"
    for _ in range(r.integers(0, 3)):
        inner = f"<{pick('div', 'main', 'div')}{name('container', 'wrapper', 'content', 'page', 'main', 'layout', 'row')}>{(side() if r.random() < 0.3 else '') + inner + (pick(talk, side, advert)() if r.random() < 0.3 else '')}</div>"
    for make, chance in ((top, 0.5), (menu, 0.7), (notice, 0.4), (advert, 0.4), (form, 0.2)):
        if r.random() < chance:
            body.append(make())
    body.append(inner)
    for make, chance in ((talk, 0.3), (side, 0.4), (advert, 0.3), (form, 0.2), (notice, 0.2), (foot, 0.8)):
        if r.random() < chance:
            body.append(make())
    return f"<html><head><title>{few()}</title></head><body>{''.join(body)}</body></html>"


_MARKED = re.compile(r" data-main>")


def layout_labels(page: str) -> tuple[list[Node], np.ndarray]:
    nodes = parse(_MARKED.sub(' class="datamain">', page))
    label = np.array(["datamain" in x.tokens for x in nodes], int)
    for x in nodes:
        x.tokens = tuple(t for t in x.tokens if t != "datamain")
    for i in range(len(nodes) - 1, 0, -1):
        label[nodes[i].parent] |= label[i]
    return nodes, label


def train(pages: list[str], layouts: int = LAYOUTS, trees: int = TREES) -> Trees:
    """Fit on a bounded list of pages."""
    r = np.random.default_rng(17)
    parsed = [parse(p) for p in pages if p]
    texts = [[t for x in nodes for _, t in x.blocks if len(t) > 20] for nodes in parsed]
    pool = [t for x in texts for t in x] or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit."]
    rows, labels = [], []
    for nodes, own in zip(parsed, texts, strict=True):
        label = own_labels(nodes)
        if label is not None:  # twice, since they are what they are and layouts are made up
            rows += [features(nodes)] * 2
            labels += [label] * 2
        for _ in range(layouts):
            k = int(r.integers(1, 14))
            main = [pool[r.integers(len(pool))][: int(r.choice([15, 40, 120, 300, 2000]))] for _ in range(k)] if len(own) < 3 or r.random() < 0.5 else own[:k]
            got, label = layout_labels(layout(r, main, pool))
            rows.append(features(got))
            labels.append(label)
    if not rows:
        got, label = layout_labels(layout(r, pool[:1], pool))
        rows, labels = [features(got)], [label]
    return Trees(np.concatenate(rows), np.concatenate(labels).astype(float), trees)


def extract_page(source: str, model: Trees) -> str:
    nodes = parse(source)
    return text_of(nodes, decode(nodes, model.log_odds(features(nodes))))


def _run(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in chunks(batches, "html"):
            parsed = [parse(x) for x in sources]
            odds = model.value.log_odds(np.concatenate([features(x) for x in parsed]))
            at, out = 0, []
            for nodes in parsed:
                out.append(text_of(nodes, decode(nodes, odds[at : at + len(nodes)])))
                at += len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, sample: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text of every page."""
    spark = pages.sparkSession
    # About ``sample`` rows by the hash of their ids, never more than twice that.
    total = max(1, pages.count())
    chosen = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(total)) < sample).select("html").limit(2 * sample).collect()
    model = spark.sparkContext.broadcast(train([r["html"] for r in chosen]))
    return pages.select("page_id", "url", "html").mapInArrow(_run(model), "page_id long, url string, text string")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
