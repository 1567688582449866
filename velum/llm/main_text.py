"""Main text of web pages by a graphical model over the tree of the page.

Every node of a page is content or not. A node has a potential from its features (tag,
words in its names, length, links, punctuation), and each edge one that couples a child
with its parent. Messages go from the leaves to the root and back (sum-product), which on
a tree gives exact marginals; blocks of text whose marginal is one half or more are kept.
Weights maximise the likelihood of labelled pages, by gradients from the same marginals.

Pages are labelled by their own markup, where exactly one ``article`` (or ``main``) names
the content, in a sample of bounded size, and by a few pages that come with the library."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.arrays import pieces
from velum.llm.dom import Page, read_page
from velum.llm.labelled_pages import PAGES
from velum.llm.shared import col, fraction

# Tags with a feature of their own, and words in names with what they stand for.
TAGS = (
    "#page #text html body nav header footer aside article main section div p h1 h2 h3 h4 ul ol li dl table tr td"
    " form button select label textarea fieldset blockquote pre figure figcaption address details dialog menu"
).split()
WORDS = {
    "nav": "nav navbar navigation menu topnav breadcrumb breadcrumbs toolbar pagination pager tabs toc",
    "header": "header masthead top topbar logo branding",
    "footer": "footer foot bottom colophon copyright imprint legal",
    "side": "sidebar side aside widget widgets rail column",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense teaser",
    "comment": "comment comments respond reply replies disqus discussion reader readers feedback",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning privacy",
    "form": "form subscribe newsletter signup login search register contentinfo",
    "share": "share sharing social follow twitter facebook like likes buttons",
    "related": "related recommended more popular trending also latest tags tagged meta byline author",
    "content": "article content main post entry body story text page single articlebody maincontent",
}
ROLES = {w: k for k, names in WORDS.items() for w in names.split()}
APART = frozenset("nav aside footer form button select textarea label menu dialog".split())
NOT_CONTENT = frozenset(WORDS) - {"content", "header", "related"}
SAMPLE_PAGES, SAMPLE_CHARS = 400, 200_000
BATCH = 1 << 20
END_MARKS = ".,;:!?"


def _names() -> list[str]:
    out = ["always", "other tag", "inside", "inside apart"]
    out += [f"tag {t}" for t in TAGS] + [f"under {t}" for t in TAGS]
    out += [f"role {r}" for r in WORDS] + [f"role above {r}" for r in WORDS]
    for kind in ("text", "node"):
        out += [f"{kind} length {k}" for k in range(8)] + [f"{kind} links {k}" for k in range(3)]
        out += [f"{kind} marks {k}" for k in range(3)]
    return out


FEATURES = {name: k for k, name in enumerate(_names())}
EDGES = 3


def _bin(n: int) -> int:
    """The length in powers of four."""
    return min(7, n.bit_length() // 2)


def _roles(attributes: dict) -> set[str]:
    names = " ".join(attributes[k] for k in ("class", "id", "role") if k in attributes)
    if not names:
        return set()
    words = re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", names).lower())
    return {ROLES[w] for w in words if w in ROLES}


@dataclass
class Forest:
    """Nodes of some pages: parents (-1 for roots), depths, kinds of the edges above, and
    the features as pairs (``row``, ``feature``)."""

    parent: np.ndarray
    depth: np.ndarray
    edge: np.ndarray
    row: np.ndarray
    feature: np.ndarray
    first: np.ndarray


@lru_cache(1 << 16)
def _structure(tag: str, under: str, own: frozenset, above: frozenset, inside: bool, apart: bool) -> tuple:
    """Features of a node that do not depend on its text, and the kind of its edge."""
    f = FEATURES
    found = [f["always"], f.get(f"tag {tag}", f["other tag"])] + [f[f"role {r}"] for r in own]
    if under:
        found.append(f.get(f"under {under}", f["other tag"]))
    found += [f[f"role above {r}"] for r in above] + [f["inside"]] * inside + [f["inside apart"]] * apart
    edge = 0 if tag == "#text" else 2 if own or tag in APART or tag in ("header", "article", "main") else 1
    return tuple(found), edge


def _measures() -> dict:
    """Features by kind of node: for lengths, for the share of links, for punctuation."""
    return {
        kind: [[FEATURES[f"{kind} {what} {k}"] for k in range(n)] for what, n in (("length", 8), ("links", 3), ("marks", 3))]
        for kind in ("text", "node")
    }


MEASURES = _measures()


def forest(pages: list[Page]) -> Forest:
    parent, depth, edge, counts, feature, first = [], [], [], [], [], [0]
    none = frozenset()
    for page in pages:
        n, base = len(page.tag), first[-1]
        length = [len(t) for t in page.text]
        linked = list(page.linked)
        marks = [sum(map(t.count, END_MARKS)) if t else 0 for t in page.text]
        for v in range(n - 1, 0, -1):
            if length[v]:
                p = page.parent[v]
                length[p] += length[v]
                linked[p] += linked[v]
                marks[p] += marks[v]
        inside, apart, own, above, level = [False] * n, [False] * n, [none] * n, [none] * n, [0] * n
        for v, (tag, p) in enumerate(zip(page.tag, page.parent)):
            if page.attributes[v]:
                own[v] = frozenset(_roles(page.attributes[v]))
            under = ""
            if p >= 0:
                under = page.tag[p]
                level[v] = level[p] + 1
                inside[v] = inside[p] or under == "article" or under == "main"
                apart[v] = apart[p] or under in APART
                above[v] = above[p] | own[p] if own[p] else above[p]
            found, kind = _structure(tag, under, own[v], above[v], inside[v], apart[v])
            lengths, links, rates = MEASURES["text" if tag == "#text" else "node"]
            feature += found
            feature.append(lengths[_bin(length[v])])
            if length[v]:
                share, rate = linked[v] / length[v], 40 * marks[v] / length[v]
                feature.append(links[0 if share < 0.2 else 1 if share < 0.6 else 2])
                feature.append(rates[0 if rate < 0.3 else 1 if rate < 1 else 2])
            counts.append(len(found) + (3 if length[v] else 1))
            edge.append(kind)
            parent.append(p + base if p >= 0 else -1)
        depth += level
        first.append(base + n)
    row = np.repeat(np.arange(len(counts)), np.array(counts, "i8"))
    return Forest(*(np.array(x, "i8") for x in (parent, depth, edge, row, feature, first)))


@dataclass
class Model:
    """Weights of the features, and the potentials of an edge by kind, label of the parent
    and label of the child."""

    node: np.ndarray
    edge: np.ndarray


def marginals(trees: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each node to be content, and of the labels of each edge (parent,
    child), from messages up and down the trees."""
    n = len(trees.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(trees.row, model.node[trees.feature], n)
    pair = model.edge[trees.edge]
    up, above, sent = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2))
    order = np.argsort(trees.depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(trees.depth[order])) + 1)[1:]
    for nodes in reversed(levels):
        sent[nodes] = np.logaddexp.reduce((own[nodes] + up[nodes])[:, None, :] + pair[nodes], axis=2)
        for y in (0, 1):
            up[:, y] += np.bincount(trees.parent[nodes], sent[nodes, y], n)
    for nodes in levels:
        p = trees.parent[nodes]
        rest = own[p] + above[p] + up[p] - sent[nodes]
        above[nodes] = np.logaddexp.reduce(rest[:, :, None] + pair[nodes], axis=1)
    belief = own + up + above
    one = 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    p = np.maximum(trees.parent, 0)
    both = (own[p] + above[p] + up[p] - sent)[:, :, None] + pair + (own + up)[:, None, :]
    both = np.exp(both - np.logaddexp.reduce(both.reshape(n, 4), axis=1)[:, None, None])
    both[trees.parent < 0] = 0.0
    return one, both


def fit(trees: Forest, labels: np.ndarray, weight: np.ndarray, rounds: int = 150, rate: float = 0.1) -> Model:
    """Weights of the greatest penalised likelihood, by adaptive gradient steps. ``weight``
    is that of the page of each node."""
    model = Model(np.zeros(len(FEATURES)), np.zeros((EDGES, 2, 2)))
    inner = np.flatnonzero(trees.parent >= 0)
    p, edge = trees.parent[inner], trees.edge[inner]
    seen = np.zeros((len(labels), 2, 2))
    seen[inner, labels[p], labels[inner]] = 1.0
    total = weight[trees.first[:-1]].sum()
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (model.node, model.edge)]
    for step in range(1, rounds + 1):
        one, both = marginals(trees, model)
        off = weight * (labels - one)
        slope = np.bincount(trees.feature, off[trees.row], len(FEATURES)) / total - 1e-3 * model.node
        missed = weight[inner, None, None] * (seen - both)[inner]
        turn = np.array([missed[edge == e].sum(0) for e in range(EDGES)])
        for x, g, (m, s) in zip((model.node, model.edge), (slope, turn / total - 1e-3 * model.edge), state):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


def marked_labels(page: Page) -> np.ndarray:
    """Labels from ``data-main`` and ``data-not``; a page without any markup is all main."""
    labels = np.full(len(page.tag), int(all(t[0] == "#" for t in page.tag)))
    for v, a in enumerate(page.attributes):
        above = labels[page.parent[v]] if v else labels[0]
        labels[v] = 0 if "data-not" in a else 1 if "data-main" in a else above
    return labels


def markup_labels(page: Page) -> np.ndarray | None:
    """Labels from the only ``article``, else the only ``main``, without the parts of it
    whose tag or name says that they are something else; None for other pages."""
    for tag in ("article", "main"):
        roots = [v for v, t in enumerate(page.tag) if t == tag]
        if len(roots) == 1:
            labels = np.zeros(len(page.tag), "i8")
            for v in range(roots[0], len(page.tag)):
                own = page.tag[v] not in APART and not _roles(page.attributes[v]) & NOT_CONTENT
                labels[v] = v == roots[0] or (labels[page.parent[v]] and own)
            return labels
    return None


def fit_main_text(df: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES) -> Model:
    """A model from the library's pages and at most ``sample`` pages of ``df``: those with
    an ``article`` or ``main``, of 200,000 characters or fewer, with the least hashes."""
    text = col(html).cast("string")
    some = df.select(text.alias("html")).filter(
        (F.length("html") <= SAMPLE_CHARS) & F.col("html").rlike("(?i)<(article|main)[ >]")
    )
    # Few more than are needed leave their tasks, and equal pages come once.
    some = some.withColumn("h", fraction(F.col("html")))
    n = some.select("h").distinct().count()
    some = some.filter(F.col("h") < min(1.0, 2 * sample / max(1, n))).groupBy("h").agg(F.min("html").alias("html"))
    rows = some.orderBy("h").limit(sample).collect()
    pages, labels, weight = [], [], []
    for row in rows:
        page = read_page(row["html"])
        found = markup_labels(page)
        if found is not None:
            pages.append(page)
            labels.append(found)
    weight = [1.0] * len(pages)
    own = [read_page(x) for x in PAGES]
    # The library's pages weigh as much as all others.
    weight += [max(1.0, len(pages) / len(own))] * len(own)
    pages, labels = pages + own, labels + [marked_labels(p) for p in own]
    return fit(forest(pages), np.concatenate(labels), np.repeat(weight, [len(p.tag) for p in pages]))


def texts(pages: list[Page], model: Model) -> list[str]:
    """The blocks of each page that are content, joined by a blank."""
    if not pages:
        return []
    trees = forest(pages)
    one, _ = marginals(trees, model)
    out = []
    for page, first in zip(pages, trees.first):
        out.append(" ".join(t for v, t in enumerate(page.text) if t and one[first + v] >= 0.5))
    return out


def main_text(
    df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", model: Model | None = None
) -> DataFrame:
    """``page_id, url, text, n_chars``, one row per row of ``df``: the main text of each
    page, its blocks in order, white space inside a block as one blank.

    Null and empty pages, and those without content, have an empty text. Broken markup is
    read as far as it goes. Repeated rows give equal rows, an empty table none; other columns
    are not read. Without a ``model`` one is fitted (``fit_main_text``)."""
    model = fit_main_text(df, html) if model is None else model
    sent = df.sparkSession.sparkContext.broadcast(model)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", BATCH):
                found = texts([read_page(x or "") for x in part.column("html").to_pylist()], sent.value)
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": part.column("page_id"),
                        "url": part.column("url"),
                        "text": pa.array(found, pa.string()),
                        "n_chars": pa.array([len(t) for t in found], pa.int64()),
                    }
                )

    kind = dict(df.dtypes)[page_id]
    named = df.select(
        col(page_id).alias("page_id"), col(url).cast("string").alias("url"), col(html).cast("string").alias("html")
    )
    return named.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
