import html as entities
import itertools
import random
import re

import numpy as np
import pytest

from velum.llm import labelled_pages as parts
from velum.llm import main_text as module
from velum.llm.dom import read_page
from velum.llm.labelled_pages import PAGES
from velum.llm.main_text import Model, fit_main_text, forest, main_text, marginals, texts

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def by_markup(html):
    """The article of a page of the given tables, cut out of its markup."""
    inside = html[html.index("<article>") + 9 : html.index("</article>")]
    inside = re.sub("</?b>", "", inside)
    return " ".join(entities.unescape(re.sub("<[^>]*>", " ", inside)).split())


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return fit_main_text(pages)


def test_tables(pages, model):
    whole = {r["page_id"]: r["html"] for r in pages.collect()}
    found = main_text(pages, model=model).collect()
    assert len(found) == len(whole)
    for r in found:
        assert r["text"] == by_markup(whole[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_other_layouts(model):
    """Pages put together from other sentences and names than the labelled ones."""
    body = "".join(f"<p>Paragraph {k} of the story says, among other things, that {k} boats had left.</p>" for k in range(5))
    want = " ".join(f"Paragraph {k} of the story says, among other things, that {k} boats had left." for k in range(5))
    beside = [
        '<ul class="navbar"><li><a href="/">One</a></li><li><a href="/">Two</a></li></ul>',
        '<div class="promo">Order before Sunday and pay half.</div>',
        '<div id="siteFooter" class="footer">All rights reserved, 2020.</div>',
        '<aside class="rail"><p>Popular now: a longer piece on roofs.</p></aside>',
        '<div class="cookie-notice"><p>Cookies help us. Accept them?</p></div>',
        '<form class="newsletter"><p>Get the letter every Monday, for free.</p></form>',
        '<ol class="comment-list"><li>I liked it, thanks for sharing.</li><li>So did I.</li></ol>',
    ]
    rnd = random.Random(2)
    for main in ('<article>{}</article>', '<main>{}</main>', '<div class="entry post">{}</div>', '<section id="story">{}</section>'):
        for _ in range(5):
            some = rnd.sample(beside, 4)
            page = f"<html><body>{some[0]}{some[1]}{main.format(body)}{some[2]}{some[3]}</body></html>"
            assert texts([read_page(page)], model) == [want], page


def test_inside_an_article(model):
    page = f"<body>{parts.HEADER}<article><h1>Title</h1>{parts.P}{parts.ADVERT}{parts.SHORT}{parts.COMMENTS}</article>{parts.FOOT}"
    assert texts([read_page(page)], model) == [" ".join(["Title", *parts.SENTENCES, parts.SENTENCES[1]])]


def test_marginals_are_those_of_all_labellings():
    rnd = np.random.default_rng(1)
    trees = forest([read_page("<div><p>One, two.</p><ul><li>x<li>y</ul></div><p>z</p>")])
    n = len(trees.parent)
    model = Model(rnd.normal(size=len(module.FEATURES)), rnd.normal(size=(3, 2, 2)))
    own = np.bincount(trees.row, model.node[trees.feature], n)
    total, one, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        weight = sum(own[v] for v in range(n) if labels[v])
        for v in range(1, n):
            weight += model.edge[trees.edge[v], labels[trees.parent[v]], labels[v]]
        weight = np.exp(weight)
        total += weight
        one += weight * np.array(labels)
        for v in range(1, n):
            both[v, labels[trees.parent[v]], labels[v]] += weight
    found, pairs = marginals(trees, model)
    assert np.allclose(found, one / total) and np.allclose(pairs, both / total)


def test_reading():
    page = read_page("<p>a &lt;b&gt; <b>bo</b>ld  &amp x<br>y<script>no <p></script><ul><li>u<li>v</ul></p>t<!-- c --> &#x41; &am")
    assert [t for t in page.text if t] == ["a <b> bold & x y", "u", "v", "t A &am"]
    page = read_page("<head><title>T</title><p>text<table><tr><td>1<td>2<tr><td>3</table></span></div>")
    assert [t for t in page.text if t] == ["text", "1", "2", "3"]


def test_awkward_rows(spark, model):
    long = "<article>" + "<p>A sentence, and one more.</p>" * 20_000 + "</article>"
    rows = [
        (1, None, None), (1, "u", ""), (None, "u", "   "), (2, "u", "no markup, but words. Enough of them, one would think."),
        (3, "u", "<" * 500 + "<p" + "</p>" * 300), (4, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (5, "u", long), (5, "u", long),
        (6, "u", "<script>var a = '<p>x</p>'"), (7, "u", "<!DOCTYPE html><!-- <p>x</p> -->"),
    ]
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA).repartition(3)
    found = main_text(df, model=model).collect()
    assert len(found) == len(rows)
    by_id = {(r["page_id"], r["url"]): r for r in found}
    assert by_id[1, None]["text"] == by_id[1, "u"]["text"] == by_id[None, "u"]["text"] == by_id[7, "u"]["text"] == ""
    assert by_id[5, "u"]["n_chars"] == len(" ".join(["A sentence, and one more."] * 20_000))
    assert by_id[2, "u"]["text"].startswith("no markup")
    assert main_text(df.limit(0)).count() == 0
    assert main_text(df, model=model).columns == ["page_id", "url", "text", "n_chars"]


def test_labelled_pages_fit(model):
    for page in map(read_page, PAGES):
        one, _ = marginals(forest([page]), model)
        labels = module.marked_labels(page)
        assert all((one[v] >= 0.5) == labels[v] for v, t in enumerate(page.text) if t)
