"""Operator 11: the reader, exact marginals, held-out pages, and the query against a plain cut of the article."""

import html
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansift.llm import dom, extraction, queries
from plansift.llm.layouts import labelled_pages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return extraction.train(spark.read.parquet(f"{SF}/pages.parquet"))


def runs(source):
    return [t for t in dom.read(source).text if t is not None]


@pytest.mark.parametrize(("source", "want"), [
    (None, []), ("", []), (" \n\t ", []), ("plain &amp; simple", ["plain & simple"]),
    ("<p>a<p>b <b>c</b>\n d", ["a", "b c d"]), ("<p><b>t<br><p>x</p>y", ["t", "x", "y"]),
    ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>z", ["1", "2", "3", "4", "z"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("a<script>var t='</p><p>no';</script>b<style>p{}</style><!-- c --><noscript>n</noscript>d", ["a b d"]),
    ("<title>no</title><p>yes", ["yes"]), ("<head><meta><body><p>in", ["in"]),
    ("<p>x</p><div hidden>no<div>no</div></div><p style='display: none'>no</p>y", ["x", "y"]),
    ("cut &amp", ["cut &"]), ("cut &am", ["cut &am"]), ("cut <a href='x", ["cut"]), ("cut <scr", ["cut"]), ("a < b > c", ["a < b > c"]),
    ("<script>open", []), ("<a title='a>b' href=\"x>y\">link</a>", ["link"]), ("</div></p>stray</b> ends", ["stray ends"]),
    ("&#233;&eacute;&nbsp;&lt;b&gt; &#x1F642;", ["éé <b> \U0001f642"]), ("<DIV>Upper</DIV><Br/>lower<hr>x", ["Upper", "lower", "x"]),
    ("a<!-- open comment", ["a"]), ("<svg><text>no</text></svg><button>no</button>b", ["b"]),
])
def test_reader(source, want):
    assert runs(source) == want


def test_reader_takes_any_depth_and_length():
    deep = "<div>" * 30_000 + "x" + "</section>" * 30_000
    assert runs(deep) == ["x"]
    long = "<p>word " * 50_000
    assert len(runs(long)) == 50_000
    assert len(runs("<b>" * 50_000 + "<p>a" * 10)) == 10


def test_marginals_equal_those_over_all_labellings():
    rng = np.random.default_rng(5)
    pages = [dom.read("<div><p>a b</p><ul><li>c<li>d</ul></div>e"), dom.read("<p>x</p>y")]
    trees = dom.forest(pages)
    model = extraction.Model(rng.normal(size=dom.N_FEATURES), rng.normal(size=(dom.EDGE_KINDS, 4)))
    found = extraction.sum_product(trees, model)
    n, score = len(trees.parent), model.node[trees.codes].sum(axis=1)
    total, content, pair = 0.0, np.zeros(n), np.zeros((n, 4))
    for labels in itertools.product((0, 1), repeat=n):
        x = np.array(labels)
        has = np.flatnonzero(trees.parent >= 0)
        at = 2 * x[trees.parent[has]] + x[has]
        weight = np.exp(score @ x + model.edge[trees.edge[has], at].sum())
        total += weight
        content += weight * x
        pair[has, at] += weight
    assert np.allclose(found.content, content / total) and np.allclose(found.pair, pair / total) and np.isclose(found.log_sum, np.log(total))


def test_layouts_not_seen_in_training(model):
    """Words in held-out layouts: at least 97 % of the article found, at least 97 % of what is found from the article."""
    hit = found = there = 0
    for source in labelled_pages(150, seed=77):
        page = dom.read(source)
        kept = {i for i, p in zip([i for i, t in enumerate(page.text) if t is not None], (p for _, p in extraction.blocks_of([source], model)[0]), strict=True) if p >= 0.5}
        for i, text in enumerate(page.text):
            n = len(text.split()) if text else 0
            hit, found, there = hit + n * (i in kept and page.label[i]), found + n * (i in kept), there + n * page.label[i]
    assert hit / found > 0.97 and hit / there > 0.97


BODY = ["The council met on Tuesday evening, and the vote was closer than most had expected.", "Short.", "It will return to the question in spring, when the figures for the year are known."]
ARTICLE = "<h1>A vote</h1>" + "".join(f"<p>{x}</p>" for x in BODY)
AROUND = (
    '<div id="cookie-consent"><p>We use cookies to improve your visit. By going on you accept them, as our policy says.</p><button>OK</button></div>'
    '<header class="site-header"><a href="/">The Daily</a><ul class="menu"><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li></ul></header>',
    '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten things to see</a></li><li><a href="/2">What comes next</a></li></ul></aside>'
    '<section id="comments"><h3>Comments</h3><div class="comment"><p>I think this is wrong, and the council should have asked us first.</p></div></section>'
    '<form><label>Mail</label><input><p>Get our letter every week, free of charge.</p></form><footer><p>&copy; The Daily. All rights reserved.</p></footer>')


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="article-body">{}</div>', "<div>{}</div>"])
def test_hand_written_pages(model, shell):
    source = f"<html><body>{AROUND[0]}{shell.format(ARTICLE)}{AROUND[1]}</body></html>"
    assert [t for t, p in extraction.blocks_of([source], model)[0] if p >= 0.5] == ["A vote", *BODY]


def _article(source):
    """The given pages hold one article, whose tags break blocks unless they are inline."""
    found = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", found[1])) if found else []
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*$", "", b)).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_against_a_plain_cut(spark, sf):
    got = sorted(tuple(r) for r in queries.op11_html_extraction(spark, sf).collect())
    want = [(r.page_id, r.url, t := _article(r.html), len(t)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert got == sorted(want)


def test_extraction_edges(spark, model):
    good = f"<body><nav><a href=x>Home</a></nav><article>{ARTICLE}</article></body>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", good), (4, "u", good), (4, "u", good), (None, None, None), (5, "u", "<script>"), (6, "u", "<article>" + "<p>long words here. </p>" * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("text", "n_chars", "blocks", "u", "label"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = {(r.page_id, r.url): r for r in extraction.extract(pages, model).collect()}
    assert got[1, "u"].text == got[2, None].text == got[None, None].text == got[5, "u"].text == ""
    assert got[None, "u"].text == got[4, "u"].text == "\n".join(["A vote", *BODY])
    assert got[6, "u"].n_chars == 40_000 * 17 - 1
    assert extraction.extract(pages, model).filter("page_id = 4").count() == 2
    empty = pages.filter("1 = 0")
    assert extraction.extract(empty, extraction.train(empty, layouts=40)).count() == 0
