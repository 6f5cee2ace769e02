"""Main text: minimum cuts against all labellings, pages of many makes with a known article, broken markup, odd rows."""

import itertools
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from photolake.llm import dom
from photolake.llm import main_text as T

COLUMNS = "page_id long, url string, html string, key_ string, url_ string, html_ string, text string"
SF = "/root/testdata/sf0.001"
A = "The harvest was late this year, and the growers of the valley had to wait for the rain to end."
B = "Yes."
C = "By the end of October, most of the fruit had been picked; what was left went to the press, where it was turned into juice."


def brute(prefers, edges):
    """The smallest set of nodes among those of least cost."""
    best = None
    for labels in itertools.product((False, True), repeat=len(prefers)):
        cost = sum(max(p, 0) if not x else max(-p, 0) for p, x in zip(prefers, labels, strict=True)) + sum(c for a, b, c in edges if labels[a] != labels[b])
        if best is None or (cost, sum(labels)) < best[:2]:
            best = (cost, sum(labels), list(labels))
    return best[2]


@pytest.mark.parametrize("seed", range(60))
def test_cut_equals_all_labellings(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 11))
    prefers = rng.integers(-6, 7, n).tolist()
    edges = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, n, 2 * n), rng.integers(0, n, 2 * n), rng.integers(0, 5, 2 * n), strict=True) if a != b]
    assert T.minimum_cut(prefers, edges) == brute(prefers, edges)
    assert T._by_flow(prefers, edges) == brute(prefers, edges)


def test_long_chain_takes_linear_time():
    n = 200_000
    start = time.time()
    out = T.minimum_cut([1 if k % 2 else -1 for k in range(n)], [(k, k + 1, 3) for k in range(n - 1)])
    assert len(out) == n and time.time() - start < 20


MENU = '<ul>' + "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(6)) + "</ul>"
ARTICLE = f"{A} {B} {C}"
PAGES = {
    "semantic": f"<html><body><header>Site name<nav>{MENU}</nav></header><main><article><p>{A}</p><p>{B}</p><p>{C}</p></article></main><aside>Read our other stories, they are good.</aside><footer>&copy; 2020 All rights reserved.</footer></body></html>",
    "names": f"<div id='topnav'>{MENU}</div><div class='post-content'><p>{A}<p>{B}<p>{C}</div><div class='sidebar'><p>Some words beside it, a full sentence even.</p></div><div id=footer><p>Contact us at any time.</p></div>",
    "advert inside": f"<article><p>{A}</p><div class='ad'><p>Buy two, get one for nothing, only today.</p></div><p>{B}</p><div class='cookie-notice'>We use cookies.</div><p>{C}</p></article>",
    "comments": f"<article class='post comments-open'><p>{A}</p><p>{B}</p><p>{C}</p></article><section id='comments'><h2>3 comments</h2><article class='comment'><p>What a fine article, I have read it twice and liked it, thank you.</p></article><form><label>Your reply</label><textarea>x</textarea><button>Send</button></form></section>",
    "no names": f"<table><tr><td>{MENU}</td><td><p>{A}</p><p>{B}</p><p>{C}</p></td></tr><tr><td><a href='/a'>About</a> <a href='/b'>Imprint</a></td></tr></table>",
    "form around": f"<form id='page'><div class='nav'>{MENU}</div><article><p>{A}</p><p>{B}</p><p>{C}</p></article></form>",
    "wrapper": f"<div class='content-sidebar-wrap'><article><p>{A}</p><p>{B}</p><p>{C}</p></article><div class='widget'>Popular now</div></div>",
    "scripts": f"<head><title>T</title><style>p{{}}</style></head><body><script>var a='</p><article>'; if (1<2) x();</script><article><p>{A}<script>x('<p>')</script></p><!-- <p>no</p> --><p>{B}</p><noscript>Turn it on</noscript><p>{C}</p></article>",
    "broken": f"<article><p><b>{A}<br><p>{B}</b></i><p>{C}</article></div></div><footer>end",
    "inline": f"<article><p>The <a href='/h'>har<b>vest</b></a> was\n\t late this&#32;year, and the growers of the valley had to wait for the rain to end.</p><p>Yes&#46;</p>{C}</article>",
    "role": f"<div role='navigation'>{MENU}</div><div role='main'><p>{A}</p><p>{B}</p><p>{C}</p><div hidden>secret</div><div style='display: none'>unseen words</div></div>",
    "unclosed menu": f"<nav>{MENU}<article><p>{A}</p><p>{B}</p><p>{C}</p></article><footer>The end of it.</footer>",
    "hinted": f"<div id='head'>A daily of the valley.</div><div class='content'><p>{A}</p><p>{B}</p><p>{C}</p></div><div id='base'>Written by us all.</div>",
    "related": f"<div class='story'><p>{A}</p><p>{B}</p><p>{C}</p></div><div class='related'><article><a href='/x'>Another story</a></article></div>",
}


@pytest.mark.parametrize("name", PAGES)
def test_known_articles(name):
    assert T.main_text(PAGES[name]) == ARTICLE


def test_references_and_white_space():
    page = "<article><h1>A &amp; B</h1><p>&lt;x&gt; &eacute;&#233;&#x1F600; 1 < 2 &copy;&nbsp; end</p><p> \n </p><pre>two\n\n lines</pre></article>"
    assert T.main_text(page) == "A & B <x> éé😀 1 < 2 © end two lines"
    assert T.main_text("") == T.main_text("<nav>x</nav>") == ""


@pytest.mark.parametrize("page", ["<" * 200_000, "<a " * 100_000, "<div>" * 100_000 + "x", "<!--" * 100_000, "<p><b>" * 100_000, "</p>" * 100_000, "<a href=\"" * 50_000, "<li>" * 100_000 + "</div>" * 1000, "<script>" * 50_000, "x" * 1_000_000, "<td><p>a" * 50_000, "<p>a, b.</p>" * 50_000])
def test_odd_pages_end_in_linear_time(page):
    start = time.time()
    T.main_text(page)
    assert time.time() - start < 30


def test_set_aside_words():
    assert dom.named("comments-open hentry post") == dom.HINT and dom.named("entry-content") == dom.MAIN
    assert dom.named("siteHeader") == dom.named("adBox") == dom.named("post-comments") == dom.BESIDE
    assert dom.named("article-header") == dom.HINT and dom.named("address shadow") == dom.NEUTRAL


def test_fit_leaves_the_prior_without_rows_and_follows_rows():
    assert T.fitted(np.zeros((0, len(T.PRIOR))), np.zeros(0)).tolist() == T.PRIOR.tolist()
    rng = np.random.default_rng(1)
    x = np.hstack([np.ones((4000, 1)), rng.random((4000, len(T.PRIOR) - 1))])
    y = (x[:, 3] > 0.5).astype(float)
    w = T.fitted(x, y)
    loss = lambda w: np.log1p(np.exp(np.where(y, -1, 1) * (x @ w))).mean()
    assert loss(w) < loss(T.PRIOR) and w[3] > T.PRIOR[3]


def test_rows(spark):
    rows = [(1, "u", PAGES["semantic"]), (1, "u", PAGES["semantic"]), (2, None, None), (3, "v", ""), (None, "w", "plain text, no markup at all, but a whole sentence."), (4, "", "<nav>" + MENU)]
    df = spark.createDataFrame([(*r, "k", "u", "h", "t") for r in rows], COLUMNS)
    got = T.extract_main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.schema["n_chars"].dataType.simpleString() == "bigint"
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == sorted([(1, "u", ARTICLE, len(ARTICLE))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", rows[4][2], len(rows[4][2])), (4, "", "", 0)], key=repr)
    assert T.extract_main_text(spark.createDataFrame([], COLUMNS)).count() == 0


def test_held_out_pages_and_partitions(spark):
    """Weights are the same however the rows are dealt; articles of pages outside the sample come out whole."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    one, two = (T.learned_weights(p, most=20) for p in (pages, pages.repartition(7)))
    assert one.tolist() == two.tolist() != T.PRIOR.tolist()
    rows = pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist()
    for html in rows:
        body = html[html.index("<article>") : html.index("</article>")]
        whole = dom.Page(body)
        assert T.main_text(html, one) == " ".join(b.text for b in whole.blocks)
