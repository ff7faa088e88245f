"""Main text of pages: blocks, the field against all labellings, made pages held out, and the given pages."""

import html
import itertools
import re

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm import helpers as H
from vocspark.llm import htmlmain, layouts, queries
from vocspark.llm.htmlblocks import leaf_blocks


def texts(page):
    return [b.text for b in leaf_blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    (
        ("", []),
        ("plain & simple", ["plain & simple"]),
        ("<p>a<b>b</b>c<br>d&nbsp;&amp;\n e<p>f", ["abc d & e", "f"]),
        ("<p><b>Title<br><p>x", ["Title", "x"]),
        ('<script>var t="<p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><textarea>no</textarea>yes', ["yes"]),
        ("<title>no</title>1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]),
        ('<a title="a > b" href=x>link</a> rest', ["link rest"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("</p></div>x<div", ["x"]),
        ("x<script>never closed <p>y", ["x"]),
        ("<!-- never closed <p>y", []),
        ("&lt;p&gt; &copy &#233; &#x1F600; &unknown;", ["<p> © é 😀 &unknown;"]),
        ("<P CLASS='x'>Up</P><DIV>down</DIV>", ["Up", "down"]),
    ),
)
def test_blocks(page, want):
    assert texts(page) == want


def test_elements_around_blocks():
    (a, b) = leaf_blocks('<div class="Side-Bar leftCol" id=x9><p>a</p></div><nav hidden><a href=x>b c</a>!</nav>')
    assert a.path == (("div", ("side", "bar", "left", "col", "x")), ("p", ())) and a.link_chars == 0
    assert b.path == (("nav", ("hidden",)),) and b.link_chars == 3


def test_long_pages_take_linear_time():
    assert len(leaf_blocks("<div>x" * 200_000)) == 200_000
    assert len(leaf_blocks("</span></div><p>x" * 100_000)) == 100_000
    assert leaf_blocks('<a b="c' * 50_000) == [] and texts("<" * 200_000) == ["<" * 200_000]


def test_field_equals_all_labellings():
    rng = np.random.default_rng(3)
    field = htmlmain.Field(np.zeros(1), rng.normal(size=(3, 2, 2)), rng.normal(size=2))
    lengths = np.array([5, 1, 3])
    scores, kinds = rng.normal(size=(3, 5)), rng.integers(0, 3, (3, 5))
    chance, expected = htmlmain._messages(scores, kinds, lengths, field)
    want = np.zeros((3, 2, 2))
    for p, n in enumerate(lengths):
        total = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            total[y] = field.start[y[0]] + sum(scores[p, t] for t in range(n) if y[t]) + sum(field.pairs[kinds[p, t], y[t - 1], y[t]] for t in range(1, n))
        z = sum(np.exp(v) for v in total.values())
        for t in range(n):
            assert chance[p, t] == pytest.approx(sum(np.exp(v) for y, v in total.items() if y[t]) / z)
        for y, v in total.items():
            for t in range(1, n):
                want[kinds[p, t], y[t - 1], y[t]] += np.exp(v) / z
        assert tuple(htmlmain.best_labels(scores[p, :n].tolist(), kinds[p, :n].tolist(), field)) == tuple(bool(x) for x in max(total, key=total.get))
    assert np.allclose(expected, want)


@pytest.fixture(scope="module")
def field(spark):
    return htmlmain.train(queries.table(spark, SF, "pages"))


def test_held_out_layouts(field):
    """Pages of another seed, and of texts that were not seen: blocks right, and whole pages."""
    words = "rain river stone copper lantern meadow harbour violin winter orchard cellar engine ribbon saddle timber".split()
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(rng.choice(words, n)).capitalize() + ". "
    paragraphs = ["".join(say(rng.integers(4, 14)) for _ in range(rng.integers(1, 6))).strip() for _ in range(300)]
    extractor = htmlmain.Extractor(field)
    blocks = wrong = whole = 0
    made = layouts.labelled_pages(paragraphs, [say(2) for _ in range(60)], 400, seed=77)
    for page in made:
        found = leaf_blocks(page)
        off = sum(a != b.gold for a, b in zip(extractor.labels(found), found))
        blocks, wrong, whole = blocks + len(found), wrong + off, whole + (not off)
    assert wrong <= 0.02 * blocks and whole >= 0.85 * len(made)


PAGE = """<html><head><title>t</title></head><body><header class=site-header><a href=/>Site</a></header>
<div class="cookie-notice">We use cookies on this site and you agree to it.</div>
<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>
<div class="post-content"><h1>A title</h1><p>First paragraph of the story, with some words.</p>
<div class="ad">Buy our fine lamps today, they are the best lamps.</div>
<p>Short.</p><blockquote>Quoted words &amp; more of them.</blockquote></div>
<div id="sidebar"><h3>Related</h3><ul><li><a href=3>Another story of the day</a></ul></div>
<section class="reader-comments"><h3>2 comments</h3><div class=comment><b>Ann</b><p>I liked this story, it was well told.</p></div></section>
<form action=x><label>Your mail</label><input><button>Send</button></form>
<footer>&copy; 2020 Site &middot; All rights reserved.</footer></body></html>"""


def test_one_page_with_all_parts(field):
    assert htmlmain.Extractor(field).text(PAGE) == "A title First paragraph of the story, with some words. Short. Quoted words & more of them."


def test_op13_on_the_given_pages(spark):
    """The given pages have one layout, whose article can be cut out plainly."""
    rows = {r["page_id"]: r for r in queries.table(spark, SF, "pages").collect()}
    out = queries.op13_html_extraction(spark, SF).collect()
    assert sorted(r["page_id"] for r in out) == sorted(rows)
    for r in out:
        article = re.search(r"<article>(.*)</article>", rows[r["page_id"]]["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>|<br>", re.sub("</?b>", "", article))
        assert r["text"] == " ".join(" ".join(html.unescape(x).split()) for x in parts if x.strip())
        assert r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]]["url"]


def test_edge_pages(spark, field):
    rows = [(1, None), (2, ""), (3, PAGE), (3, PAGE), (None, PAGE), (4, "no markup at all, only a line of text"), (5, "<p>" + "word " * 400_000), (6, "<" * 1000), (7, "<div></div><script>x</script>")]
    df = spark.createDataFrame([(i, "u", t, "x", "y") for i, t in rows], "page_id long, url string, html string, text string, found string")
    out = htmlmain.extract(df, field)
    assert out.columns == ["page_id", "url", "html", "found", "text"]
    got = {(r["page_id"], r["text"][:20]) for r in out.collect()}
    assert {(1, ""), (2, ""), (3, "A title First paragr"), (None, "A title First paragr"), (7, "")} <= got and out.count() == len(rows)
    assert htmlmain.report(df.limit(0)).count() == 0
    assert htmlmain.report(df.where("page_id = 3")).count() == 2
