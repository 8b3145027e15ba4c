"""The graphical model against enumeration, trees against hand-made pages, and texts against held-out labels."""

import html as entities
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from corpuspack.llm import extraction
from corpuspack.llm.dom import HINT_NAMES, Page, hints_of
from corpuspack.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, text string, n_chars int"
BIG = (1 << 60) + 1


def blocks(source):
    page = Page(source)
    return page.text(range(len(page.runs))).split("\n") if page.runs else []


@pytest.mark.parametrize(
    "source, expected",
    [
        ("", []),
        (" \n <div> </div>", []),
        ("plain &lt;text&gt; &amp;amp; &#x41;&nbsp;b", ["plain <text> &amp; A b"]),
        ("<p>one<p>two<br>three</p>four", ["one", "two three", "four"]),
        ("<p><b>a<br><p>b</p></b>c", ["a", "b", "c"]),
        ("a <b>b</b><i>c</i> d", ["a bc d"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ('<script>var x = "</p><p>no"; if (a < b) {}</script>yes<style>p{}</style>', ["yes"]),
        ("<!-- a > b --><p>x<!-- <p>no</p> --> y</p><!--open <p>no", ["x y"]),
        ('<a title="a > b">x</a> <img alt="<p>"> 1 < 2 & 3', ["x 1 < 2 & 3"]),
        ("<select><option>no</select><button>no</button><noscript><p>no</p></noscript>yes", ["yes"]),
        ("</div></p>a</b></article><p>b", ["a", "b"]),
        ("<title>no</title><TEXTAREA>no</textarea ><P>Yes</P><script>no", ["Yes"]),
        ("<div " * 3 + "x", ["<div <div <div x"]),
        ("<p class='a' id=b>x</p" + "y", ["x</py"]),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "end", ["deep", "end"]),
        ("<span class=ad>Buy</span> it", ["Buy it"]),
    ],
)
def test_blocks(source, expected):
    assert blocks(source) == expected


def test_hints():
    named = lambda attributes: {h for k, h in enumerate(HINT_NAMES) if hints_of(attributes) >> k & 1}
    assert named('class="side-bar SiteNav" id=comments') == {"side", "frame", "menu", "comment"}
    assert named("hidden") == named('style="color:red; display: none"') == {"hidden"}
    assert named('data-x="ad"') == named("") == set()


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(3)
    sources = ["<article><h1>a</h1><p>b <a>c</a></p></article><nav><a>d</a></nav>", "<p>x", "", "<div><ul><li>a<li>b</ul>c</div>"]
    forest = extraction.Forest.of([Page(s) for s in sources])
    model = extraction.Model(draw.normal(size=extraction.N_FEATURES), draw.normal(size=(extraction.N_KINDS, 2, 2)))
    nodes, pairs = extraction.marginals(forest, model)
    for first, stop in zip(forest.start, forest.start[1:]):
        n = stop - first
        own, both, total = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0.0
        for state in itertools.product((0, 1), repeat=int(n)):
            score = 0.0
            for k in range(n):
                score += state[k] * (forest.features[first + k] @ model.weights)
                if forest.parent[first + k] >= 0:
                    score += model.edges[forest.kind[first + k], state[forest.parent[first + k] - first], state[k]]
            weight = np.exp(score)
            total += weight
            for k in range(n):
                own[k, state[k]] += weight
                if forest.parent[first + k] >= 0:
                    both[k, state[forest.parent[first + k] - first], state[k]] += weight
        assert np.allclose(np.exp(nodes[first:stop]), own / total)
        for k in range(1, n):
            assert np.allclose(np.exp(pairs[first + k]), both[k] / total)


@pytest.fixture(scope="module")
def model(spark):
    return extraction.train(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def test_held_out_layouts(model):
    draw = random.Random(12345)
    right = total = 0
    for _ in range(300):
        page = Page(extraction.labelled_page(draw))
        forest = extraction.Forest.of([page])
        nodes, _ = extraction.marginals(forest, model)
        kept = nodes[forest.runs[:, 0], 1] >= np.log(0.5)
        right += (kept == extraction.run_labels(page)).sum()
        total += len(page.runs)
    assert right >= 0.98 * total


def test_parts_that_go(model):
    """A page of another make than the table's."""
    text = "This is a sentence of the article, which goes on for a while. It has a second one."
    page = f"""<!doctype html><html><body><div class="cookie-notice">We use cookies. <a href=#>OK</a></div>
      <header><a href="/">Home</a> <form id=search><label>Search</label><input></form></header>
      <div id="sidebar"><h3>Related</h3><ul><li><a href=1>One more story</a><li><a href=2>Another story</a></ul></div>
      <div class="post-content"><h1>The title</h1><p>{text}<p>Second paragraph: {text} <a href="/x">A link</a> within.
      <div class="ad-slot">Buy this now, it is cheap.</div><ul><li>First point, explained.<li>Second point, explained.</ul>
      <script>track("x")</script><div class="newsletter">Sign up for news. <form><input></form></div><p>Last &amp; least, {text}</div>
      <section class="comments"><h2>Comments</h2><div class="comment">Ann: <p>I liked this article, thank you.</div></section>
      <footer>&copy; Somebody <a href="/legal">Legal</a></footer></body></html>"""
    expected = ["The title", text, f"Second paragraph: {text} A link within.", "First point, explained.", "Second point, explained.", f"Last & least, {text}"]
    assert extraction.texts_of(model, [page])[0].split("\n") == expected
    plain = page.replace("header", "div").replace("footer", "div class=footer")
    assert extraction.texts_of(model, [plain, "", page]) == ["\n".join(expected), "", "\n".join(expected)]


def test_rows(spark, model):
    body = "<article><h1>Title here</h1>" + "<p>Some words, and more of them. A sentence.</p>" * 3 + "</article>"
    rows = [(k, u, h, "x", 1) for k, u, h in [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", body), (BIG, "w", body), (BIG + 2, "w", body), (7, "l", body * 3000)]]
    got = extraction.extracted(spark.createDataFrame(rows, SCHEMA).repartition(2), model).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    by = {(r["page_id"], r["url"]): r["text"] for r in got}
    expected = "\n".join(["Title here", *["Some words, and more of them. A sentence."] * 3])
    assert by[1, None] == by[2, "u"] == "" and by[None, "v"] == by[BIG, "w"] == by[BIG + 2, "w"] == expected
    assert by[7, "l"] == "\n".join([expected] * 3000)
    empty = spark.createDataFrame([], SCHEMA)
    assert extraction.extracted(empty, extraction.train(empty)).collect() == []


def article(source):
    inside = re.search("<article>(.*?)</article>", source, re.S)[1]
    parts = (" ".join(entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", inside))
    return "\n".join(filter(None, parts))


def test_query_and_sql(spark):
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
        got = sorted(tuple(r) for r in QUERIES["op13_extract"](spark, folder).collect())
        assert got == sorted((k, r["url"], t := article(r["html"]), len(t)) for k, r in pages.items())
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
        assert got == sorted(con.execute(ORACLE["op13_extract"]).fetchall())
