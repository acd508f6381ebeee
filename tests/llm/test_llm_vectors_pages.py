"""Top-k search and page extraction on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import html_text, top_k

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k=5, every=50):
    seen = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(float(np.float32(x)) * 256) for x in v]
        seen[i] = min(seen.get(i, q), q)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for i, v in seen.items():
        if i % every == 0:
            best = sorted((-dot(v, w), j) for j, w in seen.items() if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


def rows_of(n=300):
    rng = np.random.default_rng(2)
    out = [(i, [float(x) for x in rng.normal(0, 0.3, 12)]) for i in range(n)]
    hot = [0.5, -0.25] * 6
    out += [(1000 + i, hot) for i in range(120)]
    return [*out, (50, None), (2000, [None] * 12), (2050, [float("nan")] * 12), (2100, [float("inf")] * 12), (2150, []), (2200, [1.0, 2.0, 3.0]), (None, hot), (100, out[100][1]), (150, [9.0] * 12)]


@pytest.mark.parametrize("cells", [1 << 22, 30])  # one block of queries, many blocks
@pytest.mark.parametrize("parts", [2, 3])
def test_top_k_equals_brute_force(spark, cells, parts):
    rows = rows_of()
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).repartition(3)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(df, parts=parts, block_cells=cells).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("rows", [[], [(50, [1.0])], [(1, [1.0]), (2, [2.0])], [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0])]])
def test_top_k_of_few_rows(spark, rows):
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == brute(rows)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="with-sidebar"><header><a href="/">Home</a> A slogan of the site</header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div id="cookie-banner"><p>We use cookies, and this notice is long enough to look like a text that somebody wrote.</p></div>
<article><header><h1>The &amp; title</h1></header><p>One&nbsp;paragraph   with <a href="/x">a link</a> and words.<p>Short.</p><div class="ad">Buy this now</div><ul><li>first</li><li>second</li></ul>
<form>Your mail <input name="m"></form><p>Last &lt;p&gt; one<br>here.</p><footer>By someone</footer></article><section id="comments"><article class="comment"><p>A reader's comment that goes on for quite some words, as comments do.</p></article></section>
<div class="sidebar"><p>A column at the side with many words in it, none of which belongs to the article above.</p></div><footer>&copy; 2020</footer></body></html>"""


def test_article_without_its_frame():
    assert html_text.main_text(PAGE) == "The & title One paragraph with a link and words. Short. first second Last <p> one here."


def test_cut_off_and_bare_pages():
    whole = html_text.main_text(PAGE)
    for at in range(0, len(PAGE), 7):
        text = html_text.main_text(PAGE[:at])
        assert "cookies" not in text and "slogan" not in text
        assert text == "" or whole.startswith(text[:4])
    assert html_text.main_text("") == "" and html_text.main_text("<") == "" and html_text.main_text("<p") == ""
    long = "word " * 30
    assert html_text.main_text(f"<div><a href=1>One</a> <a href=2>Two</a></div><div><h1>A page without article</h1><p>{long}</p><p>Short.</p><p>{long}</p></div>").startswith("A page without article word")


def test_labelled_blocks_are_learnt():
    x, y = html_text.LABELLED[:, :-1], html_text.LABELLED[:, -1].astype(bool)
    assert (html_text.verdicts(html_text.TREE, x) == y).all()


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (3, "v", "", "z"), (1, "u", PAGE, "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.url or "", r.n_chars == len(r.text)) for r in got) == [(1, "u", True), (1, "u", True), (2, "", True), (3, "v", True)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
