"""The labeller's gradient, its texts against the article element, and odd rows."""

import html
import re

import numpy as np
from pyspark.sql import functions as F

from groupwise.llm.html_extract import DIM, Labeller, blocks_of, examples, extract, main_texts


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    model = Labeller(hidden=3)
    x, mask, y = rng.normal(size=(4, 2, DIM)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float), rng.integers(0, 2, (4, 2)).astype(float)
    _, grads = model.loss_gradient(x, mask, y)
    for name in grads:
        flat = model.w[name].reshape(-1)
        for k in (0, len(flat) // 2, len(flat) - 1):
            kept, eps = flat[k], 1e-5
            flat[k] = kept + eps
            up = model.loss_gradient(x, mask, y)[0]
            flat[k] = kept - eps
            down = model.loss_gradient(x, mask, y)[0]
            flat[k] = kept
            assert abs((up - down) / (2 * eps) - grads[name].reshape(-1)[k]) < 1e-6


def plain(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


def test_articles_are_found(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = extract(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(got) == 250 and all(r.main_text == plain(r.html) for r in got)


def test_unseen_layouts(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").limit(200).collect()]
    model = Labeller()
    model.fit(examples(pages, 4), 6)
    page = """<body><header class="top"><h2>Site name</h2></header><nav><a href=x>Home</a></nav><main><h1>Title here</h1><p>First
    para &amp; more.</p><aside class="related"><p>Other story here.</p></aside><p>Second <b>bo</b>ld.</p><div class="comments"><p>I like this
    very much.</p></div></main><div class="cookie-notice"><p>We use cookies.</p></div><form><label>Mail</label></form><footer>c 2020</footer>"""
    assert main_texts([page], model) == ["Title here First para & more. Second bold."]


def test_blocks():
    got = blocks_of("<p>a <i>b</i>c<br>d<p>e&lt;&nbsp;f<script>x</script> <!-- y --> g <li>h</li>1 < 2<style>q")
    assert [b.text for b in got] == ["a bc d", "e< f g", "h", "1 < 2"] and got[1].path == ("p",)
    for text in ("<a " * 50_000, "<!--" * 50_000, "<script>" * 20_000, '<a b="' * 50_000, "<div>" * 3000):
        blocks_of(text)


def test_odd_rows(spark):
    rows = [(1, "u", "<article><p>x y</p></article>"), (1, "u", "<article><p>x y</p></article>"), (2, None, None), (None, "v", ""), (3, "w", "<nav>only menu</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main_text", F.lit("clash"))
    got = extract(df).collect()
    assert len(got) == 5 and {r.main_text for r in got if r.page_id == 2 or r.page_id is None} == {""}
    assert extract(df.limit(0)).count() == 0


def test_memory_is_bounded_by_the_longest_page():
    import tracemalloc

    model = Labeller()
    pages = ["<p>a</p>" * 250_000] + ["<article><p>short page</p></article>"] * 63
    tracemalloc.start()
    got = main_texts(pages, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 64 and peak < 500e6
    few = [pages[1], "<div>" + "<p>x y</p>" * 40 + "</div>", ""]
    assert main_texts(few, model, cells=1) == main_texts(few, model, cells=10**6)  # groups change no result


def test_pages_without_article_elements(spark):
    rows = [(k, "u", f"<div><h1>Title {k}</h1><p>Some text of page {k} here.</p><nav><a href=x>Menu</a></nav></div>") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.main_text for r in extract(df).collect()} == {k: f"Title {k} Some text of page {k} here." for k in range(40)}
    nothing = spark.createDataFrame([(1, "u", ""), (2, "u", None), (3, "u", "<br>")], df.schema)
    assert {r.main_text for r in extract(nothing).collect()} == {""}
