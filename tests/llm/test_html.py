"""HTML extraction: blocks, labels, cases."""

import html as entities
import re

import numpy as np
import pytest

from talkgrain.llm import html

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return html.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))


def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", x))).strip()
             for x in re.split(r"</?(?:p|h1)>", inside[1])]
    return "\n".join(p for p in parts if p)


def test_tables(spark, model):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {r["page_id"]: (r["url"], article(r["html"])) for r in pages.collect()}
    got = html.extract(pages, model).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_other_layouts(model):
    rng = np.random.default_rng(77)
    right = 0
    for _ in range(150):
        page, text = html.drawn_page(rng)
        blocks = html.blocks(page)
        keep = model.logits(html.read([blocks])) > 0
        right += "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k) == re.sub(" +", " ", text)
    assert right >= 145


@pytest.mark.parametrize(("page", "texts"), [
    ("<p>a<p>b &amp; c&nbsp;d", ["a", "b & c d"]),
    ("<div>x<script>if (a</p>) {}</script> y<!-- z --><br>w</div>", ["x y w"]),
    ("<ul><li>1<li>2 <b>x</b></ul>t", ["1", "2 x", "t"]),
    ("<p title='a>b'>k</p></div></p>", ["k"]),
    ("plain < text", ["plain < text"]), ("<script>never ends", []), ("", []), ("<p> \n </p>", []),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<article><p>one</p><svg/><p>two</p>", ["one", "two"]), ("<svg width='1' /><p>two", ["two"]),
    ("<svg><path d=''/><text>no</text></svg><p>two", ["two"]), ("<title-bar>x</title-bar><p>two", ["x", "two"]),
    ("<select-box>x</select-box><p>two", ["x", "two"]), ("<object data=x><p>two", ["two"]),
    ("<iframe src='/a'><p>two", ["two"]), ("<noscript><p>two</p>", ["two"]), ("<template><p>two</p>", ["two"]),
    ("<object><p>two</p><object>no</object><p>three", ["two", "three"]),
    ("<object>no<object>no</object>no</object><p>two", ["two"]), ("one<svg>no</svg> two", ["one two"]),
    ("<select><option>no</select>two</select><p>three", ["two", "three"]),
    ("<svg><p>two<script>'</svg>'</script> three", ["two three"]), ("<svg><!-- </svg> --><p>two", ["two"]),
    ("<textarea>no<p>no", []), ("<SVG>no</Svg ><p>two", ["two"]),
    ("<title>no</title><style>p{}</style><h1>yes", ["yes"]), ("<p>&#65;&lt;b&gt; &unknown; &am", ["A<b> &unknown; &am"]),
])
def test_blocks(page, texts):
    assert [b.text for b in html.blocks(page)] == texts


def test_padding_and_order_do_not_matter(model):
    rng = np.random.default_rng(5)
    pages = [html.blocks(html.drawn_page(rng)[0]) for _ in range(20)]
    together = model.logits(html.read([*pages, []]))
    alone = np.concatenate([model.logits(html.read([p])) for p in pages])
    assert np.abs(together - alone).max() < 1e-3


@pytest.mark.parametrize("tag", ["<svg/>", "<object>", "<iframe src=x>", "<noscript>", "<select>", "<template>"])
def test_unclosed_elements_keep_the_article(spark, model, tag):
    page = (f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A heading</h1>"
            f"<p>The first part of it is here.</p>{tag}<p>The second part of it follows.</p></article>"
            "<footer><p>All rights reserved</p></footer></body></html>")
    got = html.extract(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string"), model)
    assert got.collect()[0]["text"] == "A heading\nThe first part of it is here.\nThe second part of it follows."


def test_cases(spark, model):
    long = "<article>" + "".join(f"<p>part {k} of it</p>" for k in range(5000)) + "</article>"
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<nav><a href=x>menu</a></nav>", 3), (4, "u", long, 4),
            (4, "u", long, 5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = html.extract(pages, model).collect()
    assert len(got) == 5
    assert [r["n_chars"] for r in sorted(got, key=lambda r: r["n_chars"])][:3] == [0, 0, 0]
    assert [r["text"].count("\n") for r in got if r["page_id"] == 4] == [4999, 4999]
    assert html.extract(pages.limit(0), model).count() == 0


def test_broken_markup_takes_time_in_proportion():
    import time

    for piece in ('<a b="c" ', '"<a ', "<a", "<a b='", "<p>", '<div class="q>', "<!-- ", "<script>", "<svg>", "<object><select>",
                  "<svg/>", "<iframe></iframe>"):
        began = time.perf_counter()
        html.blocks(piece * 40000)
        assert time.perf_counter() - began < 5
    html.blocks("<" + "a" * 300000)
