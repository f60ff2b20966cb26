import random

import numpy as np
import pytest

from tabpact.llm import block_labeller as B
from tabpact.llm.html_blocks import blocks_of

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><div class="logo">My site</div>
<ul class="menu"><li><a href=/>Home</a><li><a>About us</a></ul></header><div class="cookie-banner"><p>We use cookies.</p></div>
<article><h1>A title &amp; more</h1><p>First <b>bold</b> text,&nbsp;with a link <a href="x">here</a>.<br>And
 on.<script>var t="</p>";</script><ul><li>one item<li>two item</ul><!-- <p>hidden</p> --><p>Second &lt;paragraph&gt;.</p>
<div class="comments"><div class="comment"><p>I do not agree at all.</p></div></div></article>
<aside class="sidebar"><p>Related things</p></aside><form><label>Name</label><input></form><footer><p>&copy; 2020</p></footer></body></html>"""
TEXT = "A title & more\nFirst bold text, with a link here. And on.\none item\ntwo item\nSecond <paragraph>."


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return B.train(B.sample(pages))


def test_blocks():
    assert [b.text for b in blocks_of(PAGE)][:5] == ["My site", "Home", "About us", "We use cookies.", "A title & more"]
    assert blocks_of(PAGE)[1].linked == 4 and blocks_of(PAGE)[1].path[-2:] == (("ul", "menu"), ("li",))
    assert [b.text for b in blocks_of("a < b <p>c<p>d</b><script>never closed <p>x")] == ["a < b", "c", "d"]
    assert [b.text for b in blocks_of("<p title='a>b'>x</p><p title=\"unclosed>y</p> z")] in (["x", "y", "z"], ["x"], ["x", "y z"])
    assert blocks_of(None) == blocks_of("") == blocks_of("<!-- no -->") == blocks_of("<p> &nbsp; </p>") == []
    assert [b.text for b in blocks_of("cut &am")] == ["cut &am"] and blocks_of("x<div cut=")[0].text == "x"


def test_gradients():
    model, draw = B.Labeller.untrained(), np.random.default_rng(0)
    for p in model.parameters():
        p[...] = draw.standard_normal(p.shape) * 0.3
    x, mask = draw.standard_normal((5, 3, B.FEATURES)).astype(np.float32), np.ones((5, 3), np.float32)
    mask[3:, 1] = 0
    y = (draw.random((5, 3)) > 0.5).astype(np.float32)

    def loss():
        chances = model.chances(x, mask).astype(np.float64)
        return -((y * np.log(chances) + (1 - y) * np.log(1 - chances)) * mask).sum() / mask.sum()

    for p, gradient in zip(model.parameters(), model.gradients(x, mask, y)):
        at = tuple(draw.integers(n) for n in p.shape)
        old = p[at]
        p[at] = old + 0.02
        above = loss()
        p[at] = old - 0.02
        slope, p[at] = (above - loss()) / 0.04, old
        assert slope == pytest.approx(float(gradient[at]), abs=1e-4)


def test_held_out_pages(spark, sf, pages, model):
    """The blocks of pages that were not learned from, and of variants of them."""
    learned = {b.text for blocks, _ in B.sample(pages) for b in blocks}
    others = [p for p in (blocks_of(r.html) for r in pages.collect()) if p and not {b.text for b in p} <= learned]
    assert others
    wrong = sum((got != B.labels_of(p)).sum() for p, got in zip(others, B.label(others, model)))
    assert wrong == 0
    draw, texts = random.Random(5), [b.text for p in others for b in p]
    variants = [B.variant(p, B.labels_of(p), texts, draw) for p in others]
    wrong = sum((got != y).sum() for (_, y), got in zip(variants, B.label([p for p, _ in variants], model)))
    assert wrong <= 0.01 * sum(len(y) for _, y in variants)


def test_query_against_the_structure_of_the_pages(spark, sf, pages):
    """On these pages the article is the text of the element of that name."""
    got = {r.page_id: r for r in B.op5_main_text(spark, sf).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        blocks = blocks_of(r.html)
        text = "\n".join(b.text for b in blocks if any(e[0] == "article" for e in b.path))
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


def test_a_page_of_another_make(model):
    blocks = blocks_of(PAGE)
    chosen = B.label([blocks], model)[0]
    assert "\n".join(b.text for b, c in zip(blocks, chosen) if c) == TEXT


def test_odd_pages(spark, model):
    long = "<article>" + "<p>Some words of a long page.</p>" * 5_000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>text"), (4, "u", long), (4, "u", long), (5, "u", "no tags at all")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'clash' AS id", "1 AS text")
    got = B.extract(pages, model).collect()
    assert len(got) == 6
    found = {(r.page_id, r.url): (r.text, r.n_chars) for r in got}
    assert found[1, None] == found[2, "u"] == ("", 0)
    assert found[4, "u"][0] == "\n".join(["Some words of a long page."] * 5_000)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert B.sample(pages) == [] and B.extract(pages, B.train([])).count() == 0


@pytest.mark.parametrize("tag", ["button", "select", "svg", "canvas", "object", "audio", "video"])
def test_an_element_without_an_end_keeps_the_rest(tag):
    texts = [b.text for b in blocks_of(f"<body><div><{tag}></div><p>First.</p><{tag}>hidden</{tag}><p>Second.</p></body>")]
    assert texts == ["First.", "Second."]
    assert [b.text for b in blocks_of(f"<{tag}>no<{tag}>no</{tag}>no</{tag}><p>First.</p>")] == ["First."]


def test_a_head_without_an_end():
    for body in ("<body><p>Text.</p></body>", "<p>Text.</p>", "Text."):
        found = blocks_of(f"<html><head><title>no</title><script>no</script><meta charset=x>{body}</html>")
        assert [b.text for b in found] == ["Text."] and all(("head",) not in b.path for b in found)


def test_formulas_and_captions_are_text():
    found = blocks_of("<article><p>As <math><msup><mi>x</mi><mn>2</mn></msup></math> is.</p><figure><img src=x><figcaption>A caption.</figcaption></figure></article>")
    assert [b.text for b in found] == ["As x2 is.", "A caption."]
    assert B.labels_of(found).all()


def test_malformed_pages_take_time_in_proportion():
    """Open elements without end, tags without end: a page of 1 MB is read in seconds, and its paths stay short."""
    import time

    from tabpact.llm import block_labeller
    from tabpact.llm.html_blocks import DEEPEST, blocks_of

    for part, count in (("<div>x", 170_000), ("<svg ", 0), ("<svg x", 0), ("<button>x", 1), ("<p>a <b>x", None)):
        page = part * (1_020_000 // len(part))
        begun = time.time()
        blocks = blocks_of(page)
        block_labeller.features(blocks)
        assert time.time() - begun < 20
        assert count is None or len(blocks) == count
        assert all(len(b.path) <= DEEPEST for b in blocks)
    inner = "<div>" * 300 + "<p>deep</p>" + "</div>" * 300 + "<p>after</p>"
    assert [(b.text, len(b.path)) for b in blocks_of(inner)] == [("deep", DEEPEST), ("after", 1)]
