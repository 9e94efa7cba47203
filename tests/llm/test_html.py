import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlex.llm import htmltext as H
from lumenlex.llm.bilstm import BiLstm
from lumenlex.llm.htmlblocks import leaf_blocks

PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
    '<div class="cookie-banner">We use cookies.<button>OK</button></div><article><h1>The  title</h1><p><b>First &lt;p&gt;\n line.<br>next<p>Second&nbsp;one, which is a longer paragraph of words.</p>'
    '<div class="ad">Buy now</div><p>Third paragraph of this article, also with some words.</p></article><div class="comments"><h3>Comments</h3><p>I agree.</p></div><footer>&copy; site</footer>'
)


def test_leaf_blocks():
    blocks = leaf_blocks(PAGE)
    assert [b[1] for b in blocks] == [
        "T & x", "Home", "News", "We use cookies.", "OK", "The title", "First <p> line. next", "Second one, which is a longer paragraph of words.", "Buy now",
        "Third paragraph of this article, also with some words.", "Comments", "I agree.", "© site",
    ]
    assert blocks[1][2] == 1.0 and ".cookie" in blocks[3][0] and blocks[6][0][-1] == "<p>"


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b", "<script>never ends", "<!-- open", "</p></p>", "<p title='x>y'>z", "<a b='>'", "text"])
def test_broken_markup(page):
    leaf_blocks(page)


def test_gradients_are_right():
    r = np.random.default_rng(0)
    model = BiLstm(5, 3, 1)
    x, mask = r.normal(size=(4, 2, 5)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = r.integers(0, 2, (4, 2)).astype(float)
    _, g = model.gradients(x, mask, y)
    for name, p in model.p.items():
        for at in [tuple(r.integers(0, s) for s in p.shape) for _ in range(4)]:
            kept = p[at]
            p[at] = kept + 1e-5
            up = model.gradients(x, mask, y)[0]
            p[at] = kept - 1e-5
            down = model.gradients(x, mask, y)[0]
            p[at] = kept
            assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_held_out_accuracy():
    model = H.trained()
    right = total = 0
    for x, y in H.labelled(120, seed=1234):
        p = model.predict(*H.padded([x]))[: len(y), 0] > H.THRESHOLD
        right, total = right + (p == y).sum(), total + len(y)
    assert right >= 0.985 * total


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<html><body><nav><a href=x>Menu</a></nav></body></html>"), (1, "u", PAGE), (5, None, "<article>" + "<p>Long text goes on here, and on.</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("blocks", "path")})
    out = H.extract(pages)
    assert out.columns == [*pages.columns, "text"]
    found = sorted(((r["page_id"], r["text"]) for r in out.collect()), key=str)
    text = "The title\n\nFirst <p> line. next\n\nSecond one, which is a longer paragraph of words.\n\nThird paragraph of this article, also with some words."
    assert found[:2] == [(1, text), (1, text)]
    assert found[2:5] == [(2, ""), (3, ""), (4, "")]
    assert found[5][1].count("Long text") == 3000
    assert H.extract(pages.where("page_id > 99")).collect() == []


def test_a_page_reads_the_same_in_any_company():
    model = H.trained()
    pages = [PAGE, None, "<p>x</p>", PAGE.replace("article", "main")]
    assert H.main_texts(pages, model) == [H.main_texts([p], model)[0] for p in pages]


def test_a_long_page_in_pieces_reads_the_same(monkeypatch):
    model = H.trained()
    blocks = leaf_blocks(H.Pages(77).page()[0]) * 30
    whole = model.predict(*H.padded([H.features(blocks)]))[:, 0]
    for size in (1, 7, len(blocks) - 1, len(blocks)):
        pieces = model.predict_long(lambda a, b: H.features(blocks[a:b], a, len(blocks)), len(blocks), size)
        assert np.abs(pieces - whole).max() < 1e-9
    pages = [H.Pages(seed).page()[0] for seed in range(5)]
    want = H.main_texts(pages, model)
    monkeypatch.setattr(H, "STEPS", 3)
    assert H.main_texts(pages, model) == want


@pytest.mark.parametrize("inner", [
    '<svg class="i"/>', "<math/>", "<svg>", "<object data=x>", "<noscript>", "<template>", "<select>", '<svg class="i"/><svg><title>icon</title><g><text>drawn</text></g></svg>',
    "<noscript>please enable</noscript>", "<select><option>one more</select>", "<object><p>no plugin</p></object>", "<svg><foreignObject><p>drawn</p></foreignObject></svg>",
])
def test_skipped_elements_end_where_they_end(inner):
    for around in ("{}", "<div>{}</div>"):
        page = f"<article><p>one</p>{around.format(inner)}<p>two</p><p>three</p></article><p>four</p>"
        assert [b[1] for b in leaf_blocks(page)] == ["one", "two", "three", "four"]


def test_text_of_formulas_is_kept():
    assert [b[1] for b in leaf_blocks("<p>as <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><p>so</p>")] == ["as x=1 holds", "so"]
    assert [b[1] for b in leaf_blocks("<p>a<svg><desc>b</desc></svg>c<script>d</script></p>")] == ["ac"]
