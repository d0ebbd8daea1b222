import itertools

import numpy as np
import pytest

from termflow.llm.html import extract, main_text, min_cut


@pytest.mark.parametrize("page,want", [
    ("", ""),
    ("<p>Just one paragraph of text, long enough to be read.</p>", "Just one paragraph of text, long enough to be read."),
    ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; tail</h1><p>A  b\n c.<p><b>Open<br>line.<p>Be.</article><footer>&copy; us</footer>",
     "Head & tail\nA b c.\nOpen line.\nBe."),
    ("<body><div class='sidebar'><p>Look at this other page of ours now.</p></div><main><p>The text.</p><script>var a='</p>';</script><aside>See also.</aside><p>More &lt;b&gt; text.</main>",
     "The text.\nMore <b> text."),
    ("<article><p>Text.</p><section class=\"comments\"><p>I do not agree with any of this.</p></section></article><form><p>Your mail</p></form>", "Text."),
    ("<article><p>one<!-- <p>no</p> --> two</p><style>p{}</style></article><div id=cookie-notice>We use cookies.</div>", "one two"),
    ("<header><p>Site name of ours.</p></header><article><header><h1>Title</h1></header><p>Body.</p><footer>Tags</footer></article>", "Title\nBody."),
    ("<article><p>cut off in a tag <a href='x", "cut off in a tag"),
    ("<body><div class=\"ad\">Buy now and save a lot of money today.</div><div><p>" + "A long paragraph tells a story. " * 10 + "</p></div></body>", ("A long paragraph tells a story. " * 10).strip()),
    ("<div class='layout has-sidebar'><article><p>The text of it.</p></article><div class='sidebar'><p>More of ours.</p></div></div>", "The text of it."),
    ("<form action=x><div id=top class='no-nav'><article><p>The text of it.</p></article><p>Send us your mail now.</p></div></form>", "The text of it."),
    ("<main class='legal'><h1>Terms</h1><p>These are the terms of use.</p></main><footer>us</footer>", "Terms\nThese are the terms of use."),
    ("<div class='share-widget-page'><article><p>The text of it.</p><div class=share>Share this!</div></article></div>", "The text of it."),
    ("<article><p>He said:</p><blockquote class='alert'>Mind the gap.</blockquote><div class='alert'>Log in to read.</div></article>", "He said:\nMind the gap."),
    ("<div class='ad-layout'><div class='social-site'><article><section class=comments><article class=comment><p>I object to that.</p></article></section><p>Real text here.</p></article></div></div>", "Real text here."),
    ("<article><p>Text here.</p></article><aside><article><p>Other story of the day.</p></article></aside><article class='teaser'><p>Read this next.</p></article>", "Text here."),
    ("<div class='widget-page'><p>" + "A long paragraph tells a story. " * 10 + "</p></div>", ("A long paragraph tells a story. " * 10).strip()),
    ("<article><p>Text here.</p></article><div class='footer-container'><p>" + "We are a company of old. " * 10 + "</p></div>", "Text here."),
    ("<article><div class='site-footer-links'><p>About this site of ours.</p></div><p>Text here.</p></article>", "Text here."),
])
def test_pages(page, want):
    assert main_text(page) == want


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        c, b = rng.integers(0, 6, n).astype(float).tolist(), rng.integers(0, 6, n).astype(float).tolist()
        edges = {(i, j): float(rng.integers(0, 4)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6}

        def cost(side):
            return sum(b[i] if side[i] else c[i] for i in range(n)) + sum(w for (i, j), w in edges.items() if side[i] != side[j])

        assert cost(min_cut(c, b, edges)) == pytest.approx(min(cost(s) for s in itertools.product([True, False], repeat=n)))


def test_rows(llm):
    pages = llm.createDataFrame([(1, "u", "<p>Text is here.</p>", "x"), (1, "u", "<p>Text is here.</p>", "x"), (None, None, None, None), (2, "v", "<p>" + "long " * 60000 + ".</p>", "")],
                                "page_id long, url string, html string, text string")
    got = extract(pages).toPandas()
    assert len(got) == 4 and sorted(got.n_chars) == [0, 13, 13, 300001] and (got.n_chars == got.text.str.len()).all()
    assert extract(pages.where("false")).count() == 0
