import itertools
import random

import pytest

from pulseframe.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu &amp; more</a></li><li>Plain entry of the menu.</li></ul></nav>
<div class="cookie-notice">We use cookies on this site. Please accept them all before you read on.</div><!-- a <p>comment</p> -->
<article><h1>Head &lt;1&gt;</h1><p><b>First   para&shy;graph<br>goes on.<p>Second one,
with <a href="x">a link</a> and caf&eacute;.</p><div class="ad">Buy this now, it is a very good thing to buy.</div><ul><li>Point one of the text.</li><li>Point two.</li></ul>
<form><label>Your mail</label><input><button>Send</button></form></article>
<aside>Related pieces that you may like, with a long sentence that ends here.</aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I think that this was a great article and I read all of it.</p></div></section>
<footer>&copy; all rights</footer></body></html>"""


def test_main_text():
    assert h.main_text(PAGE) == "Head <1>\nFirst para­graph goes on.\nSecond one, with a link and café.\nPoint one of the text.\nPoint two."


@pytest.mark.parametrize("page", ["", None, "no markup at all", "<", "<p", "<!--", "<script>", "a < b", "<a href='x>y", "</p></div>", "<p>" * 500 + "x", "&#xD800; &bogus; &#0;"])
def test_broken_pages(page):
    assert isinstance(h.main_text(page), str)


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 7)
        scores = [rng.randint(-6, 6) for _ in range(n)]
        edges = {(i, j): rng.randint(1, 6) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5}
        cost = lambda y: sum(max(0, s) if not v else max(0, -s) for s, v in zip(scores, y)) + sum(w for (i, j), w in edges.items() if y[i] != y[j])  # noqa: E731,B023
        assert cost(h.cut(scores, edges)) == pytest.approx(min(cost(y) for y in itertools.product([False, True], repeat=n)))


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, "", "y")], "page_id long, url string, html string, text string")
    rows = sorted(h.extract(pages).collect())
    assert [(r.page_id, r.n_chars) for r in rows] == [(1, len(h.main_text(PAGE))), (2, 0), (2, 0)]
    assert h.extract(pages.limit(0)).count() == 0


def test_articles_of_the_sample(spark):
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"<b>|</b>|<br>", " ", inner)
        want = [" ".join(h.html.unescape(x).split()) for x in re.split(r"<[^>]+>", inner)]
        assert h.main_text(r.html) == "\n".join(x for x in want if x)


SOUP = """<html><body><div><a href="/a">Home</a></div><div><a href="/b">News today</a></div><div><div>
<div>{0}</div><div>Short line</div><div>{0}</div><div>Yes</div><div>{0}</div></div></div>
<div><span>Terms</span></div><div><a href="/c">Contact us here</a></div></body></html>"""


def test_the_cut_keeps_short_lines_between_long_ones_without_any_telling_element():
    long = "This is a sentence of some length that goes on with many words until it is clearly part of a story, as one sees in articles, and it ends here."
    found = h.blocks(SOUP.format(long))
    alone = [t for t, s, _ in found if s > 0]
    assert "Short line" not in alone and "Yes" not in alone
    assert h.main_text(SOUP.format(long)) == "\n".join([long, "Short line", long, "Yes", long])


def test_the_cut_changes_labels_of_real_pages_for_the_better(spark):
    """Against each page's article: labels by the sign of the scores are worse than those of the cut."""
    import re

    signs = cuts = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        found = h.blocks(r.html)
        inside = h.blocks(re.search(r"<article>.*?</article>", r.html, re.S)[0])
        truth = {t for t, _, _ in inside}
        keep = h.cut([s for _, s, _ in found], h.page_edges(found))
        signs += sum((s > 0) != (t in truth) for t, s, _ in found)
        cuts += sum(k != (t in truth) for (t, _, _), k in zip(found, keep))
    assert cuts < 0.2 * signs
