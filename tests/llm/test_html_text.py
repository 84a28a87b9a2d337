from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notemill.llm.html_text import MARKED, ONE, SURGE, WINDOW, Line, between_surge_and_dive, blocks, extract_pages, lines_of, main_text, weights
from notemill.llm.queries import op3_line_block_extraction

LONG = "Some words that a reader would read, at length and with care, in a paragraph of its own here."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("no markup and short", "no markup and short"),
        (f"<article><h1>Title &amp; more</h1><p>a</p><p>b\n  c&nbsp;d</p></article><footer>{LONG}</footer>", "Title & more a b c d"),
        (f"<div><a href=x>Home</a></div><p>{LONG}</p><p>End.</p><div class='comments'><p>{LONG}</p></div>", f"{LONG} End."),
        (f"<nav>{LONG}</nav><p>{LONG}</p><script>var x='</p><p>{LONG}';</script><style>p{{}}</style><!-- {LONG} -->", LONG),
        (f"<p>{LONG}<form><input name=q>{LONG}</form>", LONG),
        (f"<article>one<b>two</b><aside>{LONG}</aside><p>three", "onetwo three"),
        ("<article>" + "<p>x</p>" * 3 + "<nav>" + "<li>m</li>" * 9 + "</nav>" + "<p>y</p></article>", "x x x y"),
        (f"<div id=cookie-notice>{LONG}</div><main><p>&lt;tag&gt; &#233;&#xe9;</p></main>", "<tag> éé"),
        # End tags that are left out.
        (f'<p class="share">x<p>{LONG}', LONG),
        (f"<ul><li class=nav>x<li>{LONG}</ul><p>{LONG}", f"{LONG} {LONG}"),
        (f"<div><p class=ad>x</div><p>{LONG}", LONG),
        (f"<table><tr><td class=sidebar>{LONG}<td>{LONG}<tr><td>y</table>", f"{LONG} y"),
        (f"<p><a href=x>open link</p><p>{LONG}</p>", LONG),
        # Captions, paragraphs of one link and classes that only hint at furniture, in an article.
        (f"<article><p class='related'>{LONG}</p><p class=share>x</p><figure><figcaption>cap</figcaption></figure><p><a href=x>one link</a></p></article>", f"{LONG} cap one link"),
        (f"<p>{LONG}</p><p><a href=x>a linked line between prose</a></p><p>{LONG}</p>", f"{LONG} a linked line between prose {LONG}"),
        # Without an article tag: what lies beyond a dive and does not surge goes.
        (f"<div><p>Site name</p></div></div><div><div><p>{LONG}</p><p>Two.</p></div></div><div><p>All rights reserved</p></div>", f"{LONG} Two."),
        ("<div><p>A short article of few words.</p><p>Its end.</p></div></div><div><div><p>Made by me</p></div>", "A short article of few words. Its end."),
        # With one: the windows decide. Text beside it must be denser by far; where it is, an article that does not surge is lost.
        (f"<article><p>The beginning.</p></article><div><p>{LONG}</p></div>", "The beginning."),
        (f"<article><p>The beginning.</p></article><div><p>{LONG * 5}</p></div>", LONG * 5),
        (f"<article><p>{LONG}</p><p>x</p></article><div><p>{LONG * 5}</p></div>", f"{LONG} x {LONG * 5}"),
        (f"<article><p>{LONG}</p></article><article><p>Teaser.</p></article>", LONG),
        # Names of furniture lower a weight and bar nothing: an article within is whole, and dense text outweighs them.
        (f'<div class="post widget-area"><article><p>{LONG}</p><p>b</p></article></div><p>{LONG}</p>', f"{LONG} b"),
        (f'<div class="main-header-wrap"><p>{LONG}</p></div>', LONG),
        (f'<article><div class="header-image-post"><p>{LONG}</p></div></article>', LONG),
        (f'<div class="main-header-wrap"><p>{LONG * 8}</p></div><p>{LONG}</p>', f"{LONG * 8} {LONG}"),
        (f'<article><p>{LONG}</p><div class="comments"><p>{LONG * 8}</p></div><p>c</p></article>', f"{LONG} c"),
        (f'<article><p>{LONG}</p><div class="share-box"><div><p>x</p></article><p>{LONG}</p>', LONG),
        (f"<aside><article><p>{LONG}</p></article></aside><p>End.</p>", "End."),
        (f"<article><p>{LONG}</p><aside><article>x</article></aside><p>d</p></article><p>y</p>", f"{LONG} d"),
        (f"<article><p>{LONG}</p><aside><p>x</article><div><p>{LONG}</p></div>", LONG),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def brute_force(weighed):
    """The blocks, where every place is looked at by itself, with sums made anew."""
    total = lambda i: sum(weighed[i : i + WINDOW])
    dives = [i for i in range(len(weighed)) if total(i) == 0]
    since = lambda i: max([d for d in dives if d <= i], default=-1) + 1
    places = [[i for i, w in enumerate(weighed) if w and since(i) == s] for s in sorted({since(i) for i in range(len(weighed))})]
    return [(max(total(i) for i in p), p) for p in places if p]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 5, 30, 45, 81, 200]), max_size=25))
def test_blocks_against_brute_force(weighed):
    assert blocks(weighed) == brute_force(weighed)


def kept_by_hand(lines, surge):
    flows = sorted({x.flow for x in lines})
    found = []
    for f in flows:
        places = [i for i, x in enumerate(lines) if x.flow == f]
        w = weights([lines[i] for i in places])
        found += [(most, sum(w[i] for i in p), [places[i] for i in p]) for most, p in brute_force(w)]
    return sorted(i for most, _, p in found if most > surge for i in p) or max(found, key=lambda b: (b[1], -b[2][0]), default=(0, 0, []))[2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 3, 12, 45, 130]), st.sampled_from([0, 0, 0, 1]), st.sampled_from([0, 0, 1, 2]), st.sampled_from([1, 8, 1 / 8])), max_size=20))
def test_surge_and_dive_against_brute_force(made):
    lines = [Line("x" * n, kind if n else 2, flow, share) for n, kind, flow, share in made]
    for surge in (ONE * SURGE, ONE * SURGE * MARKED):
        assert between_surge_and_dive(lines, surge) == kept_by_hand(lines, surge)


def test_windows_decide_on_pages_of_the_tables(spark, sf):
    """An article is kept since its block surges and no other does, or, short as it is, since it weighs most."""
    surged = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        lines, marked = lines_of(r.html)
        article = [i for i, x in enumerate(lines) if x.share > 1]
        surge = ONE * SURGE * MARKED
        assert marked and between_surge_and_dive(lines, surge) == kept_by_hand(lines, surge) == article
        surged.append(max(most for most, _ in blocks(weights([lines[i] for i in article]))) > surge)
    assert 0.5 < sum(surged) / len(surged) < 1


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_pages_without_their_article_tag(spark, sf, size):
    """The same pages, bare of the tag: the windows alone find the article."""
    rows = spark.read.parquet(f"{sf.replace('0.001', size)}/pages.parquet").collect()
    same = [main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>")) == main_text(r.html) for r in rows]
    assert sum(same) >= 0.99 * len(same)


def test_query_against_the_article_itself(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = op3_line_block_extraction(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        article = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        for tag in ("p", "h1", "br"):
            article = article.replace(f"<{tag}>", " ").replace(f"</{tag}>", " ")
        assert r.text == " ".join(unescape(article.replace("<b>", "")).split())
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string"
    long = f"<article>{'<p>word</p>' * 50000}</article>"
    rows = [(1, None, None, "clash"), (None, "u", "", None), (2, "u", long, None), (2, "u", long, None), (3, "u", "<" * 5000 + "<p '" * 2000, None), (4, "u", f"<nav>{LONG}</nav>", None)]
    out = extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert [r.n_chars for r in out][:4] == [0, 0, 249999, 249999] and out[5].text == ""
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0
