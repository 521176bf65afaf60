"""Main text of pages."""

import random
from collections import Counter

from strata.llm.html_text import content_lines, extract, main_text, smooth
from tests.llm.helpers import PROSE

LONG = "A paragraph that is long enough to look like the text of an article, with words."
PAGE = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><nav><a href="/">Home</a> <a href="/b">B</a></nav></header><div class="ad">Buy  now</div><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>{LONG}<br><p>Second&nbsp;line
   with	space.</p><p>Ok.</p><aside>Side</aside><ul><li>One<li>Two</ul><form><label>Mail</label><input></form></article>
<section id="comments"><p>{LONG} says a reader.</p></section><footer>&copy; Foot</footer></body></html>"""


def test_article_without_its_surroundings():
    assert extract(PAGE) == f"Title & more\n{LONG}\nSecond line with space.\nOk.\nOne\nTwo"


def test_pages_without_marked_article():
    page = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")
    assert extract(page) == extract(PAGE)


def test_odd_pages():
    assert [extract(x) for x in (None, "", "   ", "<p></p>", "<script>x")] == [""] * 5
    assert extract("plain words") == "plain words"
    assert extract(f"<article><p>{LONG}") == LONG
    assert extract(f"<article><p>{LONG} &lt;b&gt; &#233; &eacute; &bogus;</p>") == f"{LONG} <b> é é &bogus;"
    assert extract(f"<article><p>{'x ' * 60000}</p></article>") == ("x " * 60000).strip()
    assert extract(f'<article><p>{LONG}</p><div class="related"><p>{LONG}</p></div><article class="comment"><p>{LONG}</p></article></article>') == LONG
    assert extract(f"<article><p>one<!-- no --> two</p><p hidden>no</p><p style='display: none'>no</p><p>{LONG}</p>") == f"one two\n{LONG}"


def test_article_inside_marked_wrappers():
    for name in ("layout has-sidebar", "no-sidebar", "page with-header", "content-sidebar-wrap", "comments-enabled", "sidebar"):
        for page in (f'<div class="{name}"><article><p>{LONG}</article></div>', f'<main id="{name}"><p>{LONG}</main>', f'<form id="f"><div class="{name}"><main><div class="widget"><article>{LONG}</article></div></main></div></form>'):
            assert extract(f"<body>{page}<footer>Foot</footer></body>") == LONG, (name, page)
    comments = f'<section id="comments"><article class="comment"><p>{LONG}</p></article></section>'
    wrapped = f'<div class="content-sidebar-wrap"><article><p>{LONG}</p></article><div class="related"><article>Teaser</article></div>{comments}</div>'
    assert extract(f"<body>{wrapped}</body>") == LONG
    assert extract(f'<body><div class="content"><p>{LONG}<p>{LONG}</div>{comments}</body>') == f"{LONG}\n{LONG}"
    assert extract(f"<body><article>Short.</article>{comments}</body>") == "Short."
    assert extract(f'<body><div hidden><article>{LONG}</article></div><p>Shown</body>') == "Shown"


def test_left_out_end_tags():
    assert extract(f"<html><head><title>No</title><meta charset=utf-8><body><article><p>{LONG}</article>") == LONG
    assert extract(f"<html><head><title>No</title><style>p{{}}</style><p>{LONG}") == LONG
    assert extract(f"<head><title>No</title>{LONG}") == LONG
    assert extract(f"<head><template><article>No</article></template></head><p>{LONG}") == LONG
    for tag in ("div", "article", "h2", "section", "ul", "table", "blockquote"):
        assert extract(f'<body><p class="ad">Buy <b>now<{tag}>{LONG}</{tag}>') == LONG, tag
    assert extract(f'<article><ul><li class="ad"><b>Buy<li>{LONG}</ul><dl><dt class="ad">Buy<dd>Yes</dl>') == f"{LONG}\nYes"
    assert extract(f'<article><table><tr class="ad"><td>Buy<tr><td class="ad">Buy<td>{LONG}</table>') == LONG


def test_smoothing_keeps_a_level_and_selection_its_ends():
    assert list(smooth([1.0, 1.0, 1.0])) == [1.0] * 3
    assert content_lines([], [0], [""]) == []
    lines = [("Menu", 9, 0, False, True), ("Menu", 9, 0, False, True), ("Menu", 9, 0, False, True), ("Head", 1, 0, True, False), (LONG, 2, 0, False, False), ("Hm.", 2, 0, False, False), (LONG, 2, 0, False, False), ("End.", 9, 0, False, False), ("x", 30, 0, False, True), ("y", 30, 0, False, True)]
    assert content_lines(lines, [0], [""]) == ["Head", LONG, "Hm.", LONG, "End."]


def test_whole_words_of_names_mark():
    for name in ("post-comments", "main-nav", "main-sidebar", "main-menu", "entry-footer", "article-ads", "article-share", "story-promo", "post-related", "adSlot", "ad_slot", "cookie-notice", "siteHeader", "comments-list", "x sidebar2", "related-posts", "ad-300x250", "nav-primary", "skip-link", "comment-body", "widget_area", "sponsored-content", "share-this"):
        assert extract(f'<article><p>{LONG}</p><div class="{name}">{LONG}</div></article>') == LONG, name
    for name in ("related-work", "share-price", "search", "promotion", "newsletter-study", "menu-planning", "header-image caption", "shadow", "badge", "entry-header", "advice", "noticeable", "comment-free"):
        assert extract(f'<article><p>{LONG}</p><div class="{name}">{LONG}</div></article>') == f"{LONG}\n{LONG}", name


def test_unclosed_comments_swallow_the_rest():
    assert extract("<p>x</p><!-- <p>c") == "x" and extract(f"<article><p>{LONG}<!-- a -- b > c") == LONG


def labelled_pages(seed: int, n: int):
    """(html, article lines): pages in several make-ups, with and without telling tags and names."""
    rng = random.Random(seed)
    vocabulary = PROSE.split()
    said = lambda low, high: " ".join(rng.choices(vocabulary, k=rng.randrange(low, high))).capitalize() + "."
    for _ in range(n):
        article = [said(4, 9)] + [said(25, 90) for _ in range(rng.randrange(3, 9))]
        article[1:1] = [said(3, 6)] * rng.randrange(2)
        links = lambda k: "".join(f'<li><a href="/{i}">{said(1, 3)}</a></li>' for i in range(k))
        body = f"<h1>{article[0]}</h1>" + "".join(f"<p>{x}</p>" for x in article[1:])
        around = [f"<div><ul>{links(6)}</ul></div>", f"<div><a href='/'>{said(2, 4)}</a> <a href='/in'>{said(1, 3)}</a></div>", f"<div><b>{said(2, 6)}</b> <a href='/buy'>{said(1, 3)}</a></div>"]
        rng.shuffle(around)
        foot = f"<div><p><a href='/a'>{said(1, 3)}</a> | <a href='/b'>{said(1, 3)}</a></p><p>{said(2, 7)}</p></div>"
        wrapped = rng.choice((body, f"<div>{body}</div>", f"<div><div>{body}</div></div>", f"<article>{body}</article>", f"<section>{body}</section>"))
        yield f"<html><head><title>t</title></head><body>{''.join(around)}{wrapped}{foot}</body></html>", article


def quality(pages, **method):
    """Precision and recall of the words found."""
    hit = found = wanted = 0
    for html, article in pages:
        got, want = Counter(extract(html, **method).split()), Counter(" ".join(article).split())
        hit, found, wanted = hit + (got & want).total(), found + got.total(), wanted + want.total()
    return hit / found, hit / wanted


def test_precision_and_recall_on_labelled_pages():
    """No page has a telling name, so the method alone decides; each part of it matters."""
    pages = list(labelled_pages(3, 200))
    precision, recall = quality(pages)
    assert precision > 0.99 and recall > 0.995
    assert quality(pages, ratios=False)[0] < precision - 0.01 and quality(pages, threshold=0)[0] < precision - 0.01
    assert quality(pages, sigma=0)[1] < recall


def test_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "5 as n_chars")
    got = main_text(pages).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(extract(PAGE)))] * 2 + [(None, 0)] and got[0].text == extract(PAGE)
    assert main_text(pages.limit(0)).count() == 0
