import html
import re

import pytest

from tidemark.llm import html_extraction as H

LONG = "Some long paragraph of text with many words in it, so that its ratio is high."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer>", f"Head\n{LONG}\nShort."),
        (f"<article><p><b>{LONG}<br>more<p>two &amp; three&nbsp;four</p></article>", f"{LONG} more\ntwo & three four"),
        (f"<div id='top-menu'>Home</div><div class=content><p>{LONG}</p><ul><li>a<li>b</ul><div class='comments'><p>{LONG}</p></div></div><div class=sidebar>{LONG}</div>", f"{LONG}\na\nb"),
        (f"<main><header><h1>In</h1></header><p>{LONG}</p><form><p>Name</p></form><aside>{LONG}</aside><div class='ad'>Buy</div></main>", f"In\n{LONG}"),
        (f"<article><p>{LONG}<div class='cookie-notice'>We use cookies.</div><p>end</article>", f"{LONG}\nend"),
        (f"<article><p>{LONG}</p><p>cut off", f"{LONG}\ncut off"),
        ("<nav>a</nav>", ""),
        ("", ""),
    ],
)
def test_pages(body, text):
    assert H.main_text(page(body)) == text


def test_odd_input():
    assert H.main_text("") == "" and H.main_text("<") in ("", "<") and H.main_text("plain words only") == "plain words only"
    assert H.main_text("<p>" * 3000 + "deep") == "deep"
    assert len(H.main_text(page("<article><p>" + "word " * 200_000 + "</p></article>"))) == 999_999


def test_query_equals_articles_of_the_test_pages(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in H.op10_html_extraction(spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for i, p in pages.items():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[i].text == "\n".join(b for b in blocks if b)
        assert got[i].n_chars == len(got[i].text) and got[i].url == p.url


def test_nulls_names_and_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, page(f"<p>{LONG}"), "b")], "page_id long, html string, n_chars string")
    assert sorted((r.text, r.n_chars) for r in H.extract_main_text(df).collect()) == [("", 0), ("", 0), (LONG, len(LONG))]
    assert H.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<div><h1>Title</h1><div class=b>{f'<p>{LONG}</p>' * 20}</div><p>{LONG[:60]}</p></div>", "\n".join(["Title", *[LONG] * 20, LONG[:60]])),
        *[(f"<nav>Menu</nav><div class='{c}'><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><div class=sidebar>Links</div></div>", f"Head\n{LONG}\n{LONG}") for c in ("content has-sidebar", "layout--with-sidebar", "post comments-open", "elementor-widget")],
        (f"<div class='page has-sidebar'><article><p>{LONG}</p><p>{LONG}</p></article><div class='comments'>{f'<p>{LONG}</p>' * 5}</div></div>", f"{LONG}\n{LONG}"),
    ],
)
def test_no_main_text_is_lost_to_thresholds(body, text):
    assert H.main_text(page(body)) == text


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<article><h2 class='section-header'>Part</h2><p>{LONG}</p></article>", f"Part\n{LONG}"),
        (f"<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p></article>", f"Title\n{LONG}"),
        (f"<div class='post'><div class='post-header'><h1>Title</h1></div><p>{LONG}</p><p>{LONG}</p></div><div class='site-footer'>Imprint</div>", f"Title\n{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><figure class='media-widget'><figcaption>A caption.</figcaption></figure><div class='media-widget'>Told.</div><div class='widget'>Links</div></article>", f"{LONG}\nA caption.\nTold."),
        (f"<article><p>{LONG}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>", f"{LONG}\nSo x=2 holds."),
        (f"<article><p>{LONG}</p><p>{LONG}</p></article><article class='comment'><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
        (f"<article class='post comments-open'><p>{LONG}</p><article id='comment-7'><p>{LONG}</p></article><section class='comments'><article><p>{LONG}</p></article></section></article>", LONG),
        (f"<article class='post social-history comments-closed'><p>{LONG}</p></article><article class='post'><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
        (f"<article><p class='byline'>By A. Writer</p><p>{LONG}</p><div class='share-buttons'>Share</div><div class='footer'>Filed under x</div><p class='ad'>Buy</p></article>", f"By A. Writer\n{LONG}"),
        (f"<article><p>{LONG} One<script>var a = '<p>';</script> block <svg><text>icon</text></svg>stays <button>Buy</button>whole.</p></article>", f"{LONG} One block stays whole."),
        (f"<div role='banner'>Site</div><div class='main-nav'>Home</div><div><p>{LONG}</p><p>{LONG}</p></div><div role='contentinfo'>Imprint</div>", f"{LONG}\n{LONG}"),
    ],
)
def test_names_of_classes(body, text):
    assert H.main_text(page(body)) == text
