"""HTML extraction: the field against brute force, layouts of another make, and pages that are hard to read."""

import itertools
import re
import time

import numpy as np
import pytest

from evidence_engine.llm import html_extract


def extract(page):
    return html_extract.main_text(page, html_extract.trained_field())


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_viterbi_is_the_best_of_all_labellings(n):
    rs = np.random.RandomState(n)
    for _ in range(20):
        scores, transitions, start = rs.randn(n, 2) * 2, rs.randn(2, 2), rs.randn(2)
        total = lambda y: start[y[0]] + sum(scores[t, y[t]] for t in range(n)) + sum(transitions[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=total)
        assert tuple(html_extract.viterbi(scores, transitions, start)) == best


def test_gradient_is_that_of_the_likelihood():
    rs = np.random.RandomState(1)
    feats, labels = [[1, 5], [2], [5, 7, 9], [1]], [0, 1, 1, 0]
    field = html_extract.Field(rs.randn(html_extract.HASHED, 2), rs.randn(2, 2), rs.randn(2))
    value, by_block, by_pair = html_extract.likelihood(field, feats, labels)
    # All labellings' probabilities sum to one.
    every = [html_extract.likelihood(field, feats, list(y))[0] for y in itertools.product((0, 1), repeat=4)]
    assert np.isclose(np.exp(every).sum(), 1) and value in every
    step = 1e-6

    def moved(k, at):
        parts = [x.copy() for x in field]
        parts[k][at] += step
        return (html_extract.likelihood(html_extract.Field(*parts), feats, labels)[0] - value) / step

    for f, rows in ((5, [0, 2]), (1, [0, 3]), (9, [2])):
        for y in (0, 1):
            assert np.isclose(moved(0, (f, y)), sum(by_block[t, y] for t in rows), atol=1e-4)
    for a, b in itertools.product((0, 1), repeat=2):
        assert np.isclose(moved(1, (a, b)), by_pair[a, b], atol=1e-4)
    assert np.isclose(moved(2, 1), by_block[0, 1], atol=1e-4)


#: Pages that no generator made, each with its main text.
PAGES = [
    # Straight in the body.
    ("<html><body><h1>A walk along the river</h1><p>We set out early, before the sun had come over the hill.</p><p>By noon we were at the bridge.</p></body></html>", "A walk along the river\nWe set out early, before the sun had come over the hill.\nBy noon we were at the bridge."),
    # A blog's usual frame.
    (
        '<body class="home blog"><div id="page"><header id="masthead" class="site-header"><a href="/">My blog</a><nav class="main-navigation"><ul><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li></ul></nav></header>'
        '<div id="content" class="site-content"><article class="post"><h1 class="entry-title">Bread</h1><div class="entry-content"><p>Mix flour, water and salt, and wait.</p><p>Then bake it for an hour.</p></div></article>'
        '<section id="comments" class="comments-area"><h2>2 comments</h2><ol><li><p>Tried it, works well for me.</p></li></ol></section></div>'
        '<aside id="secondary" class="widget-area"><h2>Archive</h2><ul><li><a href="/1">May</a></li></ul></aside><footer class="site-footer">&copy; 2020 My blog. All rights reserved.</footer></div></body>',
        "Bread\nMix flour, water and salt, and wait.\nThen bake it for an hour.",
    ),
    # A layout table of the last century.
    ('<body><table border=0><tr><td width=100><a href="a.html">Start</a><br><a href="b.html">Links</a></td><td><h2>My garden</h2><p>The roses are in flower now, and so are the lilies.<p>Last week it rained on every day.</td></tr></table></body>', "My garden\nThe roses are in flower now, and so are the lilies.\nLast week it rained on every day."),
    # Another alphabet, and text of links within the article.
    ("<body><nav><a href=/>Главная</a> <a href=/x>Новости</a></nav><main><h1>Новая книга</h1><p>Вышла новая книга о городе, и в ней много старых карт.</p><ul><li><a href=/b>Читать первую главу этой книги</a></li></ul></main></body>", "Новая книга\nВышла новая книга о городе, и в ней много старых карт.\nЧитать первую главу этой книги"),
    ("<body><article><h1>山</h1><p>我们一早出发，太阳还没有出来。</p><p>中午到了桥上，大家都很高兴。</p></article><footer>© 2021</footer></body>", "山\n我们一早出发，太阳还没有出来。\n中午到了桥上，大家都很高兴。"),
    ('<div class="cookie-banner">We use cookies. <button>OK</button></div><main><p>One thing leads to another, they say.</p><div class="ad">Buy now!</div><p>And so it went on for years.</p></main><form><label>Search</label><input></form>', "One thing leads to another, they say.\nAnd so it went on for years."),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_layouts_of_another_make(k):
    page, text = PAGES[k]
    assert extract(page) == text


def test_only_raw_elements_hide_text():
    page = "<article><h1>Sums</h1><p>As we know, <math><mi>a</mi> + <mi>b</mi></math> is a sum of two terms.</p><noscript><p>Without scripts you read this, too.</p></noscript><object><p>No plug-in is needed to read it here.</p></object>"
    assert extract(page + "</article>") == "Sums\nAs we know, a + b is a sum of two terms.\nWithout scripts you read this, too.\nNo plug-in is needed to read it here."
    unclosed = "<article><p>Before the drawing there is text.</p><svg width=3><path d='M0'><p>After the drawing there is more of it.</p></article>"
    assert extract(unclosed) == "Before the drawing there is text.\nAfter the drawing there is more of it."
    closed = "<article><p>Before the drawing there is text.</p><svg><text>axis label</text></svg><template><p>inert text</p></template><p>After the drawing there is more of it.</p><script>var a = '<p>no</p>'</article>"
    assert extract(closed) == "Before the drawing there is text.\nAfter the drawing there is more of it."


def test_deep_pages_are_read_in_linear_time():
    took = []
    for n in (4_000, 16_000):
        page = "".join(f'<div class="{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x{k}">word {k}, and so on.' for k in range(n))
        began = time.perf_counter()
        blocks = html_extract.leaf_blocks(page)
        assert len(blocks) == n and len(html_extract.features(blocks)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_bytes_that_are_no_text(spark):
    pages = spark.createDataFrame([(1, "u", bytearray(b"<article><p>Some words \xff\xfe and more, as it is.</p></article>"))], "page_id long, url string, html binary")
    got = html_extract.extract(pages.selectExpr("page_id", "url", "cast(html as string) as html")).first().text
    assert got.startswith("Some words ") and got.endswith(" and more, as it is.")


@pytest.mark.parametrize("page", [
    "<p>One single paragraph only with a handful of plain words.</p>", "One single text without a tag and a handful of plain words.", "Short text", "<h1>Title of it</h1><p>And one paragraph, not a long one.</p>",
    "<html><head><title>T</title></head><body><p>Das ist der ganze Text der Seite, sonst nichts.</p></body></html>", "<div>Всего один абзац на странице.</div>", "<article><p>只有一段文字的页面。</p></article>", "line one\nline two\nline three of a plain file",
])
def test_pages_of_main_text_alone(page):
    want = [" ".join(re.sub("<[^>]*>", " ", x).split()) for x in re.split("</h1>", re.sub("<head>.*</head>", "", page))]
    assert extract(page) == "\n".join(want)


def test_letters_that_grow_in_lower_case():
    """The lower case of U+0130 is two code points; what follows a script must stay in its place."""
    para = "<p>" + "İstanbul ve çevresi, uzun bir yazı olarak burada durur. " * 20 + "</p>"
    page = f"<html><body><article><h1>Başlık</h1>{para}<SCRIPT>var a = '</p>';</ScRiPt>{para}<style>p {{}}</STYLE>{para}</article></body></html>"
    assert extract(page) == extract(page.replace("İ", "I")).replace("Istanbul", "İstanbul")
    assert extract(page).count("İstanbul") == 60
    # U+017F and U+212A fold to s and k in Unicode, but not in HTML.
    assert [b.text for b in html_extract.leaf_blocks("<p>a<script>x</\u017fcript>y</script>b")] == ["ab"]


@pytest.mark.parametrize("tag", ["<svg>", "<template>", "<svg><template>", "<p><svg>"])
def test_many_tags_without_an_end_are_linear(tag):
    html_extract.leaf_blocks(tag * 2000)
    began = time.process_time()
    html_extract.leaf_blocks(tag * 40_000 + "text")
    assert time.process_time() - began < 1.0
    assert html_extract.leaf_blocks(tag * 3 + "text")[-1].text == "text"
