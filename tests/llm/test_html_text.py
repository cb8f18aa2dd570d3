from __future__ import annotations

import html
import re
import time

import pytest

from pulsegrid.llm.html_text import chosen, extract, main_text, read_page, scores
from pulsegrid.llm.support import table

PAGES = {
    "article": ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>One,  two\n three.<p>Four &amp; five&nbsp;six.<script>var x='</p>';</script></article><footer>f</footer></body></html>", "Head\n\nOne, two three.\n\nFour & five six."),
    "no article": ('<body><div id="menu"><a>Home</a> <a>About us</a></div><div class="content"><h2>Title</h2><p>A paragraph, with some text in it.</p><p>Another one; longer than the first, by far.</p></div><div class="sidebar"><p>Related, things, to, read.</p></div></body>', "Title\n\nA paragraph, with some text in it.\n\nAnother one; longer than the first, by far."),
    "comments": ('<article><p>Text of it.</p><section class="comments"><article class="comment"><p>No, I think, this is all wrong.</p></article></section></article>', "Text of it."),
    "parts": ('<article><header>H</header><p>Kept text.</p><aside>a</aside><form><p>Name: <input></p></form><div class="ad">Buy!</div><div class="cookie-notice">We use cookies.</div></article>', "Kept text."),
    "broken": ("<article><p><b>Head.<br><p>Body text<", "Head.\n\nBody text<"),
    "inline": ("<main><p>a<b>b</b><i>c</i> d<br>e</p></main>", "abc d e"),
    "table": ("<article><table><tr><td>1</td><td>2</td></tr></table><ul><li>x<li>y</ul></article>", "1\n\n2\n\nx\n\ny"),
    "hidden": ('<article><p hidden>no</p><p style="display: none">no</p><p>yes</p></article>', "yes"),
    "plain": ("Only text, no tags.", "Only text, no tags."),
    "empty": ("", ""),
    "null": (None, ""),
    "menus only": ("<body><nav><ul><li><a>x</a></ul></nav></body>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert main_text(page) == want


BODY = [f"Sentence {k} of the body, which is long enough to count; it goes on, and ends here." for k in range(6)]
_BODY = "".join(f"<p>{x}</p>" for x in BODY)
_CARD = '<article class="card"><h3>Teaser</h3><p>Read this, too.</p></article>'
LAYOUTS = {
    "teaser article": f'<body><div class="post"><h1>Title</h1>{_BODY}</div>{_CARD}</body>',
    "several teasers": f'<body>{_CARD * 3}<div class="post"><h1>Title</h1>{_BODY}</div>{_CARD * 5}</body>',
    "layout class": f'<body><div class="content with-sidebar"><h1>Title</h1>{_BODY}</div><div>Short words.</div></body>',
    "misnamed": f'<body><div class="promo"><h1>Title</h1>{_BODY}</div><div>Short words.</div></body>',
    "misnamed in article": f'<body><article><h1>Title</h1><div class="social">{_BODY}</div></article></body>',
    "article": f'<body><article><h1>Title</h1>{_BODY}<div class="comments"><p>I, for one, disagree; so there.</p></div></article><div>Short words.</div></body>',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_scores_choose_the_body(name):
    """Articles and names of parts are weights: the scores choose on every page."""
    got = main_text(LAYOUTS[name]).split("\n\n")
    assert [x for x in got if x in BODY] == BODY and (name.startswith("misnamed") or got == ["Title", *BODY])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_test_pages(spark, sf):
    """Against a plain reading of the test pages' one template."""
    pages = {r.page_id: r.html for r in table(spark, f"/root/testdata/{sf}", "pages").collect()}
    for r in extract(table(spark, f"/root/testdata/{sf}", "pages")).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def nameless(page):
    """The page with plain div elements for parts, and without names."""
    page = re.sub(r"<(/?)(article|main|nav|header|footer|aside|form|section|menu|dialog)\b", r"<\1div", page)
    return re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|\S+?)(?=[\s>])""", "", page)


@pytest.mark.parametrize("sf,pages,least", [("sf0.01", 250, 248)])
def test_scores_decide(spark, sf, pages, least):
    """On pages with names the scores alone choose the main element, and the same one gives the text; without tags and names to go by they find the same text."""
    rows = [r.html for r in table(spark, f"/root/testdata/{sf}", "pages").collect()]
    alone = sum(chosen(*read_page(page))[1] for page in rows)
    without = sum(main_text(nameless(page)) == main_text(page) for page in rows)
    assert len(rows) >= pages and alone >= least * len(rows) / pages and without >= least * len(rows) / pages


def test_scores_and_not_names_choose(monkeypatch):
    """With scores turned round in their place the main element is lost, on a page with names too."""
    from pulsegrid.llm import html_text

    page = LAYOUTS["layout class"].replace("<div>Short words.</div>", "<div>Short words.</div>" * 9)
    assert main_text(page).split("\n\n") == ["Title", *BODY]
    monkeypatch.setattr(html_text, "scores", lambda blocks, weights=None: 1 / (1 + scores(blocks, weights)))
    assert main_text(page).split("\n\n") != ["Title", *BODY]


def test_links_in_the_article_stay():
    """A paragraph that is all link is content; a list of links beside the paragraphs of an unnamed body is not."""
    page = f'<body><div><h1>Title</h1>{_BODY}<p><a href="x">{"All of this paragraph is linked, from end to end. " * 2}</a></p><ul>{"<li><a href=y>Other page</a></li>" * 5}</ul></div></body>'
    assert main_text(page).split("\n\n") == ["Title", *BODY, ("All of this paragraph is linked, from end to end. " * 2).strip()]


def test_comments_longer_than_the_article():
    comment = "<p>I, for one, disagree; so there, and this goes on, and on, for long.</p>" * 12
    for around in ('<section class="comments">{}</section>', '<div id="discussion">{}</div>', "<aside>{}</aside>"):
        assert main_text(f"<body><div><h1>Title</h1>{_BODY}</div>{around.format(comment)}</body>").split("\n\n") == ["Title", *BODY]


def test_ratios_prefer_long_punctuated_paths():
    _, blocks = read_page("<div><ul><li><a>aa</a><li><a>bb</a><li><a>cc</a></ul><p>Long text, of many words, and signs.</p><p>And more, of the same.</p></div>")
    found = scores(blocks)
    assert max(found[:2]) < min(found[3:])


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, 1), (None, None, "<p>x</p>", 2), (1, "u", "<p>x</p>", 3), (2, "v", "<p>" + "long text, " * 20000, 4)], "page_id long, url string, html string, text long")
    got = extract(rows).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, 1, 219999] and extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", "<div>x" * 20_000, "<a " * 40_000, "<svg>" * 20_000 + "x", "<b>x</i>" * 20_000, "<!-- " * 20_000, "<div><b>" * 4000 + "text, of words. " * 9 + "</p>" * 4000, "<article>" * 5000 + "x", "<p hidden>" * 5000 + "x"])
def test_odd_markup_takes_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 2
