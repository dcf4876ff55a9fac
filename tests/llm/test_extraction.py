import itertools
import random
import re
import time
from html import unescape

import pytest

from lodestone.llm import extraction as ex


def test_min_cut_equals_enumeration():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 8)
        a, b = ([rng.random() * 3 for _ in range(n)] for _ in range(2))
        ties = {(i, j): rng.random() * 2 for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda x: sum(b[i] if x[i] else a[i] for i in range(n)) + sum(w for (i, j), w in ties.items() if x[i] != x[j])  # noqa: B023, E731
        best = min(cost(x) for x in itertools.product([True, False], repeat=n))
        assert abs(cost(ex.min_cut(a, b, ties)) - best) < 1e-9


def article(html):
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)>", inner)
    return " ".join(x for x in (" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks) if x)


def test_whole_articles(spark):
    rows = ex.op8_min_cut(spark, "/root/testdata/sf0.01").collect()
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(html)
    assert all(r.text == article(html[r.page_id]) and r.n_chars == len(r.text) for r in rows)


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<header class=top><a href=/>Site</a> name</header><div id="cookie-notice">We use cookies.</div>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="content"><h1>A &amp; B</h1><p>First para&shy;graph with   <b>bo</b>ld words, long enough to be an article's.
<p>Short.<p>Second paragraph is long as well, it has commas, and ends properly.</p>
<div class="ad">Buy this now, it is a very good thing to have at home.</div>
<p>Third paragraph &lt;tag&gt; goes on after the advert, as articles often do.</p></div>
<aside>More stories that you might like to read after this one.</aside>
<form>Name <input name=n> <button>Send</button></form>
<section class="comments"><article>A reader says that this was a good article indeed.</article></section>
<footer>&copy; us. All rights reserved, in every country of the world.</footer><!-- x --></body></html>"""


def test_other_markup():
    assert ex.main_text(PAGE) == "A & B First para\xadgraph with bold words, long enough to be an article's. Short. Second paragraph is long as well, it has commas, and ends properly. Third paragraph <tag> goes on after the advert, as articles often do."


def test_cases(spark):
    assert ex.main_text(None) == ex.main_text("") == ex.main_text("<p></p>") == ""
    assert ex.main_text("just text, no markup at all, of some length") == "just text, no markup at all, of some length"
    ex.main_text("<div " * 3000 + "x" + "<p class='a" * 3000 + "<b>" * 3000)
    assert ex.main_text("<article>" + "<p>Some text here.</p>" * 3000 + "</article>").count("Some text here.") == 3000
    df = spark.createDataFrame([(1, "<p>Some words of a text.</p>", 2)] * 2 + [(2, None, 3)], "page_id int, html string, url int")
    assert [r.text for r in ex.extract_text(df).orderBy("page_id").collect()] == ["Some words of a text."] * 2 + [""]
    assert ex.extract_text(df.limit(0)).count() == 0


def test_names_and_forms_around_the_whole_page():
    text = [f"Paragraph {i} of the article is long enough to be one, and has a second half." for i in range(6)]
    paragraphs = "".join(f"<p>{x}</p>" for x in text)
    nav, foot = "<nav><a href=a>One</a> <a href=b>Two</a></nav>", "<footer>All rights reserved, in every country of the world.</footer>"
    comments = "<div class='comments'>" + "<p>A reader says that this was a good article indeed, and goes on.</p>" * 30 + "</div>"
    for page in (
        f"<body class='single-post has-sidebar'>{nav}<article>{paragraphs}</article>{comments}{foot}</body>",
        f"<body class='comments-open'>{nav}<article>{paragraphs}</article>{foot}</body>",
        f"<body class='login menu'>{nav}<article>{paragraphs}</article>{foot}</body>",
        f"<body>{nav}<article class='post comments-open tag-ads'>{paragraphs}</article>{comments}{foot}</body>",
        f"<body>{nav}<div class='sidebar layout'><article class='share'>{paragraphs}</article>{comments}</div>{foot}</body>",
        f"<body><form action=x>{nav}<article>{paragraphs}</article>{comments}{foot}</form></body>",
        f"<body><form action=x>{nav}<div class='content'>{paragraphs}</div>{comments}{foot}</form></body>",
        f"<body>{nav}<div class='main'>{paragraphs}</div>{comments}{foot}</body>",
        f"<body class='widget'><main class='no-sidebar search'>{nav}<div class='text'>{paragraphs}</div>{comments}</main>{foot}</body>",
    ):
        assert ex.main_text(page) == " ".join(text), page[:80]


LONG = "This paragraph of the article is long enough to be prose, and it goes on for a while with commas, as articles do, until it ends properly after all."


def cut_changes(html):
    """Blocks whose label the cut changes, with their new one."""
    blocks, parent = ex.blocks_of(html)
    ex.classify(blocks)
    alone = [b.cost_boilerplate > b.cost_content for b in blocks]
    cut = ex.min_cut([b.cost_boilerplate for b in blocks], [b.cost_content for b in blocks], ex.ties_of(blocks, parent))
    return [(b.text, new) for b, old, new in zip(blocks, alone, cut, strict=True) if old != new]


def test_neighbours_decide_what_has_no_name():
    menu = "<div><div><a href=a>Home</a></div><div><a href=b>About us</a></div><div><a href=c>Contact</a></div></div>"
    body = f"<div><div>{LONG}</div><div>A short line</div><div>{LONG}</div><div>See <a href=x>this</a> too</div><div>{LONG}</div></div>"
    page = f"<html><body>{menu}{body}<div><div><a href=d>Next page</a></div><div>Page 3</div><div><a href=e>Last page</a></div></div></body></html>"
    assert ex.main_text(page) == f"{LONG} A short line {LONG} See this too {LONG}"
    changed = cut_changes(page)
    assert {("A short line", True), ("See this too", True)} <= set(changed)


def test_names_count_by_their_head():
    content = f"<p>{LONG}</p><p>{LONG}</p>"
    want = f"{LONG} {LONG}"
    nav = "<ul class='site-nav'><li><a href=a>Home</a></li></ul>"
    for body in (
        f"<body class='has-sidebar'><article>{content}</article></body>",
        f"<body class='single-post no-sidebar'>{nav}<article>{content}</article></body>",
        f"<body>{nav}<div class='main-content with-sidebar'>{content}</div></body>",
        f"<body>{nav}<div id='search-results-page'><main>{content}</main></div></body>",
        f"<body>{nav}<div class='post-body'>{content}</div><div class='comment-list'><p>{LONG}</p></div></body>",
        f"<body>{nav}<div class='entry'>{content}<div class='post-footer'>Filed under: things and others, as they were found.</div></div></body>",
        f"<body>{nav}<div>{content}</div><div class='ad-slot'>{LONG}</div><div class='cookie-banner-container'><p>{LONG}</p></div></body>",
    ):
        assert ex.main_text(body) == want, body[:90]


def test_inline_elements_with_names():
    page = f"<body><article><p>{LONG} <span class='ad'>Buy <span>it</span> now</span> And it goes on.</p><p><b class=x>Bold</b> words {LONG}</p></article></body>"
    assert ex.main_text(page) == f"{LONG} And it goes on. Bold words {LONG}"
    ex.main_text("<span class=ad>" * 2000 + "x" + "</span>" * 3000 + "</div><p class=ad><span>")


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<p>Some words of a text.</p>", 2)], "page_id int, html string, text int")
    found = ex.extract_text(df)
    assert found.columns == ["page_id", "html", "text", "_text"] and tuple(found.first())[2:] == (2, "Some words of a text.")


def test_comments_by_joined_and_foreign_names():
    said = "A paragraph of the article, with several sentences in it. It goes on about its subject, and it keeps going for a while."
    other = "I have read this too, and I want to say that I don't agree with any of it, sorry. Not at all, in fact, and never did."
    for name in ("commentlist", "commentList", "reader-responses", "kommentare", "commentThread", "CommentForm", "liste-commentaires", "adslot"):
        page = f"<body><main><h1>T</h1><p>{said}</p><p>{said}</p><div class='{name}'><p>{other}</p></div></main></body>"
        assert ex.main_text(page) == f"T {said} {said}", name
    for name in ("commentary", "adaptation", "Advice", "relatedness", "body-text", "mainContent", "sharepoint"):
        page = f"<body><main><h1>T</h1><p>{said}</p><div class='{name}'><p>{other}</p></div></main></body>"
        assert ex.main_text(page) == f"T {said} {other}", name


def test_pages_nested_very_deep():
    began = time.perf_counter()
    assert len(ex.main_text("<div>word " * 100_000).split()) in (0, 100_000)
    ex.main_text("<div>x" * 30_000 + "</p></b></section>" * 30_000)
    ex.main_text("<article><form>" + "<p>some words that are long enough to be read as prose <br>" * 20_000)
    assert time.perf_counter() - began < 30


def test_ties_fall_with_the_distance_in_the_tree():
    blocks, parent = ex.blocks_of("<div><p>one</p><p>two</p><section><div><p>three</p></div></section></div><p>four</p>")
    assert [b.text for b in blocks] == ["one", "two", "three", "four"]

    def way(x):
        return way(parent[x]) | {x} if x else {0}

    ties = ex.ties_of(blocks, parent)
    sums = {}
    for a, b in zip(range(3), range(1, 4), strict=True):
        sums[a, b] = ex.ADJACENT / (1 + len(way(blocks[a].node) ^ way(blocks[b].node)))
    for pair, least in sums.items():
        assert ties[pair] == pytest.approx(least + (ex.SIBLING / 2 if pair == (0, 1) else 0))
