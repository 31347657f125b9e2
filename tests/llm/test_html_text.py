"""Main text of pages of many shapes."""

import duckdb
import html
import re
import time

import pytest
from pyspark.sql import types as T

from millrace.llm import html_text as ht

P = "<p>One two three.</p><p>Four &amp; five.</p>"
WANT = "One two three.\nFour & five."

CASES = [
    (f"<body><nav><a href=x>menu</a></nav><article>{P}</article><footer>foot</footer></body>", WANT),
    (f"<header>Site</header><main>{P}</main><aside>side</aside>", WANT),
    (f"<div id='header'>Site</div><div class='post'>{P}</div><div class='sidebar left'>side</div>", WANT),
    (f"<div>{P}</div><div id=comments><p>A reader says much.</p></div>", WANT),
    (f"<article>{P}<section class='comment-list comments'>reader</section></article>", WANT),
    (f"<article><div class='ad'>Buy!</div>{P}<form><input>Send</form></article>", WANT),
    (f"<article>{P}<script>var t='</p>';</script><style>p{{}}</style></article>", WANT),
    (f"<div class=cookie-notice>We use cookies</div><div role='main'>{P}</div><div role=contentinfo>c</div>", WANT),
    ("<article><h1>T</h1><p><b>Bold.<br><p>Next  \n line<br>more</article>", "T\nBold.\nNext line more"),
    ("<article>a &lt;b&gt; &eacute;&#233;&#xe9; &am &nosuch; 1 < 2</article>", "a <b> ééé &am &nosuch; 1 < 2"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ("<article>x<!-- <p>no</p> -->y<p title='a>b'>z</p></article>", "xy\nz"),
    ("<article>in<i>li</i>ne <a href=#>link</a> text</article>", "inline link text"),
    ("<article><p>cut off <b", "cut off"),
    ("<article><p>kept</p><div hidden>no</div><div style='display:none'>no</div></article>", "kept"),
    ("<p>no article</p><p>at all</p><ul class=menu><li><a>x</a></ul>", "no article\nat all"),
    ("<nav>only</nav><footer>boilerplate</footer>", ""),
    ("<article class='post has-sidebar'><p>Body</p></article>", "Body"),
    ("plain text", "plain text"), ("", ""), ("<", "<"), ("</p>", ""),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_pages(page, text):
    assert ht.main_text(page) == text


def test_surge_and_dive():
    assert ht.bounds([0, 0, 5, 0, 0, 0, 9, 0]) == (2, 7)
    assert ht.bounds([0, 0]) == (0, 0) and ht.bounds([]) == (0, 0) and ht.bounds([1]) == (0, 1)


LONG = "A sentence of the text that goes on for long enough to be more than any menu."
DIVS = "".join(f"<div>{LONG} {i}</div>" for i in range(4))
TEXT = "\n".join(f"{LONG} {i}" for i in range(4))
LINKS = "".join(f"<div><a href=x>Page {i}</a></div>" for i in range(5))


def test_blocks_fall_apart_at_a_dive_and_faint_ones_go():
    assert ht.blocks([60, 90, 0, 0, 0, 5, 0, 0, 0, 70, 40]) == [(0, 2), (9, 11)]
    assert ht.blocks([60, 0, 0, 90]) == [(0, 4)] and ht.blocks([0, 0]) == ht.blocks([]) == []


@pytest.mark.parametrize(("page", "text"), [
    (f"<div>{LINKS}</div><div>{DIVS}</div><div>{LINKS}</div><div>All rights kept 2020</div>", TEXT),
    (f"<div>Welcome!</div><div>{LINKS}</div><div>{DIVS}</div>", TEXT),
    (f"<div>{DIVS}</div><div>{LINKS}</div><div>{DIVS}</div>", f"{TEXT}\n{TEXT}"),
])
def test_surges_without_article_or_telling_names(page, text):
    assert ht.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    (f"<div>{LINKS}</div><h1><a href=x>Title</a></h1>{DIVS}", f"Title\n{TEXT}"),
    (f"{DIVS}<p><a href=x>A reference, linked</a></p>{DIVS}", f"{TEXT}\nA reference, linked\n{TEXT}"),
    (f"<div class='entry-header'><h1>Title</h1></div>{DIVS}", f"Title\n{TEXT}"),
    (f"{DIVS}<p><a href=x>A &amp; &amp; &amp; &amp; B</a> and a few words more</p>{DIVS}", f"{TEXT}\nA & & & & B and a few words more\n{TEXT}"),
    (f"<article><h2 id='related-work'>Related work</h2>{P}</article>", f"Related work\n{WANT}"),
    (f"<article><section id='social-history'>{P}</section></article>", WANT),
    (f"<article><section id='comments'>{P}</section><div class='ad-slot'>Buy!</div><div class='share-buttons'>Send</div></article>", WANT),
    (f"<article><h2 id='form-of-government'>Form</h2><div class='entry-header'>{P}</div></article>", f"Form\n{WANT}"),
    (f"<div><h2 id='related-work'>Related work</h2>{DIVS}</div>", f"Related work\n{TEXT}"),
    (f"<div><section id='social-history'>{DIVS}</section></div>", TEXT),
    (f"<div class='social-bar'>Follow us</div><div>{DIVS}</div><div class='related-posts'><div>{LONG}</div></div>", TEXT),
])
def test_names_and_links_take_nothing_from_the_text(page, text):
    assert ht.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    (f"<article><p>A teaser.</p></article><div>{DIVS}</div>", TEXT),
    (f"<div>{DIVS}</div><article><h2>Another story</h2><p>Its first line.</p></article>", TEXT),
    (f"<div>Home | About | Contact</div><div>News</div><div>x</div><div>y</div><div>{DIVS}</div>", TEXT),
    (f"<article><p class='lead related'>Kept lead</p>{DIVS}</article><div>{LONG}</div>", f"Kept lead\n{TEXT}"),
    (f"<article><p>One.</p><p>{LONG}</p></article><div>{LONG}</div>", f"One.\n{LONG}"),
])
def test_teasers_plain_menus_and_articles(page, text):
    assert ht.main_text(page) == text


def test_surge_and_dive_decide(monkeypatch):
    page = f"<div>Welcome!</div><div>{LINKS}</div><div>{DIVS}</div><div>{LINKS}</div><div>Bye</div>"
    assert ht.main_text(page) == TEXT
    monkeypatch.setattr(ht, "blocks", lambda lengths: [(0, len(lengths))])
    assert ht.main_text(page) != TEXT


@pytest.mark.parametrize("stray", ["<b>{n}</i>", "<b>{n}<div></div>", "<p><td>{n}<div></div>", "</x>{n}<i>"])
def test_stray_tags_take_linear_time(stray):
    def took(n):
        page = "".join(x * n for x in stray.split("{n}")) + "text"
        began = time.process_time()
        assert ht.main_text(page) == "text"
        return time.process_time() - began

    took(100)
    assert took(20000) < 2.0


def test_table(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    rows = [(1, "u", CASES[0][0], "x"), (1, "u", CASES[0][0], "x"), (None, None, None, None), (2, "v", "", None)]
    got = sorted(map(tuple, ht.extract(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, "u", WANT, len(WANT))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert ht.extract(spark.createDataFrame([], schema)).count() == 0


def test_supplied_pages_against_a_plain_cut(spark):
    rows = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    for _, page in rows:
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        assert ht.main_text(page) == "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in blocks) if x)
