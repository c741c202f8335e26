"""Main texts of pages of several makes."""

import random
import re
import time
from html import unescape

import pytest

from citeloom.llm.density import extract, main_text

BODY = ["The first paragraph of the article tells what happened, at some length, so that it counts.", "A second one goes on, with a <a href='/x'>link in it</a> and &quot;quotes&quot; &amp; more words.", "Short."]
TEXT = ["A title", "The first paragraph of the article tells what happened, at some length, so that it counts.", 'A second one goes on, with a link in it and "quotes" & more words.', "Short."]
PROSE = "".join(f"<p>{x}</p>" for x in BODY)
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(12)) + "</ul>"
NOTICE = "We use cookies to make this site better for you and for our partners all over the world, always."


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{MENU}</nav><article><h1>A title</h1>{PROSE}</article><footer>&copy; us</footer></body></html>",
        f"<body><header><p>Our site, the best of all sites there are</p></header><main><h1>A title</h1>{PROSE}<aside><p>{NOTICE}</p></aside></main></body>",
        f"<body><div class='cookie-notice'>{NOTICE}</div><div id=menu>{MENU}</div><div class=content><h1>A title</h1>{PROSE}</div><div class='sidebar'><p>{NOTICE}</p></div></body>",
        f"<body><div>{MENU}</div><div><h1>A title</h1><div>{PROSE}</div></div><div>{MENU}</div></body>",
        f"<body>{MENU}<h1>A title</h1>{PROSE}{MENU}</body>",
        f"<article><header><h1>A title</h1></header>{PROSE}<section class='comments'><h2>Comments</h2><p>{NOTICE}</p></section><footer>By me</footer></article>",
        f"<div class='has-sidebar'><article><h1>A title</h1>{PROSE}<div class='ad'>{NOTICE}</div></article></div>",
        f"<main><article><h1>A title</h1>{PROSE}<form><label>{NOTICE}</label><input></form><script>if (a < b) '</p>'</script></article><div role=complementary>{NOTICE}</div></main>",
        f"<body><div role='alert'>{NOTICE}</div><div hidden>{NOTICE}</div><div style='display: none'>{NOTICE}</div><article><h1>A title</h1><!-- <p>{NOTICE}</p> -->{PROSE}<noscript>{NOTICE}</noscript></article>",
        f"<div id=wrap class='no-sidebar'><h1>A title</h1>{PROSE}</div><div class='sideBar1'>{NOTICE}</div><div id='siteHeader'><h1>Site</h1></div><div class=adBox>{NOTICE}</div>",
        f"<article><div class='header'><h1 class='header'>A title</h1></div><div class=body>{PROSE}</div><div class='post-footer'>Tags</div><ul class='share-buttons'><li>Mail</ul></article>",
        f"<article><h1>A title</h1><p><b>{BODY[0]}<br><p>{BODY[1]}</p><p>{BODY[2]}",
        f"<ARTICLE><H1>A&nbsp;title</H1>\r\n<P>{BODY[0].replace(' ', '  ')}</P><P>{BODY[1]}</P></B></P></DIV><P>{BODY[2]}</P></ARTICLE><div class=comments><article class=comment><p>{NOTICE}</p></article></div>",
    ],
)
def test_layouts(html):
    got = main_text(html).split("\n")
    assert [x for x in got if x] == TEXT


def test_blocks_and_references():
    assert main_text("<article><p>a\n b<br>c</p>d<div>e</div><ul><li>f<li>g</ul><table><tr><td>h<td>i</table></article>") == "a b c\nd\ne\nf\ng\nh\ni"
    assert main_text("<article>1 &lt; 2 &amp;amp; 3 &#x41;&#66;&eacute;&copy &bogus; a < b <3</article>") == "1 < 2 &amp; 3 ABé© &bogus; a < b <3"
    assert main_text("<article><p>one <em>t<b>w</b>o</em><script>x()</script>three</p></article>") == "one twothree"


def test_nothing_to_find():
    for html in (None, "", " \n ", "<html></html>", f"<body><nav>{MENU}</nav><footer>x</footer></body>", "<script>x", "<!-- never ends", "<p", "</", "<a href='", "<div class=ad>Buy</div>"):
        assert main_text(html) == ""
    assert main_text("<") == "<"
    assert main_text("plain text &amp; no tags") == "plain text & no tags"


def test_short_articles_beside_long_notices():
    assert main_text(f"<body><div class=ad>{NOTICE * 9}</div><article><h1>Er.</h1><p>Er.</p></article><footer>{NOTICE * 9}</footer></body>") == "Er.\nEr."


@pytest.mark.parametrize("piece", ["<div>", "<b>", "<p>x", "</div>", "<ul><li>", "<b><div>", "</b>", "<a '", "<a \"", "<!--", "<!", "<![CDATA[", "&", "&#", "<script>", "<table><tr><td>", "<i><p></i>", "<", "x <y", "<h1>"])
def test_any_length_takes_linear_time(piece):
    begun = time.time()
    main_text("<article>" + piece * (600_000 // len(piece)) + "</b>" * 50_000)
    assert time.time() - begun < 20


def test_whole_pages_in_any_order(spark):
    words = random.Random(1)
    body = [" ".join(words.choice("alpha beta gamma & delta".split()) for _ in range(words.randint(1, 90))) for _ in range(4_000)]
    page = "<body><article>" + "".join(f"<p>{x.replace('&', '&amp;')}</p>" for x in body) + "</article></body>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", "<p>x</p>")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars")).collect()
    want = [(1, "u", "\n".join(body)), (1, "u", "\n".join(body)), (None, None, ""), (2, "v", "x")]
    assert sorted(map(str, got)) == sorted(str(g) for g in [type(got[0])(page_id=i, url=u, text=x, n_chars=len(x)) for i, u, x in want])
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark):
    """Every given page: what stands in its article element, tag by tag."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract(pages).collect():
        inside = re.search("(?s)<article>(.*)</article>", html[r["page_id"]])[1]
        lines = [" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])
