"""Main text of pages: small pages of many forms, merged site trees, and the given pages against a plain cut."""
import collections
import html
import re

import pyarrow.parquet as pq
import pytest

from glasstrail.llm import queries, sitetree

ROOT = "/root/testdata/sf0.001"
PAGES = [
    ("", ""), ("<", "<"), ("plain text", "plain text"), ("a < b &amp; c &lt;i&gt; &#233;&eacute;&hellip; &nope &am", "a < b & c <i> éé… &nope &am"),
    ("<p>one<p>two <b>bold<i>x</b> y</i>\n\t end<br>more</p>tail", "one\ntwo boldx y end more\ntail"),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>m<li>n</ul></nav><header>site</header><article><header><h1>Head</h1></header><p>Body &copy;</p>"
     "<aside>more</aside><footer>by</footer></article><div class='sidebar'>side</div><footer>foot</footer></body>", "Head\nBody ©"),
    ("<main><h1>T</h1><div class='content'><p>x</p></div><section id='comments'><article><p>reader</p></article></section></main><div>out</div>", "T\nx"),
    ("<article><p>x</p><div class='comment-list'><article class=comment><p>reader</p></article></div><form><p>f</p><button>b</button></form><p>y</p></article>", "x\ny"),
    ("<form><div class='adSlot'>buy</div><article><p>whole page in a form</p></article><label>l</label></form>", "whole page in a form"),
    ("<article>a<script>var t='</p><article>';</script>b<!-- <p>no --> c<SCRIPT>x</ScRiPt >d</article>", "ab cd"),
    ("<article><table><tr><td>1<td>2<tr><td><p>3</table><p>after</article>", "1\n2\n3\nafter"),
    ("<article><div class='cookie-notice'>c</div><p title=\"a>b\" class='has-sidebar'>kept</p><p hidden>h</p><div role=navigation>n</div></article>", "kept"),
    ("<article><p>open <a href=\"x>never closed <p>rest</article>", "open never closed\nrest"), ("<article><p>x</p></article><script>never ends <article><p>y</p></article>", "x"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul><dl><dt>d<dd>e</dl><pre>  two\n lines </pre>", "a\nb\nc\nd\ne\ntwo lines"), ("<!DOCTYPE html><?xml?><p>x</body></html>", "x"),
    ("<body class='with-sidebar'><div class='page-header'>top</div><div>kept<span class='share'>s</span> on</div>", "kept on"), ("<nav>only</nav>", ""),
    ("<p>" + "long  " * 50_000 + "</p>", " ".join(["long"] * 50_000)), ("<div>" * 30_000 + "deep" + "</div>" * 30_000 + "<p>x", "deep\nx"),
]


@pytest.mark.parametrize("page, text", PAGES, ids=range(len(PAGES)))
def test_pages(page, text):
    assert sitetree.extracted(page) == text


def test_unfinished_quotes_take_linear_time():
    assert sitetree.extracted("<a \"" * 100_001 + "<p>x") == "x"
    assert sitetree.extracted("<p '>" * 100_001 + "y") == "y"


DDL = "page_id bigint, url string, html string, host string, text int, removed string, own_0 int"


def site(k, n=12):
    """Pages of one host without any named part: a repeated block, an own text, and a block of the same class on all pages."""
    return [(i, f"https://H{k}.example.com/{i}", f"<body><div class='top'>Welcome to our site</div><div class='story'><p>story {k} {i}</p><p>more {i}</p></div>"
             f"<div class='low'><p>Ask us</p><p>Find us</p></div></body>") for i in range(n)]


def test_repeated_branches_go_and_rare_ones_stay(spark):
    copies = [(100 + i, "http://copies.example.org/", "<body><div class='story'><p>the same everywhere</p></div></body>") for i in range(30)]
    rows = site(1) + site(2, 5) + copies + [(None, None, None), (7, None, "<p>no host</p>"), (7, None, "<p>no host</p>"), (8, "no scheme", "")]
    frame = spark.createDataFrame([(*r, "mine", 3, "r", 9) for r in rows], DDL).repartition(4)
    got = sitetree.main_text(frame).collect()
    assert all((r["host"], r["removed"], r["own_0"]) == ("mine", "r", 9) and r["n_chars"] == len(r["text"]) for r in got)
    expected = [f"story 1 {i}\nmore {i}" for i in range(12)] + [f"Welcome to our site\nstory 2 {i}\nmore {i}\nAsk us\nFind us" for i in range(5)]
    expected += ["the same everywhere"] * 30 + ["", "no host", "no host", ""]
    assert collections.Counter(r["text"] for r in got) == collections.Counter(expected)
    assert sitetree.main_text(frame.limit(0)).count() == 0


def test_query_over_given_pages(spark):
    t = pq.read_table(f"{ROOT}/pages.parquet").to_pylist()

    def plain(page):
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        return "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)) if x)

    rows = queries.QUERIES["op12_html_text"](spark, ROOT).collect()
    assert collections.Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in rows) == collections.Counter((p["page_id"], p["url"], x := plain(p["html"]), len(x)) for p in t)
