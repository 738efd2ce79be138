"""Operators over pages, and the guard of the optional package."""
import pytest

from staywise.llm import style_tree, url_filter
from staywise.llm.style_tree import Page

PAGES = "page_id long, url string, html string, host string, rule string"


def text(source):
    return " ".join(t for _, t in Page(source).blocks())


def test_marked_article():
    page = """<html><head><title>x</title></head><body class="home header-fixed"><header><h1>Site</h1></header><div id="cookie-notice">Cookies</div>
    <div class="wrap sidebar-right"><main><article class="post"><header><h1>Big &amp; news</h1></header><p>One<b>two</b>
     three&nbsp;four<br>five<ul><li>a<li>b</ul><form><p>mail</p></form><div class="share-buttons">Tweet</div></article>
    <section id="comments"><article class="comment"><p>nice</p></article></section></main><aside>rel</aside></div><footer>c</footer>
    <script>if (a<b) "</p>"</script></body></html>"""
    assert text(page) == "Big & news Onetwo three four five a b"


def test_unmarked_article_and_broken_markup():
    page = """<div class="content"><h2>T</h2><p>para <a href="x>y">link</a>, ok</p><div class="comments"><p>c</p></div></div><div class="ad">buy</div>
    tail <!-- c > d --> end <p title="unclosed> z <table><tr><td>q<td>r</table>"""
    assert text(page) == "T para link, ok tail end z q r"
    assert text("plain a < b & c") == "plain a < b & c" and text("") == text(None) == text("<p></p>") == ""
    assert text("<p>a<script>x</p>") == "a" and text("<!-- open") == "" and text("<p hidden>no</p>yes &#233;&eacute;") == "yes éé"


def test_repeated_branches_go_and_articles_stay(spark):
    def page(k, article):
        return f"<body><div class='x'>Call us today</div><div class='y'><p>Story {article} of its own, told once.</p></div><div class='z'>Made by us</div></body>"

    rows = [(k, f"http://a.example.com/{k}", page(k, k), "h", "r") for k in range(8)] + [(100, "http://b.example.com/", page(0, 0), "h", "r")]
    rows += [(200 + k, f"http://c.example.com/{k}", f"<body><article><h1>Same</h1><p>One text.</p></article><div>Foot {k % 2}</div></body>", "h", "r") for k in range(6)]
    rows += [(300, None, None, None, None), (301, "x", "", None, None), (302, "http://a.example.com/", "only text", None, None)]
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in style_tree.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found[3][0] == "Story 3 of its own, told once." and found[100][0].startswith("Call us today")
    assert found[203][0] == "Same One text." and found[300] == found[301] == ("", 0) and found[302] == ("only text", 9)
    assert style_tree.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_url_verdicts(spark):
    urls = [
        None, "", "no scheme", "http://WWW.Example.com/en/x?q#f", "http://a.example.com/en/", "http://example.com/en", "https://com", "ftp://com/",
        "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://a.b.net/de/", "http://casino.example.org/a/", "http://www.casino.example.org/a",
        "http://fine.example.org/a#b://c", "http://notexample.com/en/",
    ]
    pages = spark.createDataFrame([(k, u, "", "clash", "clash") for k, u in enumerate(urls)], PAGES)
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("casino.example.org/a",)], "url_key string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages.unionByName(pages), rules, listed).collect()}
    expected = [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/", "example.com/en/", "block"), ("example.com", "/en", "com/", "allow"), ("com", "", None, "allow"), ("com", "/", "com/", "allow"),
        ("x.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("xnet", "/fr/", None, "allow"), ("a.b.net", "/de/", None, "allow"),
        ("casino.example.org", "/a/", None, "block"), ("www.casino.example.org", "/a", None, "block"),
        ("fine.example.org", "/a", None, "allow"), ("notexample.com", "/en/", "com/", "allow"),
    ]
    assert [found[k] for k in range(len(urls))] == expected
    assert url_filter.judge(pages.unionByName(pages), rules, listed).count() == 2 * len(urls)
    assert url_filter.judge(pages.limit(0), rules, listed).count() == 0
    none = url_filter.judge(pages, rules.limit(0), listed.limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


@pytest.mark.parametrize("n", [1, 500])
def test_filter_passes_every_listed_key(spark, n):
    keys = spark.range(n).selectExpr("CAST(id AS STRING) AS key")
    blocks, count = url_filter.bloom_blocks(keys, n)
    assert url_filter.possible_hits(keys, blocks, count).count() == n
    others = spark.range(10_000, 30_000).selectExpr("CAST(id AS STRING) AS key")
    assert url_filter.possible_hits(others, blocks, count).count() < 2_000
