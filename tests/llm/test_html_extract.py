"""Main text of pages: markup cases by hand, templates against a plain count."""

import html as entities
import re

import pytest

from ledgerlens.llm import html_extract, queries
from ledgerlens.llm.html_extract import Page

SCHEMA = "page_id long, url string, html string, text string, host string"


def text(source):
    return Page(source).text()[0]


@pytest.mark.parametrize(
    "source, wanted",
    [
        ("", ""),
        ("just  text\n here", "just text here"),
        ("<p>a<p>b</p>c", "a\nb\nc"),
        ("<article><h1>T</h1><p><b>one.<br><p>two <i>three</i>four</p></article>out", "T\none.\ntwo threefour"),
        ("<p>a<br>b</p>", "a b"),
        ("<p>x &amp; y &lt;b&gt; &am &#233;&#x20AC; &nbsp; z &amp;lt;</p>", "x & y <b> &am é€ z &lt;"),
        ("<p>1 < 2 <3 a<b>c</b></p>", "1 < 2 <3 ac"),
        ("<script>var t='</p><p>no';</script><style>p{}</style><p>yes</p><noscript>no</noscript>", "yes"),
        ("<p>a<!-- <p>no</p> -->b</p><!-- open", "ab"),
        ("<nav>menu</nav><div class='ad'>buy</div><div><p>kept</p></div><footer>foot</footer>", "kept"),
        ("<div class='has-sidebar'><form><article><p>kept</p><form>mail</form></article></form></div>", "kept"),
        ("<article><p>kept</p><div id='comments'><article class='comment'>no</article></div></article>", "kept"),
        ("<header>site</header><main><header><h1>kept</h1></header>body</main>", "kept\nbody"),
        ("<div id=content><p>kept</p><div class=\"cookie-notice\">no</div></div><p>other</p>", "kept"),
        ("<ul><li>a<li>b <ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<a title='>'>x</a><img alt=\"<p>\">y", "xy"),
        ("<p hidden>no</p><p>yes</p></div></p></b>", "yes"),
        ("<article><p>a</b>b</p></article><article>c</article>", "ab\nc"),
        ("<b><p>a</b> b</p>c", "a b\nc"),
        ("<title>no</title><textarea><p>no</textarea>yes <p class", "yes"),
    ],
)
def test_markup(source, wanted):
    assert text(source) == wanted


def test_long_and_deep_pages():
    assert text("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    body = "".join(f"<p>w{i} &amp; more</p>" for i in range(20000))
    assert text(f"<article>{body}</article>").count("\n") == 19999
    assert text("<a href=\"" * 3000) == ""
    assert text("<" * 50000) == "<" * 50000


def site(host, n, first=0, extra="<div><p>Follow us on every channel</p></div>"):
    return [(first + i, f"https://{host}/{i}", f"<body><div>Top of {host}</div><div><p>Story {i} of {host}</p><p>Shared passage</p>{extra}</div></body>", None, None) for i in range(n)]


def test_recurring_subtrees_go(spark):
    rows = site("A.example:80", 4) + site("b.example", 2, 10)
    copy = "<body><div>Top of c</div><div><p>One article</p></div></body>"
    rows += [(20 + i, f"http://c.example/{i}", copy, None, None) for i in range(9)]  # copies say the same
    rows += [(30, "http://c.example/x", copy.replace("One", "Another"), None, None), (31, None, copy, None, None), (32, "http://d.example", None, None, None)]
    got = {r["page_id"]: (r["text"], r["n_template"]) for r in html_extract.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    assert [got[i] for i in range(4)] == [(f"Story {i} of A.example:80\nShared passage", 2) for i in range(4)]
    assert got[10] == ("Top of b.example\nStory 0 of b.example\nShared passage\nFollow us on every channel", 0)
    assert {got[20 + i] for i in range(9)} == {("Top of c\nOne article", 0)}
    assert got[31] == ("Top of c\nOne article", 0) and got[32] == ("", 0)


def test_passages_of_articles_stay(spark):
    rows = [(i, f"http://a.example/{i}", f"<nav>m</nav><article><h1>T{i}</h1><p>Same words everywhere</p><div><p>Sign up</p></div></article>", None, None) for i in range(5)]
    got = html_extract.extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [f"T{i}\nSame words everywhere" for i in range(5)]
    assert {(r["n_template"], r["n_named"]) for r in got} == {(2, 0)}


def test_counts_equal_a_plain_count(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    seen, hosts = {}, {}
    for _, url, source in pages.collect():
        host, page = re.match(r"\w+://([^/]+)", url)[1], Page(source)
        said = page.text()[0]
        hosts.setdefault(host, set()).add(said)
        for h in page.hash_subtrees().values():
            seen.setdefault((host, h), set()).add(said)
    want = sorted(k for k, v in seen.items() if len(v) >= 3 and len(v) >= 0.1 * len(hosts[k[0]]))
    found = html_extract.site_templates(pages.withColumn("host", html_extract.host_of("url")), 3, 0.1)
    assert sorted((r["host"], t) for r in found.collect() for t in r["templates"]) == want and want


def test_query_equals_the_articles(spark):
    """The given pages mark their article; its text by regular expressions alone."""
    got = {r["page_id"]: r for r in queries.op13_html_extract(spark, "/root/testdata/sf0.01").collect()}
    for page_id, url, source in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in lines if x)
        assert (got[page_id]["url"], got[page_id]["text"], got[page_id]["n_chars"]) == (url, want, len(want))


def test_empty_table(spark):
    assert html_extract.extract(spark.createDataFrame([], SCHEMA)).collect() == []
