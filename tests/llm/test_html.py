import re
from html import unescape

import pytest

from lakeloom.llm import html

P = "A sentence with some length, a comma, and nothing else that matters here at all. "


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just words", "just words"),
        ("<p>a &amp; b&nbsp;c &#233; &lt;i&gt;", "a & b c é <i>"),
        ("<article><p>one<p>two <b>th<i>ree</i></b><br>four</article><footer>f</footer>", "one two three four"),
        (f"<nav><a href=x>menu</a></nav><article><h1>T</h1><p>{P}</p><aside>side</aside><form>name <input></form><p>short</p></article><div id=comments><p>{P}</p></div>", f"T {P}short"),
        (f"<div class='sidebar'><p>{P}</p></div><div class=content><p>{P}</p><div class='ad'>buy</div><script>x<p>y</script><p>end</div>", f"{P}end"),
        (f"<main><p>{P}</p><ul><li><a href=a>a</a><li><a href=b>b</a></ul><ul><li>x<li>y</ul></main>", f"{P}a b x y"),
        (f"<form action=x><div class=top><input></div><article><h1>T</h1><p>{P}</p></article>", f"T {P}"),
        (f"<form><div><p>{P}</p><p>{P}</p></div><button>go</button></form>", f"{P}{P}"),
        (f"<article><p>{P}</p><form><p>Your name, please</p><input></form></article>", P),
        (f"<article><p>{P}</p><section id=search-results-analysis><p>{P}</p></section></article>", f"{P}{P}"),
        (f"<article><p>The <span class=share>share price</span> of it. {P}</p></article>", f"The share price of it. {P}"),
        (f"<article><p>{P}</p><h2>Sources</h2><ol><li><a href=a>first</a>, 1999<li><a href=b>second</a></ol></article>", f"{P}Sources first, 1999 second"),
        (f"<article><div class='related-posts'><p>{P}</p></div><p>{P}</p><div class='social-policy-links'><a href=x>Share</a></div></article>", P),
        (f"<article><div class=post-header><h1>T</h1></div><p>{P}</p><div class=commentList><h2>Said</h2><p>{P}{P}{P}</p></div></article>", f"T {P}"),
        (f"<div class='content sidebar-right'><h1>T</h1><p>{P}</p></div><div class=sidebar-right><p>{P}</p></div>", f"T {P}"),
        (f"<body><div><p>{P * 3}</p></div><div><p>{P * 3}</p></div><div class='cookie-notice'>{P}</div></body>", f"{P * 6}"),
        ("<article><p>a < b and c > d<!-- <p>no --> e</p><style>p{}</style></article>", "a < b and c > d e"),
        ("<p hidden>no</p><p>yes</p><p style='display: none'>no</p>", "yes"),
        ("<table><tr><td>one<td>two<tr><td>three</table>", "one two three"),
        ("<p>x&#xD800;y", "x�y"),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text.strip()


def test_elements_beyond_the_depth_close_nothing_else():
    inner = "<div>" * 300 + "<p>a</p>" + "</div>" * 300
    assert html.main_text(f"<article><div>{inner}<p>{P}</p></div><p>{P}</p></article><footer>f</footer>") == f"a {P}{P}".strip()


def test_deep_and_broken_pages():
    assert html.main_text("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"
    assert html.main_text("<p>a</b></div></p>b<a href='x>c") in ("a b", "a bc", "a b<a href='x>c")
    assert html.main_text("<<<>>> <p <p>ok") != ""


def test_edge_rows(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    data = [(1, "u", None, 0, ""), (1, "u", None, 0, ""), (None, None, "<p>é", 0, ""), (2, "v", "<article><p>" + "w " * 100_000 + "</article>", 0, "")]
    out = html.extract_main_text(spark.createDataFrame(data, schema))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r[0]), r["n_chars"]) for r in out.collect()) == [("1", 0), ("1", 0), ("2", 199_999), ("None", 1)]
    assert html.extract_main_text(spark.createDataFrame([], schema)).collect() == []


def test_all_pages_against_the_marked_article():
    import duckdb

    for page in [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]:
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        assert html.main_text(page) == " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())


def test_query(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    out = html.op7_main_text(spark, small).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_formulas_and_fallbacks_stay():
    page = "<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>mc</mi><annotation encoding='tex'>E=mc</annotation></math> always, as the long second half of this sentence says.</p><object data='x'><p>What the picture shows, told in words.</p></object></article>"
    assert html.main_text(page) == "Energy is E=mc always, as the long second half of this sentence says. What the picture shows, told in words."


def test_page_without_article():
    text = "A sentence with some length, a comma, and nothing else that matters here at all."
    page = f"<body><div id='top'><a href='/'>Home</a> <a href='/b'>B</a></div><div class='x'><p>{text}</p><p>{text}</p><p>{text}</p></div><div><a href='/c'>C</a></div></body>"
    assert html.main_text(page) == " ".join([text] * 3)
