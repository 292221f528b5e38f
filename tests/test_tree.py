"""The parse of pages: nesting, ends that are implied, sections, microdata, references; and what Spark makes of it."""

import html as standard
import random
import time

import pytest
from pyspark.sql import functions as F

from siftwell.functions import html as H
from siftwell.functions import tree
from siftwell.operators import extraction


def read(html):
    return dict(zip(tree.PARTS.names, tree.read(html), strict=True))


def element(html, tag):
    page = tree.Page(html)
    return [page.visible(x) for x in page.elements if x[0] == tag]


@pytest.mark.parametrize(
    "html, tag, texts",
    [
        ("<ul><li>one<li>two</ul>", "li", ["one", "two"]), ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "li", ["a b c", "b", "c", "d"]), ("<p>x<p>y", "p", ["x", "y"]), ("<p>x<div>y</div>z", "p", ["x"]), ("<p>x<b>y</b>z</p>w", "p", ["x y z"]),
        ("<dl><dt>t<dd>d<dt>u</dl>", "dd", ["d"]), ("<table><tr><td>a<td>b<tr><td>c</table>", "td", ["a", "b", "c"]), ("<table><tr><td><table><tr><td>in</table>out<td>z</table>", "td", ["in out", "in", "z"]), ("<select><option>a<option>b</select>", "option", ["a", "b"]),
        ("<b><p>in</b>side</p>", "p", ["in side"]), ("<div>a</p>b</div>", "div", ["a b"]), ("<div><p>a</div>b", "p", ["a"]), ("<br>a<hr>b", "br", [""]), ("<P CLASS=x>A</P>", "p", ["A"]), ("<div>a", "div", ["a"]), ("<div a='>'>x</div>", "div", ["x"]),
    ],
)
def test_nesting(html, tag, texts):
    assert element(html, tag) == texts


@pytest.mark.parametrize(
    "html, text",
    [
        ("a<!-- b -->c", "a c"), ("a<!-- b", "a"), ("a<script>if (x < 1) '</p>'</script>b", "a b"), ("<style>p{}</style>x", "x"), ("<noscript>n<p>o</noscript>x", "x"), ("x<script>never ends", "x"), ("a &lt;b&gt; &copy 2019 &amp;amp; &am", "a <b> © 2019 &amp; &am"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("a \n\t b", "a  b"), ("<title>T</title>b", "T b"), ("<textarea><b>raw</b></textarea>", "<b>raw</b>"), ("fo<b>o</b>", "fo o"), ("<!DOCTYPE html><?pi x>a", "a"), (None, ""), ("  ", ""), ("<a <a <p>x", "<a <a x"),
    ],
)
def test_visible_text(html, text):
    assert read(html)["text"] == text


def test_sections_by_name_then_by_class():
    nested = '<div class="x Site-FOOTER"><div>a<script>s</script></div><ul><li>b<li>c</ul>d</div>e'
    assert read(nested)["footer"] == "a b c d"
    assert read(f"<footer></footer>{nested}")["footer"] == ""  # there is one, and it is empty
    assert read("<p class=header>h<p>i")["header"] == "h" and read("<p>none")["header"] == ""
    assert len(read(f"<footer>{'x' * 9000}</footer>")["footer"]) == tree.FOOTER_CHARS


def test_meta_links_and_blocks():
    page = read("""<title> A &eacute; </title><title>second</title><meta name=Description content='d &amp; e'><META PROPERTY="og:title" CONTENT="t"><meta name=description content=later><meta name=empty content="">
      <a href=" /x.pdf "><a HREF='mailto:A&#64;B.io?subject=s'>m</a><a href="mailto:none">n</a><img src=" i.png "><img src=""><!-- <meta name=c content=c> --><script type="application/ld+json">{"a": "&amp;"}</script>""")
    assert page["title"] == "A é" and page["meta"] == {"description": "later", "og:title": "t"}
    assert page["hrefs"] == ["/x.pdf", "mailto:A@B.io?subject=s", "mailto:none"] and page["mailto"] == ["a@b.io"] and page["images"] == ["i.png"] and page["json_ld"] == ['{"a": "&amp;"}']


def test_microdata_of_nested_items():
    page = read('<div itemscope itemtype=Org><b itemprop=name> Ac<i>me</i> </b><div itemprop=founder itemscope itemtype=Person><i itemprop=name>Ann</i></div><a itemprop=url href=/u>x</a><meta itemprop=k content=v></div><p itemprop=name>other')
    assert page["microdata"] == [{"type": "Org", "properties": {"name": "Ann", "founder": "Ann", "url": "/u", "k": "v"}}, {"type": "Person", "properties": {"name": "Ann"}}]


def test_time_is_in_proportion_to_odd_pages():
    for bad in ("<", "<a ", '<a "', "<!--", "<p>", "</b>", "<b><p>", "<li>", "<div class='footer'>", "&", "<script>", "<a x='"):
        start = time.perf_counter()
        tree.read(bad * (60_000 // len(bad)))
        assert time.perf_counter() - start < 5, bad


def test_any_text_is_read():
    rng = random.Random(6)
    bits = ["<p>", "</p>", "<b>", "</b>", "<li>", "</ul>", "<ul>", "<div class=footer>", "</div>", "<script>", "</script>", "<!--", "-->", "&amp;", "&#0;", "x", " ", "<", ">", '"', "'", "<a href=", "=", "\x00", "\U0001f600", "<table><tr><td>", "</table>"]
    for _ in range(2000):
        page = tree.Page("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))))
        assert all(0 <= x[2] <= x[3] <= len(page.texts) and n < x[4] <= len(page.elements) for n, x in enumerate(page.elements))


def test_a_page_is_parsed_once_for_all_its_parts(spark):
    html = F.col("html")
    df = spark.createDataFrame([(1, "<title>t</title><footer>a@b.io</footer>"), (2, None)], "page_id long, html string")
    plan = df.select(H.title(html), H.meta(html), H.visible_text(html), H.section_text(html, "footer", 9))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "pythonUDF1" not in plan
    finds = extraction.explode_finds(df, html)._jdf.queryExecution().executedPlan().toString()
    assert finds.count("ArrowEvalPython") == 1 and "pythonUDF1" not in finds
    assert [tuple(r) for r in df.select(H.title(html), H.section_text(html, "footer", 3)).collect()] == [("t", "a@b"), ("", "")]


def test_references_with_and_without_semicolon(spark):
    texts = ["&copy 2019", "&notit;", "AT&T", "&amp;lt;", "&#x41", None, "", "&CounterClockwiseContourIntegral;"]
    df = spark.createDataFrame([(i, t, [t, "a", None]) for i, t in enumerate(texts)], "i int, t string, ts array<string>")
    for r in df.select("t", H.unescape(F.col("t")).alias("u"), H.unescape_all(F.col("ts")).alias("us")).collect():
        want = r.t if r.t is None else standard.unescape(r.t)
        assert r.u == want and list(r.us) == [want, "a", None]
