"""The tree builder, selectors, mutation and text extraction."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webarc.functions import html as H
from webarc.html.css import select
from webarc.html.dom import COMMENT, TEXT, parse, parse_bytes, traverse
from webarc.html.extract import extract_plain_text, visible_text

PAGE = """<!DOCTYPE html><html lang="en"><head><title> A  title </title><meta charset="utf-8"></head><body>
<div id="top" class="one two"><p class="x">First <b>bold</b></p><p id="Q" data-k="v">Second<br>line</p></div>
<ul><li>a</li><li class="two">b<ol><li>c</li></ol></li></ul><!-- note --><a href="/u?x=1&amp;y=2" rel="">link</a></body></html>"""


@pytest.mark.parametrize(
    "source,body",
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("a<b>c", "a<b>c</b>"),
        ("<ul><li>1<li>2</ul>", "<ul><li>1</li><li>2</li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"),
        ("<table><thead><tr><th>h</thead><tbody><tr><td>d</table>", "<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>d</td></tr></tbody></table>"),
        ("<table>x<tr><td>y</table>", "x<table><tbody><tr><td>y</td></tr></tbody></table>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<p>1<i>2</p><p>3", "<p>1<i>2</i></p><p><i>3</i></p>"),
        ("<a>1<a>2", "<a>1</a><a>2</a>"),
        ("</p>x", "<p></p>x"),
        ("a</br>b", "a<br>b"),
        ("<h1>a<h2>b</h2>", "<h1>a</h1><h2>b</h2>"),
        ("<select><option>1<option>2</select>", "<select><option>1</option><option>2</option></select>"),
        ("<button>a<button>b", "<button>a</button><button>b</button>"),
        ("<script>if (a < b) x('</p>')</script>y", "<script>if (a < b) x('</p>')</script>y"),
        ("<textarea>\n<b>&lt;</textarea>", "<textarea>&lt;b&gt;&lt;</textarea>"),
        ("x &amp; &lt; &eacute; &#65; &nosuch;", "x &amp; &lt; é A &amp;nosuch;"),
        ('<i a=1 A=2 b="x&quot;y" c>z</i>', '<i a="1" b="x&quot;y" c="">z</i>'),
        ("a<!-- c -->b<!x>c", "a<!-- c -->b<!--x-->c"),
        ("1 < 2 <3", "1 &lt; 2 &lt;3"),
        ("<p>a<div>b", "<p>a</p><div>b</div>"),
    ],
)
def test_tree_building(source, body):
    assert parse("<body>" + source).body.inner_html == body


def test_parts_and_titles():
    t = parse(PAGE)
    assert t.title == "A title" and t.head.tag == "head" and t.body.tag == "body" and t.document.children[1].attrs["lang"] == "en"
    assert parse("").body.html == "<body></body>" and parse("").title == ""
    assert parse("<svg><title>no</title></svg>").title == ""
    assert parse("<html><head><title>open").title == "open"
    assert parse_bytes("<p>\xe9".encode("latin-1"), "iso-8859-1").body.text == "é"
    assert parse("<!DOCTYPE html><p>x").document.children[0].type == "doctype"


def test_selectors():
    t = parse(PAGE)
    tags = lambda css: [n.tag for n in t.document.query_selector_all(css)]
    assert tags("#top > p") == ["p", "p"] and tags("div.two.one") == ["div"] and tags("p.x b, a") == ["b", "a"]
    assert tags("li li") == ["li"] and tags("ul > li:last-child") == ["li"] and tags("li:nth-child(odd)") == ["li", "li"]
    assert tags("p + p") == ["p"] and tags("div ~ a") == ["a"] and tags("body *:empty") == ["br"]
    assert tags("[data-k=v]") == tags("[data-k]") == tags("[data-k^='v']") == tags('[data-k="V" i]') == ["p"]
    assert tags("[class~=two]") == ["div", "li"] and tags("a[href*='x=1']") == ["a"] and tags("a[href$='2']") == ["a"]
    assert tags("p:not(.x)") == ["p"] and tags("li:has(ol)") == ["li"] and tags("p:is(.x, #Q)") == ["p", "p"] and tags("html:root") == ["html"]
    assert t.document.query_selector("nope") is None
    for bad in ("", "..a", "p >", "[x", "p:nope", "a,,b", "p)"):
        with pytest.raises(ValueError):
            select(t.document, bad)


def test_lookups_and_collections():
    t = parse(PAGE)
    assert t.document.get_element_by_id("q") is None and t.document.get_element_by_id("q", True).tag == "p"
    assert len(t.document.get_elements_by_class_name("two")) == 2 and len(t.document.get_elements_by_class_name("TWO", True)) == 2
    assert len(t.document.get_elements_by_attr("data-k", "v")) == 1 and len(t.document.get_elements_by_tag_name("li")) == 3
    items = t.document.query_selector_all("li")
    assert items[-1].text == "c" and [n.text for n in items[:1]] == ["a"] and items.query_selector("ol").tag == "ol"
    assert items.matches(".two") and not items.matches("table") and len(items[0:0].query_selector_all("p")) == 0
    div = t.document.get_element_by_id("top")
    assert div.matches("div") and not div.matches(".x") and div.matches_any(".x") and div.query_selector("b").closest("div") is div


def test_navigation():
    div = parse(PAGE).document.get_element_by_id("top")
    first = div.first_element_child
    assert first.next_element.id == "Q" and first.next_element.prev_element is first and first.parent is div
    assert div.last_child.tag == "p" and first.first_child.type == TEXT and first.first_child.value == "First " and first.next.tag == "p"
    assert [n.type for n in div.parent.children if n.type == COMMENT] == [COMMENT]
    assert div.contains(first) and not first.contains(div)


def test_attributes_and_classes():
    t = parse(PAGE)
    a = t.document.query_selector("a")
    assert a["href"] == "/u?x=1&y=2" and a.getattr("rel") == "" and a.getattr("no") is None and a.getattr("no", "d") == "d" and a.hasattr("HREF")
    with pytest.raises(KeyError):
        a["no"]
    a["x"] = "1"
    a.delattr("rel")
    assert a.html == '<a href="/u?x=1&amp;y=2" x="1">link</a>' and a.id == "" and a.toggle("open") and not a.toggle("open")
    c = t.document.get_element_by_id("top").class_list
    c.add("three")
    c.add("one")
    c.remove("two")
    assert c == ["one", "three"] and len(c) == 2 and "one" in c and c[0] == "one" and c.replace("one", "1") and c.toggle("x") and not c.toggle("x")


def test_mutation():
    t = parse("<body><p>1</p><p>2</p></body>")
    one, two = t.body.children
    new = t.create_element("DIV")
    new.text = "<&>"
    t.body.insert_before(new, two)
    assert t.body.inner_html == "<p>1</p><div>&lt;&amp;&gt;</div><p>2</p>"
    t.body.replace_child(t.create_text_node("t"), one)
    two.html = "<i>x</i>y"
    assert t.body.inner_html == "t<div>&lt;&amp;&gt;</div><p><i>x</i>y</p>"
    new.decompose()
    two.query_selector("i").remove()
    two.prepend(t.create_comment("c"))
    assert t.body.inner_html == "t<p><!--c-->y</p>" and two.clone().html == two.html
    for bad in (lambda: two.append_child(t.body), lambda: two.remove_child(one), lambda: two.insert_before(new, one)):
        with pytest.raises(ValueError):
            bad()


def test_traverse():
    seen = []
    traverse(parse("<p>a<b>c</b></p>").body, lambda n, c: seen.append((n.tag, c["depth"])), lambda n, c: seen.append(("/" + n.tag, c["depth"])))
    assert seen == [("body", 0), ("p", 1), ("#text", 2), ("/#text", 2), ("b", 2), ("#text", 3), ("/#text", 3), ("/b", 2), ("/p", 1), ("/body", 0)]
    seen.clear()
    traverse(parse("<p>a<b>c</b></p>").body, lambda n, c: seen.append(n.tag), elements_only=True)
    assert seen == ["body", "p", "b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<a>", "</a>", "<div>", "</div>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<li>", "<ul>", "</ul>", "<h1>", "</h1>", "text", "&amp;", "<!--", "-->", "<svg>", "<title>", "<br/>", "<select>", "<option>", "<script>", "</script>"]), max_size=25))
def test_any_soup_gives_a_consistent_tree(parts):
    t = parse("".join(parts))
    assert t.body is not None and t.head is not None
    for n in t.document.walk():
        for c in n.children:
            assert c.parent is n
    extract_plain_text(t, main_content=True)


TEXT_PAGE = """<body><nav><a href="/">Home</a></nav><h1>Head</h1><p>One <a href="/x">two</a>.<br>Three</p><ul><li>a<li>b<ul><li>c</ul></ul><ol><li>x<li>y</ol><pre> k
  l</pre><table><tr><td>1</td> <td>2</table><img alt="pic"><input value="v"><textarea>t</textarea><noscript>ns</noscript><script>s</script><p hidden>gone</p></body>"""


def test_extraction_modes():
    assert extract_plain_text("<p>a</p><p>b", preserve_formatting=False) == "a b"
    assert extract_plain_text("<p>a</p><p>b") == "a\n\nb" and extract_plain_text("<div>a</div><div>b") == "a\nb"
    t = extract_plain_text(TEXT_PAGE)
    assert t.startswith("Home\n\nHead\n\nOne two.\nThree\n\n  • a\n  • b\n    • c\n  1. x\n  2. y\n k\n  l\n1 2") and "pic" in t and "gone" in t and "ns" not in t
    assert "One two (/x)." in extract_plain_text(TEXT_PAGE, links=True) and "•" not in extract_plain_text(TEXT_PAGE, list_bullets=False)
    assert "[ v ]" in extract_plain_text(TEXT_PAGE, form_fields=True) and "ns" in extract_plain_text(TEXT_PAGE, noscript=True)
    m = extract_plain_text(TEXT_PAGE, preserve_formatting="minimal_html", links=True)
    assert "<h1>Head</h1>" in m and '<a href="/x">two</a>' in m and "<li>a</li>" in m and "<pre> k\n  l</pre>" in m
    main = extract_plain_text(TEXT_PAGE, main_content=True)
    assert "Home" not in main and "gone" not in main and main.startswith("Head")
    assert "Head" not in extract_plain_text(TEXT_PAGE, skip_elements=["h1", ".nothing"])
    with pytest.raises(TypeError):
        extract_plain_text(3)


def test_main_content_rules():
    page = lambda x: f"<body><main><p>text</p>{x}</main></body>"
    gone = ["<aside>no</aside>", '<div aria-hidden="true">no</div>', '<p id="z" style="display: none">no</p>', '<div id="cookie-consent" class="legal">no</div>', '<div class="logo">no</div>', '<div id="z" role="menu">no</div>', '<div id="nav">no</div>', '<div id="z" data-ad>no</div>', '<div class="is-hidden">no</div>', '<div id="s" class="sidebar">no</div>', "<time>no</time>"]
    for x in gone:
        assert extract_plain_text(page(x), main_content=True) == "text", x
    assert extract_plain_text(page('<div class="is-hidden">yes</div>'), main_content=True, hidden_elements=True) == "text\nyes".replace("\n", "\n\n")
    assert "yes" in extract_plain_text(page('<div id="x-comments" class="comments">yes</div>'), main_content=True)
    assert "yes" not in extract_plain_text(page('<div id="q" class="comments">yes</div>'), main_content=True, comments=False)
    assert extract_plain_text('<body>a<div class="post-content">b</div></body>', main_content=True) == "b"


def test_visible_text():
    assert visible_text(parse("<p>a  b</p><p>c<br>d</p><div>e</div><script>x</script>").body) == "a b\n\nc\nd\n\ne"


def test_columns(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "i int, h string")
    r = {x.i: x for x in df.select("i", H.html_title("h").alias("t"), H.html_attr("h", "a", "rel").alias("a"), H.html_attr("h", "a", "no").alias("no"), H.html_text("h", "#Q").alias("q"), H.html_select("h", "li").alias("s"), H.html_count("h", "li").alias("n"), H.html_matches("h", "ol").alias("m"), H.html_remove("h", "ul").alias("r"), H.html_attrs("h", "a", "href").alias("hr"), H.analyze_page("h", ["title", "n_elements", "main_text"]).alias("p")).collect()}
    assert (r[1].t, r[1].a, r[1].no, r[1].q, r[1].n, r[1].m, r[1].hr) == ("A title", "", None, "Secondline", 3, True, ["/u?x=1&y=2"])
    assert [x["tag"] for x in r[1].s] == ["li"] * 3 and r[1].s[1]["attrs"] == {"class": "two"} and "<ul>" not in r[1].r and r[1].p.title == "A title"
    assert r[2].t is None and r[2].p is None and r[2].s is None and r[3].t == "" and r[3].n == 0
    assert [x.v for x in df.filter("i = 1").select(F.explode(H.html_select_text("h", "p")).alias("v")).collect()] == ["First bold", "Secondline"]
    one = df.filter("i = 1").select(H.html_by_id("h", "Q").alias("a"), H.html_by_class("h", "two").alias("b"), H.html_by_attr("h", "data-k", "v").alias("c"), H.html_by_tag("h", "ol").alias("d"), H.html_visible_text("h").alias("e"), H.html_serialize("h", "b").alias("f"), H.html_select_first("h", "b").alias("g"), H.extract_plain_text("h", links=True).alias("k")).first()
    assert one.a.startswith('<p id="Q"') and len(one.b) == 2 and len(one.c) == len(one.d) == 1 and one.f == "<b>bold</b>" and one.g["text"] == "bold" and "(/u?x=1&y=2)" in one.k and "Second\nline" in one.e
    with pytest.raises(ValueError):
        H.html_select("h", "p >")
    with pytest.raises(ValueError):
        H.analyze_page("h", ["nope"])


def test_table_functions(spark):
    H.register(spark)
    spark.createDataFrame([(PAGE,), (None,)], "h string").createOrReplaceTempView("t_pages")
    nodes = spark.sql("select n.* from t_pages, lateral html_nodes(h) n").collect()
    by = {n.node_id: n for n in nodes}
    assert all(n.parent_id is None or by[n.parent_id].depth == n.depth - 1 for n in nodes) and sum(n.tag == "li" for n in nodes) == 3
    assert spark.sql("select l.href, l.text from t_pages, lateral html_links(h) l").collect() == [("/u?x=1&y=2", "link")]
