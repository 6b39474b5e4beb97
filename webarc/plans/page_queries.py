"""Queries over the pages that go through the tree: navigation, changes, character data, collections, text and main content; with SQL over the pages' one pattern."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..html.dom import COMMENT, DOCTYPE, TEXT, Node, Tree, parse, parse_bytes, parse_fragment, traverse


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _facts(kind: str, f) -> Column:
    """A struct of what f says of each page's tree."""
    names = [x.split(":")[0] for x in kind[7:-1].split(",")]

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [f(parse(h)) for h in s]
        return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})

    return run(F.col("html"))


def _said(spark: SparkSession, sf_dir: str, kind: str, f) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", _facts(kind, f).alias("x")).select("page_id", "x.*")


def _navigate(t: Tree) -> tuple:
    h1, nav, body = t.document.query_selector("h1"), t.document.query_selector("nav"), t.body
    comment = nav.next
    doctype = next(c for c in t.document.children if c.type == DOCTYPE)
    return (
        h1.parent.tag, h1.closest("body").tag, h1.next_element.tag, h1.prev_element is None, h1.last_child.type == TEXT, body.first_element_child.tag, comment.value if comment.type == COMMENT else None, comment.prev is nav, doctype.value,
        body.contains(h1) and not nav.contains(h1), h1.owner_document is t.document, len(body.element_children), nav.first_child.first_child.last_child.tag, [c.tag for c in t.head.element_children],
    )


def page_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents, siblings, children, owners, comments and the doctype, as steps from the heading and the menu."""
    kind = "struct<parent:string,around:string,behind:string,is_first:boolean,ends_in_text:boolean,first_tag:string,comment:string,between:boolean,doctype:string,inside:boolean,owned:boolean,n_parts:int,deep_tag:string,head_tags:array<string>>"
    return _said(spark, sf_dir, kind, _navigate).withColumn("head_tags", F.array_join("head_tags", " "))


def _change(t: Tree) -> tuple:
    h1, nav, article = t.document.query_selector("h1"), t.document.query_selector("nav"), t.document.query_selector("article")
    before = h1.clone()
    article.insert_before(t.create_element("hr"), h1)
    note = t.create_element("i")
    note.append_child(t.create_text_node("new & <old>"))
    h1.after(note)
    h1.before(t.create_comment("here"))
    h1.text = "Changed"
    links = nav.query_selector_all("a")
    first = links[0].parent
    first.replace_child(t.create_text_node("gone"), links[0])
    nav.query_selector("ul").append_child(first)
    last = nav.query_selector("li")
    last.decompose()
    nav.prepend(t.create_element("b"))
    fragment = t.create_fragment()
    for n in parse_fragment("<u>1</u><s>2</s>"):
        fragment.append_child(n)
    footer = t.document.query_selector("footer")
    footer.replace_children(fragment)
    copy = footer.clone(deep=False)
    footer.after(copy)
    copy.replace_with(t.create_element("wbr"))
    top = article.html
    return (
        before.html, top[: top.index("</i>") + 4], nav.html, footer.html, footer.next.tag, len(nav.query_selector_all("li")), footer.first_child.html, before == h1,
    )


def page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New elements, texts, comments and fragments; insertions, replacements, copies and removals, told by the serialised tree."""
    return _said(spark, sf_dir, "struct<copied:string,article:string,nav:string,footer:string,behind:string,n_items:int,inner:string,same:boolean>", _change)


def _attributes(t: Tree) -> tuple:
    a, div, page = t.document.query_selector("nav a"), t.document.query_selector("nav"), t.document.query_selector("html")
    meta = t.document.query_selector("meta")
    a.setattr("title", 'a "b"')
    had = a.hasattr("href") and not a.hasattr("rel")
    old = a.getattr("href")
    a.delattr("href")
    div.id = "menu"
    div.class_list.add("one")
    div.class_list.add("two")
    div.class_list.add("one")
    div.class_list.replace("two", "three")
    first = div.class_name
    div.class_list.toggle("one")
    div.class_list.remove("three")
    return (
        had, old, a.html, t.document.get_element_by_id("menu").tag, first, div.class_name, len(t.document.get_elements_by_tag_name("li")), len(t.document.get_elements_by_attr("charset", "UTF-8", True)), len(t.document.get_elements_by_attr("charset", "UTF-8")),
        len(t.document.get_elements_by_class_name("AD", True)), page.attrs["lang"], list(meta.attrs), a.getattr("none", "default"),
    )


def page_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes, ids and class lists, read, set and taken away; elements by id, class, tag and attribute."""
    kind = "struct<had:boolean,href:string,changed:string,by_id:string,classes:string,left:string,n_li:int,n_charset:int,n_exact:int,n_ad:int,lang:string,names:array<string>,missing:string>"
    return _said(spark, sf_dir, kind, _attributes).withColumn("names", F.array_join("names", " "))


def _character_data(t: Tree) -> tuple:
    node: Node = t.document.query_selector("h1").first_child
    first = node.substring_data(0, 4)
    node.insert_data(0, "<")
    node.append_data(">")
    node.delete_data(1, 1)
    node.replace_data(1, 1, "##")
    return first, node.value, t.document.query_selector("h1").html, node.text


def page_character_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, "struct<first:string,value:string,html:string,text:string>", _character_data)


def _walk(t: Tree) -> tuple:
    seen = {"open": 0, "close": 0, "deepest": 0, "tags": []}

    def start(n: Node, c: dict) -> None:
        seen["open"] += 1
        seen["deepest"] = max(seen["deepest"], c["depth"])
        seen["tags"].append(n.tag)

    traverse(t.document.query_selector("nav"), start, lambda n, c: seen.__setitem__("close", seen["close"] + 1), elements_only=True)
    items = t.document.query_selector_all("nav li")
    return (
        seen["open"], seen["close"], seen["deepest"], seen["tags"][:4], sum(1 for n in t.document.query_selector("nav") if n.type == TEXT), len(items.query_selector_all("a")), items.query_selector("a").text, items.matches("li"), len(items.get_elements_by_tag_name("a")),
        t.document.query_selector("body > article > h1:first-child") is not None, len(t.document.query_selector_all("li:last-child, h1, nothing")), len(t.document.query_selector_all("li:nth-child(odd) > a[href^='/']")), len(t.document.query_selector_all("li:not(:first-child)")),
    )


def page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traversal with both calls, iteration, collections and combined selectors."""
    kind = "struct<n_open:int,n_close:int,deepest:int,tags:array<string>,n_texts:int,n_links:int,first_link:string,all_li:boolean,n_again:int,has_first:boolean,n_listed:int,n_odd:int,n_rest:int>"
    return _said(spark, sf_dir, kind, _walk).withColumn("tags", F.array_join("tags", " "))


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column functions over selections: structs, texts, attributes of all matches, serialised parts and pages without some parts."""
    kept = html.html_remove("html", "nav, script, style, .ad, footer")
    p = _pages(spark, sf_dir)
    return p.select(
        "page_id", F.array_join(html.html_attrs("html", "li a", "href"), " ").alias("hrefs"), html.html_select_first("html", "meta")["attrs"]["charset"].alias("charset"), F.size(html.html_select("html", "li")).alias("n_li"),
        html.html_serialize("html", "nav").alias("nav"), F.instr(kept, "<nav").alias("nav_at"), F.instr(kept, "<article><h1>").cast("boolean").alias("has_article"), html.html_by_id("html", "none").alias("nothing"), F.size(html.html_by_tag("html", "a")).alias("n_a"),
        F.get(html.html_by_attr("html", "charset", "utf-8"), F.lit(0)).alias("meta"), F.size(html.html_by_class("html", "ad")).alias("n_ad"), html.html_attr("html", "h1", "id", "none").alias("h1_id"),
    )


def page_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of Latin-1 and UTF-16 bytes is that of the text."""

    @F.pandas_udf("array<string>")
    def titles(s: pd.Series) -> pd.Series:
        return s.map(lambda h: [parse_bytes(h.encode(e), e).title for e in ("utf-8", "utf-16")] + [parse_bytes(h.encode("latin-1", "xmlcharrefreplace"), "cp1252").title])

    p = _pages(spark, sf_dir).select("page_id", titles("html").alias("t"))
    return p.select("page_id", F.get("t", F.lit(0)).alias("utf8"), F.get("t", F.lit(1)).alias("utf16"), F.get("t", F.lit(2)).alias("latin1"))


def page_text_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text with links, without formatting and without skipped elements, as digests."""
    text = lambda **o: F.md5(html.extract_plain_text("html", **o))
    return _pages(spark, sf_dir).select("page_id", text(preserve_formatting=False).alias("flat"), text(list_bullets=False, skip_elements=["footer", "div.ad"]).alias("skipped"), text(links=True, skip_elements=["article", "footer", "div"]).alias("linked"), text(main_content=True).alias("main"))


QUERIES = [page_navigation, page_changes, page_attributes, page_character_data, page_walk, page_parts, page_bytes, page_text_options]

# ---- SQL ------------------------------------------------------------------------------------------------

_NAMED = "replace(replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
#: Text of a piece of a page: references resolved, white space in one.
_TEXT = lambda x: _NAMED.format(f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))")
_BARE = lambda x: _NAMED.format(x)
_ESCAPED = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_QUOTED = lambda x: f"replace({_ESCAPED(x)}, '\"', '&quot;')"
_P = rf"""p AS (
  SELECT page_id, html, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)', 1) AS links,
    regexp_extract(html, '<!--(.*?)-->', 1) AS comment, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, contains(html, 'class="ad"') AS has_ad,
    regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS footer,
    list_filter(list_transform(string_split(regexp_replace(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '</p>|</?b>|<br>', '', 'g'), '<p>'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x != '') AS ps,
    list_filter(string_split(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '<p>'), lambda x: trim(regexp_replace(regexp_replace(x, '</p>|</?b>|<br>', '', 'g'), '\s+', ' ', 'g')) != '') AS raw_ps
  FROM pages)"""
_NL = "chr(10)"
_LIST = lambda bullet: f"array_to_string(list_transform(links, lambda x: '{bullet}' || {_TEXT('x')}), {_NL})"
_PARAGRAPHS = f"array_to_string(list_transform(ps, lambda x: {_NL} || {_NL} || {_TEXT('x')}), '')"
_AD = f"CASE WHEN has_ad AND trim(ad) != '' THEN {_NL} || {_TEXT('ad')} ELSE '' END"


def oracle_sql() -> dict[str, str]:
    first = _ESCAPED(_BARE("links[1]"))
    items = f"array_to_string(list_transform(list_zip(hrefs, links), lambda z: '<li><a href=\"' || {_ESCAPED(_BARE('z[1]'))} || '\">' || {_ESCAPED(_BARE('z[2]'))} || '</a></li>'), '')"
    rest = f"array_to_string(list_transform(list_zip(hrefs, links)[3:], lambda z: '<li><a href=\"' || {_ESCAPED(_BARE('z[1]'))} || '\">' || {_ESCAPED(_BARE('z[2]'))} || '</a></li>'), '')"
    h1 = _BARE("h1")
    changed = f"'<##' || substr({h1}, 3) || '>'"
    title = _BARE("regexp_extract(html, '<title>(.*?)</title>', 1)")
    title = f"trim(regexp_replace({title}, '\\s+', ' ', 'g'))"
    return {
        "page_navigation": f"""WITH {_P}
SELECT page_id, 'article' AS parent, 'body' AS around, 'p' AS behind, true AS is_first, true AS ends_in_text, 'nav' AS first_tag, comment, true AS "between", 'html' AS doctype, true AS inside, true AS owned,
  CASE WHEN has_ad THEN 4 ELSE 3 END AS n_parts, 'a' AS deep_tag, 'meta title style script' AS head_tags
FROM p""",
        "page_changes": f"""WITH {_P}
SELECT page_id, '<h1>' || {_ESCAPED(h1)} || '</h1>' AS copied, '<article><hr><!--here--><h1>Changed</h1><i>new &amp; &lt;old&gt;</i>' AS article,
  '<nav><b></b><ul>' || {rest} || '<li>gone</li></ul></nav>' AS nav, '<footer><u>1</u><s>2</s></footer>' AS footer, 'wbr' AS behind, len(links) - 1 AS n_items, '<u>1</u>' AS "inner", false AS same
FROM p""",
        "page_attributes": f"""WITH {_P}
SELECT page_id, true AS had, {_BARE('hrefs[1]')} AS href, '<a title="a &quot;b&quot;">' || {first} || '</a>' AS changed, 'nav' AS by_id, 'one three' AS classes, '' AS "left", len(links) AS n_li, 1 AS n_charset, 0 AS n_exact,
  CASE WHEN has_ad THEN 1 ELSE 0 END AS n_ad, lang, 'charset' AS names, 'default' AS missing
FROM p""",
        "page_character_data": f"WITH {_P} SELECT page_id, substr({h1}, 1, 4) AS first, {changed} AS value, '<h1>' || {_ESCAPED(changed)} || '</h1>' AS html, {changed} AS text FROM p",
        "page_walk": f"""WITH {_P}
SELECT page_id, 2 + 2 * len(links) AS n_open, 2 + 2 * len(links) AS n_close, 3 AS deepest, 'nav ul li a' AS tags, len(links) AS n_texts, len(links) AS n_links, {_BARE('links[1]')} AS first_link, true AS all_li, len(links) AS n_again,
  true AS has_first, 2 AS n_listed, (len(links) + 1) // 2 AS n_odd, len(links) - 1 AS n_rest
FROM p""",
        "page_parts": f"""WITH {_P}
SELECT page_id, array_to_string(list_transform(hrefs, lambda x: {_BARE('x')}), ' ') AS hrefs, 'utf-8' AS charset, len(links) AS n_li, '<nav><ul>' || {items} || '</ul></nav>' AS nav, 0 AS nav_at, true AS has_article, CAST(NULL AS VARCHAR) AS nothing,
  len(links) AS n_a, '<meta charset="utf-8">' AS meta, CASE WHEN has_ad THEN 1 ELSE 0 END AS n_ad, 'none' AS h1_id
FROM p""",
        "page_bytes": f"SELECT page_id, {title} AS utf8, {title} AS utf16, {title} AS latin1 FROM pages",
        "page_text": f"WITH {_P} SELECT page_id, {_LIST('  • ')} || {_AD} || {_NL} || {_NL} || {_TEXT('h1')} || {_PARAGRAPHS} || {_NL} || {_NL} || {_TEXT('footer')} AS text FROM p",
        "page_main_content": f"""WITH {_P}
SELECT page_id, '<h1>' || {_QUOTED(_BARE("ltrim(regexp_replace(h1, '\\s+', ' ', 'g'))"))} || '</h1>' || array_to_string(list_transform(list_zip(ps, raw_ps), lambda z: {_NL} || {_NL} || '<p>' || {_QUOTED(_TEXT('z[1]'))} || CASE WHEN contains(z[2], '<br>') THEN '<br>' ELSE '' END || '</p>'), '') AS text
FROM p""",
        "page_text_options": f"""WITH {_P}
SELECT page_id, md5(array_to_string(list_filter([array_to_string(list_transform(links, lambda x: {_TEXT('x')}), ' '), CASE WHEN has_ad THEN {_TEXT('ad')} END, {_TEXT('h1')}, array_to_string(list_transform(ps, lambda x: {_TEXT('x')}), ' '), {_TEXT('footer')}], lambda x: x != ''), ' ')) AS flat,
  md5({_LIST('  ')} || {_NL} || {_NL} || {_TEXT('h1')} || {_PARAGRAPHS}) AS skipped,
  md5(array_to_string(list_transform(list_zip(links, hrefs), lambda z: '  • ' || {_TEXT('z[1]')} || '     (' || {_BARE('z[2]')} || ')'), {_NL})) AS linked, md5({_TEXT('h1')} || {_PARAGRAPHS}) AS main
FROM p""",
    }
