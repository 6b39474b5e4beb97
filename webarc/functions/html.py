"""HTML columns as Arrow UDFs, and table functions for nodes and links.

A page is parsed once a call; analyze_page computes several things from one parse.
NULL pages give NULL; selectors are compiled on the driver first, so a bad one fails at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..html import extract
from ..html.css import compile_selector
from ..html.dom import ELEMENT, Node, Tree, parse

NODE = "struct<tag:string,text:string,html:string,id:string,class:string,attrs:map<string,string>,value:string>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _over(kind: str, page: Column | str, f) -> Column:
    """A UDF of the parsed page."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else f(parse(h)) for h in s], dtype=object)

    return run(_c(page))


def _row(n: Node) -> dict:
    return {"tag": n.tag, "text": n.text, "html": n.html, "id": n.id, "class": n.class_name, "attrs": dict(n.attrs), "value": None if n.type == ELEMENT else n.value}


def html_title(page: Column | str) -> Column:
    return _over("string", page, lambda t: t.title)


def html_text(page: Column | str, css: str = "body") -> Column:
    """Text below the first match."""
    compile_selector(css)
    return _over("string", page, lambda t: None if (n := t.document.query_selector(css)) is None else n.text)


def html_visible_text(page: Column | str) -> Column:
    return _over("string", page, lambda t: extract.visible_text(t.body))


def html_serialize(page: Column | str, css: str = "html") -> Column:
    compile_selector(css)
    return _over("string", page, lambda t: None if (n := t.document.query_selector(css)) is None else n.html)


def html_select(page: Column | str, css: str) -> Column:
    """All matches, as ARRAY of node structs; slice, element_at and size work on it."""
    compile_selector(css)

    @F.pandas_udf(f"array<{NODE}>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else [_row(n) for n in parse(h).document.query_selector_all(css)] for h in s], dtype=object)

    return run(_c(page))


def html_select_first(page: Column | str, css: str) -> Column:
    return F.get(html_select(page, css), F.lit(0))


def html_select_text(page: Column | str, css: str) -> Column:
    """The texts of all matches."""
    compile_selector(css)
    return _over("array<string>", page, lambda t: [n.text for n in t.document.query_selector_all(css)])


def html_attr(page: Column | str, css: str, name: str, default: str | None = None) -> Column:
    """An attribute of the first match: NULL if there is none, '' if it is empty."""
    compile_selector(css)
    return _over("string", page, lambda t: default if (n := t.document.query_selector(css)) is None else n.getattr(name, default))


def html_attrs(page: Column | str, css: str, name: str) -> Column:
    """The attribute of all matches that have it."""
    compile_selector(css)
    return _over("array<string>", page, lambda t: [n.attrs[name] for n in t.document.query_selector_all(css) if name in n.attrs])


def html_matches(page: Column | str, css: str) -> Column:
    """Whether any element of the page matches."""
    compile_selector(css)
    return _over("boolean", page, lambda t: t.document.query_selector(css) is not None)


def html_count(page: Column | str, css: str) -> Column:
    compile_selector(css)
    return _over("int", page, lambda t: len(t.document.query_selector_all(css)))


def html_remove(page: Column | str, css: str) -> Column:
    """The page without the matches and what is below them."""
    compile_selector(css)

    def cut(t: Tree) -> str:
        for n in t.document.query_selector_all(css):
            n.decompose()
        return str(t)

    return _over("string", page, cut)


def html_by_id(page: Column | str, id: str, case_insensitive: bool = False) -> Column:
    return _over("string", page, lambda t: None if (n := t.document.get_element_by_id(id, case_insensitive)) is None else n.html)


def html_by_class(page: Column | str, name: str, case_insensitive: bool = False) -> Column:
    return _over("array<string>", page, lambda t: [n.html for n in t.document.get_elements_by_class_name(name, case_insensitive)])


def html_by_attr(page: Column | str, name: str, value: str, case_insensitive: bool = False) -> Column:
    return _over("array<string>", page, lambda t: [n.html for n in t.document.get_elements_by_attr(name, value, case_insensitive)])


def html_by_tag(page: Column | str, name: str) -> Column:
    return _over("array<string>", page, lambda t: [n.html for n in t.document.get_elements_by_tag_name(name)])


def extract_plain_text(page: Column | str, **options) -> Column:
    """Plain text; the options are those of webarc.html.extract.extract_plain_text."""
    return _over("string", page, lambda t: extract.extract_plain_text(t, **options))


_PARTS = {
    "title": ("string", lambda t: t.title),
    "text": ("string", lambda t: extract.extract_plain_text(t)),
    "main_text": ("string", lambda t: extract.extract_plain_text(t, main_content=True)),
    "visible_text": ("string", lambda t: extract.visible_text(t.body)),
    "lang": ("string", lambda t: next((c.attrs.get("lang") for c in t.document.children if c.tag == "html"), None)),
    "links": ("array<string>", lambda t: [n.attrs["href"] for n in t.document.elements() if n.tag == "a" and "href" in n.attrs]),
    "n_elements": ("int", lambda t: sum(1 for _ in t.document.elements())),
}


def analyze_page(page: Column | str, parts: list[str]) -> Column:
    """STRUCT of the named parts (title, text, main_text, visible_text, lang, links, n_elements), from one parse."""
    unknown = set(parts) - set(_PARTS)
    if unknown:
        raise ValueError(f"unknown parts {sorted(unknown)}")

    @F.pandas_udf("struct<" + ",".join(f"{p}:{_PARTS[p][0]}" for p in parts) + ">")
    def run(s: pd.Series) -> pd.DataFrame:
        trees = [None if h is None else parse(h) for h in s]
        return pd.DataFrame({p: pd.Series([None if t is None else _PARTS[p][1](t) for t in trees], dtype=object) for p in parts})

    return F.when(_c(page).isNotNull(), run(_c(page)))


_SELECTED = {
    "text": ("string", lambda d, css: None if (n := d.query_selector(css)) is None else n.text),
    "texts": ("array<string>", lambda d, css: [n.text for n in d.query_selector_all(css)]),
    "html": ("string", lambda d, css: None if (n := d.query_selector(css)) is None else n.html),
    "attr": ("string", lambda d, css, name: None if (n := d.query_selector(css)) is None else n.getattr(name)),
    "attrs": ("array<string>", lambda d, css, name: [n.attrs[name] for n in d.query_selector_all(css) if name in n.attrs]),
    "count": ("int", lambda d, css: len(d.query_selector_all(css))),
    "matches": ("boolean", lambda d, css: d.query_selector(css) is not None),
}


def select_page(page: Column | str, wanted: dict[str, tuple[str, ...]]) -> Column:
    """STRUCT of selections by name, from one parse: (kind, selector) or, for attr and attrs, (kind, selector, attribute). Kinds: text, texts, html, attr, attrs, count, matches; as the functions of these names."""
    for kind, css, *_ in wanted.values():
        if kind not in _SELECTED:
            raise ValueError(f"unknown kind {kind}")
        compile_selector(css)

    @F.pandas_udf("struct<" + ",".join(f"`{k}`:{_SELECTED[w[0]][0]}" for k, w in wanted.items()) + ">")
    def run(s: pd.Series) -> pd.DataFrame:
        trees = [None if h is None else parse(h).document for h in s]
        return pd.DataFrame({k: pd.Series([None if t is None else _SELECTED[w[0]][1](t, *w[1:]) for t in trees], dtype=object) for k, w in wanted.items()})

    return F.when(_c(page).isNotNull(), run(_c(page)))


@F.udtf(returnType="node_id int, parent_id int, depth int, pos int, type string, tag string, attrs map<string,string>, text string")
class HtmlNodes:
    """The nodes of a page as rows, in document order; parent_id and pos rebuild the tree."""

    def eval(self, page: str):
        if page is None:
            return
        ids: dict[int, int] = {}
        stack = [(parse(page).document, None, 0, 0)]
        while stack:
            n, parent, depth, pos = stack.pop()
            ids[id(n)] = me = len(ids)
            yield me, parent, depth, pos, n.type, n.tag, dict(n.attrs), n.value
            stack.extend((c, me, depth + 1, i) for i, c in reversed(list(enumerate(n.children))))


@F.udtf(returnType="href string, text string, rel string")
class HtmlLinks:
    """Links of a page, in document order."""

    def eval(self, page: str):
        if page is not None:
            for n in parse(page).document.get_elements_by_tag_name("a"):
                if "href" in n.attrs:
                    yield n.attrs["href"], " ".join(n.text.split()), n.attrs.get("rel")


def register(spark: SparkSession) -> SparkSession:
    """The table functions under their SQL names: SELECT ... FROM pages, LATERAL html_nodes(html)."""
    spark.udtf.register("html_nodes", HtmlNodes)
    spark.udtf.register("html_links", HtmlLinks)
    return spark
