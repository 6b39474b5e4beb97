"""An HTML5 tree: a tokenizer on one regular expression and a tree builder with implied tags, reopened formatting and content moved out of tables.

Nodes are mutable; what works on them lives beside them in css (selection) and extract (text). Nothing here needs Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape, unescape

ELEMENT, TEXT, COMMENT, DOCUMENT, DOCTYPE, FRAGMENT, PI, CDATA, ATTRIBUTE = "element", "text", "comment", "document", "doctype", "fragment", "pi", "cdata", "attribute"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame basefont bgsound command".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote br center details dd dt div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section table tr ul".split())
_HEAD = frozenset("base basefont bgsound link meta title style script noframes template".split())
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p search section summary ul pre listing h1 h2 h3 h4 h5 h6 li dd dt plaintext table xmp".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("applet caption html table td th marquee object template".split())
_TABLE = frozenset("table tbody thead tfoot tr".split())
_TABLE_PARTS = frozenset("caption col colgroup tbody thead tfoot tr td th".split())
_IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())

_TOKEN = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|!doctype(?P<doctype>[^>]*)(?:>|\Z)|(?P<bogus>[!?][^>]*|/(?![a-zA-Z])[^>]*)(?:>|\Z)"
    r"|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=|[\"'])*)(?:>|\Z))",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    """A node; equality is identity."""

    __slots__ = ("attrs", "children", "parent", "tag", "type", "value")

    def __init__(self, type: str, tag: str, value: str | None = None, attrs: dict[str, str] | None = None):
        self.type, self.tag, self.value, self.attrs = type, tag, value, attrs if attrs is not None else {}
        self.parent: Node | None = None
        self.children: list[Node] = []

    def __repr__(self) -> str:
        return f"<{self.tag}>" if self.type == ELEMENT else f"{self.tag} {self.value!r}" if self.value else self.tag

    # navigation

    @property
    def is_element(self) -> bool:
        return self.type == ELEMENT

    @property
    def first_child(self) -> Node | None:
        return self.children[0] if self.children else None

    @property
    def last_child(self) -> Node | None:
        return self.children[-1] if self.children else None

    @property
    def element_children(self) -> list[Node]:
        return [c for c in self.children if c.type == ELEMENT]

    @property
    def first_element_child(self) -> Node | None:
        return next((c for c in self.children if c.type == ELEMENT), None)

    @property
    def last_element_child(self) -> Node | None:
        return next((c for c in reversed(self.children) if c.type == ELEMENT), None)

    def _sibling(self, step: int, elements: bool) -> Node | None:
        if self.parent is None:
            return None
        around = self.parent.children
        i = around.index(self) + step
        while 0 <= i < len(around):
            if not elements or around[i].type == ELEMENT:
                return around[i]
            i += step
        return None

    @property
    def next(self) -> Node | None:
        return self._sibling(1, False)

    @property
    def prev(self) -> Node | None:
        return self._sibling(-1, False)

    @property
    def next_element(self) -> Node | None:
        return self._sibling(1, True)

    @property
    def prev_element(self) -> Node | None:
        return self._sibling(-1, True)

    @property
    def owner_document(self) -> Node | None:
        top = self
        while top.parent is not None:
            top = top.parent
        return top if top.type == DOCUMENT else None

    def contains(self, other: Node) -> bool:
        while other is not None:
            if other is self:
                return True
            other = other.parent
        return False

    def walk(self) -> Iterator[Node]:
        """The node and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    __iter__ = walk

    def elements(self) -> Iterator[Node]:
        """Elements below the node."""
        return (n for n in self.walk() if n.type == ELEMENT and n is not self)

    # content

    @property
    def text(self) -> str:
        if self.type in (TEXT, CDATA, COMMENT, PI):
            return self.value or ""
        return "".join(n.value for n in self.walk() if n.type in (TEXT, CDATA))

    @text.setter
    def text(self, value: str) -> None:
        if self.type in (TEXT, CDATA, COMMENT, PI):
            self.value = value
            return
        self.replace_children(Node(TEXT, "#text", value))

    def substring_data(self, start: int, n: int) -> str:
        """Of a text or comment, as are the following."""
        return self._data(start)[start : start + n]

    def append_data(self, data: str) -> None:
        self.value = self._data(0) + data

    def insert_data(self, start: int, data: str) -> None:
        self.replace_data(start, 0, data)

    def delete_data(self, start: int, n: int) -> None:
        self.replace_data(start, n, "")

    def replace_data(self, start: int, n: int, data: str) -> None:
        old = self._data(start)
        self.value = old[:start] + data + old[start + n :]

    def _data(self, start: int) -> str:
        if self.type not in (TEXT, CDATA, COMMENT, PI):
            raise ValueError("not character data")
        if not 0 <= start <= len(self.value or ""):
            raise IndexError(start)
        return self.value or ""

    @property
    def html(self) -> str:
        return serialize(self)

    @html.setter
    def html(self, value: str) -> None:
        self.replace_children(*parse_fragment(value, self.tag))

    @property
    def inner_html(self) -> str:
        return "".join(map(serialize, self.children))

    # attributes

    @property
    def id(self) -> str:
        return self.attrs.get("id", "")

    @id.setter
    def id(self, value: str) -> None:
        self.attrs["id"] = value

    @property
    def class_name(self) -> str:
        return self.attrs.get("class", "")

    @class_name.setter
    def class_name(self, value: str) -> None:
        self.attrs["class"] = value

    @property
    def class_list(self) -> ClassList:
        return ClassList(self)

    def hasattr(self, name: str) -> bool:
        return name.lower() in self.attrs

    def getattr(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name.lower(), default)

    def setattr(self, name: str, value: str) -> None:
        self.attrs[name.lower()] = value

    def delattr(self, name: str) -> None:
        self.attrs.pop(name.lower(), None)

    def toggle(self, name: str) -> bool:
        if self.hasattr(name):
            self.delattr(name)
            return False
        self.setattr(name, "")
        return True

    def __getitem__(self, name: str) -> str:
        return self.attrs[name.lower()]

    __setitem__ = setattr

    # selection

    def query_selector(self, css: str) -> Node | None:
        from .css import select_first

        return select_first(self, css)

    def query_selector_all(self, css: str) -> Collection:
        from .css import select

        return Collection(select(self, css))

    def matches(self, css: str) -> bool:
        """Whether the element itself matches."""
        from .css import matches

        return matches(self, css)

    def matches_any(self, css: str) -> bool:
        """Whether the element or one below it matches."""
        return self.matches(css) or self.query_selector(css) is not None

    def closest(self, css: str) -> Node | None:
        node = self
        while node is not None and node.type == ELEMENT:
            if node.matches(css):
                return node
            node = node.parent
        return None

    def get_elements_by_attr(self, name: str, value: str, case_insensitive: bool = False) -> Collection:
        name = name.lower()
        if case_insensitive:
            value = value.lower()
            return Collection(n for n in self.elements() if n.attrs.get(name, "\0").lower() == value)
        return Collection(n for n in self.elements() if n.attrs.get(name) == value)

    def get_element_by_id(self, id: str, case_insensitive: bool = False) -> Node | None:
        found = self.get_elements_by_attr("id", id, case_insensitive)
        return found[0] if found else None

    def get_elements_by_class_name(self, name: str, case_insensitive: bool = False) -> Collection:
        fold = str.lower if case_insensitive else str
        wanted = {fold(x) for x in name.split()}
        return Collection(n for n in self.elements() if wanted and wanted <= {fold(x) for x in n.attrs.get("class", "").split()})

    def get_elements_by_tag_name(self, name: str) -> Collection:
        name = name.lower()
        return Collection(n for n in self.elements() if name == "*" or n.tag == name)

    # changes

    def append_child(self, node: Node) -> Node:
        return self._insert(node, len(self.children))

    append = append_child

    def prepend(self, node: Node) -> Node:
        return self._insert(node, 0)

    def _insert(self, node: Node, at: int) -> Node:
        if node.contains(self):
            raise ValueError("a node can't be put below itself")
        if node.parent is not None:
            if node.parent is self and self.children.index(node) < at:
                at -= 1
            node.remove()
        new = node.children[:] if node.type == FRAGMENT else [node]
        for n in new:
            n.parent = self
        self.children[at:at] = new
        if node.type == FRAGMENT:
            node.children = []
        return node

    def insert_before(self, node: Node, reference: Node | None) -> Node:
        if reference is None:
            return self.append_child(node)
        if reference.parent is not self:
            raise ValueError("the reference isn't a child of this node")
        return self._insert(node, self.children.index(reference))

    def replace_child(self, new: Node, old: Node) -> Node:
        self.insert_before(new, old)
        return self.remove_child(old)

    def remove_child(self, node: Node) -> Node:
        if node.parent is not self:
            raise ValueError("not a child of this node")
        self.children.remove(node)
        node.parent = None
        return node

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.remove_child(self)

    def decompose(self) -> None:
        self.remove()
        self.children = []

    def before(self, node: Node) -> None:
        self.parent.insert_before(node, self)

    def after(self, node: Node) -> None:
        self.parent.insert_before(node, self.next)

    def replace_with(self, node: Node) -> None:
        self.parent.replace_child(node, self)

    def replace_children(self, *nodes: Node) -> None:
        for c in self.children:
            c.parent = None
        self.children = []
        for n in nodes:
            self.append_child(n)

    def clone(self, deep: bool = True) -> Node:
        out = Node(self.type, self.tag, self.value, dict(self.attrs))
        if deep:
            for c in self.children:
                out.append_child(c.clone())
        return out


class ClassList:
    """The classes of an element: ordered, each once; changes are written to the attribute."""

    def __init__(self, node: Node):
        self.node = node

    def _all(self) -> list[str]:
        return list(dict.fromkeys(self.node.attrs.get("class", "").split()))

    def _set(self, names: list[str]) -> None:
        self.node.attrs["class"] = " ".join(names)

    def add(self, name: str) -> None:
        if name not in self:
            self._set([*self._all(), name])

    def remove(self, name: str) -> None:
        if name in self:
            self._set([n for n in self._all() if n != name])

    def replace(self, old: str, new: str) -> bool:
        if old not in self:
            return False
        self._set(list(dict.fromkeys(new if n == old else n for n in self._all())))
        return True

    def toggle(self, name: str) -> bool:
        if name in self:
            self.remove(name)
            return False
        self.add(name)
        return True

    def __contains__(self, name: object) -> bool:
        return name in self._all()

    def __len__(self) -> int:
        return len(self._all())

    def __iter__(self) -> Iterator[str]:
        return iter(self._all())

    def __getitem__(self, i):
        return self._all()[i]

    def __eq__(self, other: object) -> bool:
        return self._all() == list(other)  # type: ignore[call-overload]

    __hash__ = None

    def __repr__(self) -> str:
        return repr(self._all())


class Collection(list):
    """Nodes as a list; queries look below each of them."""

    def __init__(self, nodes=()):
        super().__init__(nodes)

    def __getitem__(self, i):
        got = super().__getitem__(i)
        return Collection(got) if isinstance(i, slice) else got

    def _below(self, f: Callable[[Node], list[Node]]) -> Collection:
        return Collection(dict.fromkeys(n for m in self for n in f(m)))

    def query_selector(self, css: str) -> Node | None:
        return next((n for m in self if (n := m.query_selector(css)) is not None), None)

    def query_selector_all(self, css: str) -> Collection:
        return self._below(lambda m: m.query_selector_all(css))

    def matches(self, css: str) -> bool:
        return any(m.matches_any(css) for m in self)

    def get_element_by_id(self, id: str, case_insensitive: bool = False) -> Node | None:
        return next((n for m in self if (n := m.get_element_by_id(id, case_insensitive)) is not None), None)

    def get_elements_by_attr(self, name: str, value: str, case_insensitive: bool = False) -> Collection:
        return self._below(lambda m: m.get_elements_by_attr(name, value, case_insensitive))

    def get_elements_by_class_name(self, name: str, case_insensitive: bool = False) -> Collection:
        return self._below(lambda m: m.get_elements_by_class_name(name, case_insensitive))

    def get_elements_by_tag_name(self, name: str) -> Collection:
        return self._below(lambda m: m.get_elements_by_tag_name(name))


class Tree:
    """A parsed document; it always has html, head and body."""

    def __init__(self, document: Node):
        self.document = document

    def _part(self, name: str) -> Node | None:
        root = next((c for c in self.document.children if c.tag == "html"), None)
        return None if root is None else next((c for c in root.children if c.tag == name), None)

    @property
    def head(self) -> Node | None:
        return self._part("head")

    @property
    def body(self) -> Node | None:
        return self._part("body") or self._part("frameset")

    @property
    def title(self) -> str | None:
        """Of the head or, failing that, of the document; titles of drawings don't count. White space is collapsed."""
        for n in self.document.walk():
            if n.type == ELEMENT and n.tag == "title" and not _in_foreign(n):
                return " ".join(n.text.split())
        return ""

    def create_element(self, tag: str) -> Node:
        return Node(ELEMENT, tag.lower())

    def create_text_node(self, text: str) -> Node:
        return Node(TEXT, "#text", text)

    def create_comment(self, text: str) -> Node:
        return Node(COMMENT, "#comment", text)

    def create_fragment(self) -> Node:
        return Node(FRAGMENT, "#document-fragment")

    def __str__(self) -> str:
        return serialize(self.document)


def _in_foreign(n: Node) -> bool:
    n = n.parent
    while n is not None:
        if n.tag in ("svg", "math"):
            return True
        n = n.parent
    return False


def serialize(node: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.type == TEXT:
            raw = n.parent is not None and n.parent.tag in RAW
            out.append(n.value if raw else escape(n.value, quote=False).replace("\xa0", "&nbsp;"))
        elif n.type == COMMENT:
            out.append(f"<!--{n.value}-->")
        elif n.type == DOCTYPE:
            out.append(f"<!DOCTYPE {n.value}>")
        elif n.type == ELEMENT:
            attrs = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in n.attrs.items())
            out.append(f"<{n.tag}{attrs}>")
            if n.tag not in VOID:
                stack.append(f"</{n.tag}>")
                stack.extend(reversed(n.children))
        else:
            stack.extend(reversed(n.children))
    return "".join(out)


class _Builder:
    def __init__(self, fragment: str | None = None):
        self.document = Node(DOCUMENT, "#document")
        self.html = self.head = self.body = None
        self.open: list[Node] = []
        self.active: list[Node | None] = []
        self.after_head = False
        if fragment is not None:
            self._need_body()

    # insertion

    def _place(self) -> tuple[Node, Node | None]:
        """Where the next node goes: into a parent, before a child or at the end."""
        at = self.open[-1]
        if at.tag in _TABLE:
            table = next((n for n in reversed(self.open) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                return table.parent, table
        return at, None

    def _put(self, node: Node, foster: bool) -> None:
        parent, before = self._place() if foster else (self.open[-1], None)
        node.parent = parent
        if before is None:
            parent.children.append(node)
        else:
            parent.children.insert(parent.children.index(before), node)

    def _element(self, tag: str, attrs: dict[str, str], foster: bool = False) -> Node:
        node = Node(ELEMENT, tag, None, attrs)
        self._put(node, foster and self.open[-1].tag in _TABLE)
        if tag not in VOID:
            self.open.append(node)
        return node

    def _need_html(self) -> None:
        if self.html is None:
            self.html = Node(ELEMENT, "html")
            self.html.parent = self.document
            self.document.children.append(self.html)
            self.open = [self.html]

    def _need_head(self) -> None:
        self._need_html()
        if self.head is None:
            self.head = Node(ELEMENT, "head")
            self.head.parent = self.html
            self.html.children.append(self.head)
            self.open = [self.html, self.head]

    def _need_body(self) -> None:
        if self.body is None:
            self._need_head()
            self.body = Node(ELEMENT, "body")
            self.body.parent = self.html
            self.html.children.append(self.body)
            self.open = [self.html, self.body]

    # scopes

    def _in_scope(self, tags, also=frozenset()) -> bool:
        for n in reversed(self.open):
            if n.tag in tags:
                return True
            if n.tag in _SCOPE or n.tag in also:
                return False
        return False

    def _pop_to(self, tags) -> None:
        while self.open:
            if self.open.pop().tag in tags:
                break

    def _close_p(self) -> None:
        if self._in_scope(("p",), ("button",)):
            self._pop_to(("p",))

    def _imply_ends(self, but: str | None = None) -> None:
        while self.open[-1].tag in _IMPLIED_END and self.open[-1].tag != but:
            self.open.pop()

    def _reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.open:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.open:
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self._element(old.tag, dict(old.attrs), True)

    def _to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def _adopt(self, tag: str) -> None:
        """The end tag of a formatting element, which may cross blocks."""
        for _ in range(8):
            element = None
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == tag:
                    element = n
                    break
            if element is None:
                self._end_other(tag)
                return
            if element not in self.open:
                self.active.remove(element)
                return
            at = self.open.index(element)
            block = next((n for n in self.open[at + 1 :] if n.tag in _SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.active.remove(element)
                return
            ancestor, mark = self.open[at - 1], self.active.index(element)
            last, i = block, self.open.index(block)
            while True:
                i -= 1
                node = self.open[i]
                if node is element:
                    break
                if node not in self.active:
                    self.open.remove(node)
                    continue
                copy = Node(ELEMENT, node.tag, None, dict(node.attrs))
                self.active[self.active.index(node)] = copy
                self.open[i] = copy
                if last is block:
                    mark = self.active.index(copy) + 1
                last.remove()
                copy.append_child(last)
                last = copy
            last.remove()
            if ancestor.tag in _TABLE and ancestor.parent is not None:
                ancestor.parent.insert_before(last, ancestor)
            else:
                ancestor.append_child(last)
            copy = Node(ELEMENT, element.tag, None, dict(element.attrs))
            for c in block.children:
                c.parent = copy
            copy.children, block.children = block.children, []
            block.append_child(copy)
            place = self.active.index(element)
            self.active.remove(element)
            self.active.insert(mark - (place < mark), copy)
            self.open.remove(element)
            self.open.insert(self.open.index(block) + 1, copy)

    def _end_other(self, tag: str) -> None:
        for n in reversed(self.open):
            if n.tag == tag:
                self._imply_ends(tag)
                while self.open.pop() is not n:
                    pass
                return
            if n.tag in _SPECIAL:
                return

    # tokens

    def text(self, data: str) -> None:
        if not data:
            return
        if self.body is None:
            if self.open and self.open[-1].tag in ("title", "noscript", "style", "script"):
                self._text(data, False)
                return
            rest = data.lstrip()
            if not rest:
                if self.head is not None and not self.after_head:
                    self._text(data, False)
                return
            data = rest
            self._need_body()
        if self.open[-1].tag in _TABLE and not data.strip():
            self._text(data, False)
            return
        self._reconstruct()
        self._text(data, True)

    def _text(self, data: str, foster: bool) -> None:
        parent, before = self._place() if foster else (self.open[-1], None)
        at = len(parent.children) if before is None else parent.children.index(before)
        if at and parent.children[at - 1].type == TEXT:
            parent.children[at - 1].value += data
            return
        node = Node(TEXT, "#text", data)
        node.parent = parent
        parent.children.insert(at, node)

    def comment(self, data: str) -> None:
        node = Node(COMMENT, "#comment", data)
        parent = self.open[-1] if self.open else self.document
        node.parent = parent
        parent.children.append(node)

    def doctype(self, data: str) -> None:
        if self.html is None:
            node = Node(DOCTYPE, "#doctype", " ".join(data.split()))
            node.parent = self.document
            self.document.children.append(node)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            self._need_html()
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None:
                self._need_head()
                self.head.attrs = attrs
            return
        if tag == "body":
            fresh = self.body is None
            self._need_body()
            for k, v in attrs.items():
                if fresh or k not in self.body.attrs:
                    self.body.attrs[k] = v
            return
        if self.body is None:
            if tag in _HEAD or (tag == "noscript" and not self.after_head):
                self._need_head()
                if self.after_head:
                    self.open = [self.html, self.head]
                self._element(tag, attrs)
                return
            if self.open and self.open[-1].tag == "noscript":
                self.open.pop()
            self._need_body()
        top = self.open[-1].tag
        if tag in _TABLE_PARTS:
            self._table_part(tag, attrs)
            return
        if top == "select" and tag in ("input", "textarea", "select"):
            self._pop_to(("select",))
            if tag == "select":
                return
        if tag in _CLOSES_P:
            self._close_p()
        if tag in _HEADINGS and self.open[-1].tag in _HEADINGS:
            self.open.pop()
        elif tag == "li":
            self._close_item(("li",), ("ul", "ol", "menu"))
        elif tag in ("dd", "dt"):
            self._close_item(("dd", "dt"), ("dl",))
        elif tag == "button" and self._in_scope(("button",)):
            self._imply_ends()
            self._pop_to(("button",))
        elif tag == "option" and self.open[-1].tag == "option":
            self.open.pop()
        elif tag == "optgroup":
            while self.open[-1].tag in ("option", "optgroup"):
                self.open.pop()
        elif tag == "a" and any(n is not None and n.tag == "a" for n in self._since_marker()):
            self._adopt("a")
        if tag in _FORMATTING:
            self._reconstruct()
            node = self._element(tag, attrs, True)
            same = [n for n in self._since_marker() if n.tag == tag and n.attrs == attrs]
            if len(same) >= 3:
                self.active.remove(same[0])
            self.active.append(node)
            return
        if tag not in _SPECIAL or tag in ("br", "img", "input", "embed", "area", "wbr", "button", "select", "object", "applet", "marquee"):
            self._reconstruct()
        self._element(tag, attrs, True)
        if tag in ("applet", "marquee", "object"):
            self.active.append(None)

    def _since_marker(self) -> list[Node]:
        out = []
        for n in reversed(self.active):
            if n is None:
                break
            out.append(n)
        return out[::-1]

    def _close_item(self, tags, stops) -> None:
        for n in reversed(self.open):
            if n.tag in tags:
                self._imply_ends(n.tag)
                self._pop_to((n.tag,))
                break
            if n.tag in stops or (n.tag in _SPECIAL and n.tag not in ("address", "div", "p")):
                break
        self._close_p()

    def _table_part(self, tag: str, attrs: dict[str, str]) -> None:
        if not any(n.tag in ("table", "template") for n in self.open):
            return
        if tag in ("td", "th"):
            self._clear_to(("td", "th"), ("tr", "tbody", "thead", "tfoot", "table"))
            if self.open[-1].tag == "table":
                self._element("tbody", {})
            if self.open[-1].tag in ("tbody", "thead", "tfoot"):
                self._element("tr", {})
            self._element(tag, attrs)
            self.active.append(None)
            return
        if tag == "tr":
            self._clear_to((), ("tbody", "thead", "tfoot", "table"))
            if self.open[-1].tag == "table":
                self._element("tbody", {})
        elif tag == "col":
            self._clear_to((), ("colgroup", "table"))
        else:
            self._clear_to((), ("table",))
        self._element(tag, attrs)
        if tag == "caption":
            self.active.append(None)

    def _clear_to(self, _, tags) -> None:
        while self.open[-1].tag not in tags and self.open[-1].tag not in ("html", "template", "body"):
            if self.open.pop().tag in ("td", "th", "caption"):
                self._to_marker()

    def end(self, tag: str) -> None:
        if tag == "head":
            if self.body is None:
                self._need_head()
                self.open, self.after_head = [self.html], True
            return
        if tag in ("html", "body"):
            if self.body is not None:
                self._imply_ends()
            return
        if self.body is None:
            if self.open and self.open[-1].tag == tag and self.open[-1] not in (self.html, self.head):
                self.open.pop()
                if self.after_head:
                    self.open = [self.html]
                return
            if tag not in ("p", "br"):
                return
            self._need_body()
        if tag in _FORMATTING:
            self._adopt(tag)
        elif tag == "p":
            if not self._in_scope(("p",), ("button",)):
                self._element("p", {}, True)
            self._imply_ends("p")
            self._pop_to(("p",))
        elif tag == "br":
            self._reconstruct()
            self._element("br", {}, True)
        elif tag in _HEADINGS:
            if self._in_scope(_HEADINGS):
                self._imply_ends()
                self._pop_to(_HEADINGS)
        elif tag in _TABLE_PARTS or tag == "table":
            if any(n.tag == tag for n in self.open) and self._in_table(tag):
                while True:
                    n = self.open.pop()
                    if n.tag in ("td", "th", "caption"):
                        self._to_marker()
                    if n.tag == tag:
                        break
        elif tag == "li":
            if self._in_scope(("li",), ("ul", "ol")):
                self._imply_ends("li")
                self._pop_to(("li",))
        elif tag in _SPECIAL:
            if self._in_scope((tag,)):
                self._imply_ends(tag)
                self._pop_to((tag,))
                if tag in ("applet", "marquee", "object"):
                    self._to_marker()
        else:
            self._end_other(tag)

    def _in_table(self, tag: str) -> bool:
        for n in reversed(self.open):
            if n.tag == tag:
                return True
            if n.tag == "table":
                return False
        return False


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        name, a, b, c = m.groups()
        value = a if a is not None else b if b is not None else c or ""
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


def _build(source: str, builder: _Builder) -> _Builder:
    source = source.replace("\r\n", "\n").replace("\r", "\n") if "\r" in source else source
    at, n = 0, len(source)
    match = _TOKEN.search
    while at < n:
        m = match(source, at)
        begin = m.start() if m else n
        if begin > at:
            data = source[at:begin]
            builder.text(unescape(data) if "&" in data else data)
        if m is None:
            break
        at = m.end()
        kind = m.lastgroup
        if kind in ("start", "attrs"):
            tag, raw = m.group("start").lower(), m.group("attrs")
            builder.start(tag, _attributes(raw) if raw and not raw.isspace() else {})
            if tag in RAW or tag in ("textarea", "title", "plaintext"):
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at) if tag != "plaintext" else None
                data = source[at : close.start() if close else n]
                if tag == "textarea" and data.startswith("\n"):
                    data = data[1:]
                if data and builder.open and builder.open[-1].tag == tag:
                    builder._text(data if tag in RAW else unescape(data), False)
                if builder.open and builder.open[-1].tag == tag:
                    builder.open.pop()
                    if builder.body is None and builder.after_head:
                        builder.open = [builder.html]
                at = close.end() if close else n
            elif tag in ("pre", "listing") and source.startswith("\n", at):
                at += 1
            elif raw.rstrip().endswith("/") and builder.open and builder.open[-1].tag == tag and any(x.tag in ("svg", "math") for x in builder.open[:-1]):
                builder.open.pop()
        elif kind == "end":
            builder.end(m.group("end").lower())
        elif kind == "comment":
            builder.comment(m.group("comment"))
        elif kind == "doctype":
            builder.doctype(m.group("doctype"))
        elif kind == "cdata":
            if any(x.tag in ("svg", "math") for x in builder.open):
                builder.text(m.group("cdata"))
            else:
                builder.comment(f"[CDATA[{m.group('cdata')}]]")
        elif kind == "bogus" and not m.group("bogus").startswith("/"):
            builder.comment(m.group("bogus")[1:] if m.group("bogus")[0] == "!" else m.group("bogus"))
    return builder


def parse(source: str) -> Tree:
    b = _build(source, _Builder())
    b._need_body()
    return Tree(b.document)


def parse_bytes(data: bytes, encoding: str = "utf-8", errors: str = "ignore") -> Tree:
    from ..functions.encoding import bytes_to_str, map_label

    return parse(bytes_to_str(data, map_label(encoding), errors) or "")


def parse_fragment(source: str, context: str = "div") -> list[Node]:
    b = _build(source, _Builder(context))
    out = b.body.children[:]
    for n in out:
        n.parent = None
    b.body.children = []
    return out


def traverse(base: Node, start: Callable, end: Callable | None = None, context: dict | None = None, elements_only: bool = False) -> None:
    """Calls start(node, context) before what is below a node and end after it; context also tells the depth."""
    context = {} if context is None else context
    stack: list[tuple[Node, int, bool]] = [(base, 0, False)]
    while stack:
        node, depth, left = stack.pop()
        context["depth"] = depth
        if left:
            end(node, context)
            continue
        start(node, context)
        if end is not None:
            stack.append((node, depth, True))
        stack.extend((c, depth + 1, False) for c in reversed(node.children) if not elements_only or c.type == ELEMENT)
