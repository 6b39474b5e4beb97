"""CSS selectors: compiled once, matched from right to left."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from .dom import ELEMENT, TEXT, Node

_NAME = re.compile(r"(?:[\w\-]|[^\x00-\x7f]|\\.)+")
_ATTR = re.compile(r"""\[\s*([\w\-:|]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]"']+))\s*([iIsS])?\s*)?\]""")
_NTH = re.compile(r"^\s*(?:(even|odd)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)

Test = Callable[[Node], bool]


def _name(s: str, at: int) -> tuple[str, int]:
    m = _NAME.match(s, at)
    if not m:
        raise ValueError(f"bad selector: {s!r} at {at}")
    return re.sub(r"\\(.)", r"\1", m.group()), m.end()


def _siblings(n: Node, same_type: bool) -> list[Node]:
    if n.parent is None:
        return [n]
    return [c for c in n.parent.children if c.type == ELEMENT and (not same_type or c.tag == n.tag)]


def _nth(arg: str, same_type: bool, last: bool) -> Test:
    m = _NTH.match(arg)
    if not m:
        raise ValueError(f"bad argument {arg!r}")
    if m.group(1):
        a, b = 2, int(m.group(1).lower() == "odd")
    elif m.group(5):
        a, b = 0, int(m.group(5))
    else:
        a = int(m.group(2) + "1") if m.group(2) in ("", "+", "-") else int(m.group(2))
        b = int((m.group(3) or "+") + (m.group(4) or "0"))

    def test(n: Node) -> bool:
        around = _siblings(n, same_type)
        i = (len(around) - around.index(n)) if last else around.index(n) + 1
        return i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0

    return test


def _pseudo(name: str, arg: str | None, css: str) -> Test:
    name = name.lower()
    if name in ("not", "is", "where", "matches", "has"):
        if arg is None:
            raise ValueError(f"bad selector: {css!r}")
        if name == "has":
            inner = arg.strip()
            relative = inner[:1] in ">+~"
            compiled = compile_selector(":scope " + inner if relative else inner)
            return lambda n: any(compiled(d, n) for d in ([*n.elements()] if not relative or inner[0] == ">" else _siblings(n, False)) if d is not n)
        compiled = compile_selector(arg)
        return (lambda n: not compiled(n, None)) if name == "not" else (lambda n: compiled(n, None))
    if name.startswith("nth-") and arg is not None:
        kind = name[4:]
        if kind in ("child", "last-child", "of-type", "last-of-type"):
            return _nth(arg, kind.endswith("of-type"), kind.startswith("last"))
    simple: dict[str, Test] = {
        "first-child": lambda n: _siblings(n, False)[0] is n,
        "last-child": lambda n: _siblings(n, False)[-1] is n,
        "only-child": lambda n: len(_siblings(n, False)) == 1,
        "first-of-type": lambda n: _siblings(n, True)[0] is n,
        "last-of-type": lambda n: _siblings(n, True)[-1] is n,
        "only-of-type": lambda n: len(_siblings(n, True)) == 1,
        "empty": lambda n: not any(c.type in (ELEMENT, TEXT) for c in n.children),
        "root": lambda n: n.tag == "html" and (n.parent is None or n.parent.type != ELEMENT),
        "checked": lambda n: "checked" in n.attrs or "selected" in n.attrs,
        "disabled": lambda n: "disabled" in n.attrs,
        "enabled": lambda n: n.tag in ("button", "input", "select", "textarea", "option") and "disabled" not in n.attrs,
        "required": lambda n: "required" in n.attrs,
        "optional": lambda n: n.tag in ("input", "select", "textarea") and "required" not in n.attrs,
        "link": lambda n: n.tag in ("a", "area") and "href" in n.attrs,
        "any-link": lambda n: n.tag in ("a", "area") and "href" in n.attrs,
        "placeholder-shown": lambda n: "placeholder" in n.attrs and not n.attrs.get("value"),
    }
    if name in simple and arg is None:
        return simple[name]
    raise ValueError(f"unknown pseudo-class :{name}")


def _attribute(m: re.Match) -> Test:
    name, op = m.group(1).lower(), m.group(2)
    if op is None:
        return lambda n: name in n.attrs
    want = next(x for x in m.groups()[2:5] if x is not None)
    fold = str.lower if (m.group(6) or "").lower() == "i" else str
    want = fold(want)
    tests: dict[str, Callable[[str], bool]] = {
        "=": lambda v: v == want,
        "~=": lambda v: bool(want) and want in v.split(),
        "|=": lambda v: v == want or v.startswith(want + "-"),
        "^=": lambda v: bool(want) and v.startswith(want),
        "$=": lambda v: bool(want) and v.endswith(want),
        "*=": lambda v: bool(want) and want in v,
    }
    test = tests[op]
    return lambda n: name in n.attrs and test(fold(n.attrs[name]))


def _compound(s: str, at: int) -> tuple[Callable, int]:
    tests: list[Callable] = []
    begin, scope = at, False
    while at < len(s):
        c = s[at]
        if c == "*":
            at += 1
            tests.append(lambda n: True)
        elif c == "#":
            name, at = _name(s, at + 1)
            tests.append(lambda n, name=name: n.attrs.get("id") == name)
        elif c == ".":
            name, at = _name(s, at + 1)
            tests.append(lambda n, name=name: name in n.attrs.get("class", "").split())
        elif c == "[":
            m = _ATTR.match(s, at)
            if not m:
                raise ValueError(f"bad selector: {s!r} at {at}")
            tests.append(_attribute(m))
            at = m.end()
        elif c == ":":
            name, at = _name(s, at + 1 + s.startswith("::", at))
            arg = None
            if s.startswith("(", at):
                depth, stop = 1, at + 1
                while stop < len(s) and depth:
                    depth += {"(": 1, ")": -1}.get(s[stop], 0)
                    stop += 1
                if depth:
                    raise ValueError(f"bad selector: {s!r}")
                arg, at = s[at + 1 : stop - 1], stop
            if name == "scope":
                scope = True
            else:
                tests.append(_pseudo(name, arg, s))
        elif _NAME.match(s, at) and at == begin:
            name, at = _name(s, at)
            tests.append(lambda n, name=name.lower(): n.tag == name)
        else:
            break
    if at == begin:
        raise ValueError(f"bad selector: {s!r} at {at}")
    return (lambda n, root: (not scope or n is root) and all(t(n) for t in tests)), at


def _complex(s: str) -> Callable:
    """One selector without commas, as a test of (node, scope)."""
    at, steps = 0, []
    s = s.strip()
    while True:
        test, at = _compound(s, at)
        steps.append(test)
        m = re.compile(r"\s*([>+~])\s*|\s+").match(s, at)
        if at >= len(s):
            break
        if not m:
            raise ValueError(f"bad selector: {s!r} at {at}")
        steps.append(m.group(1) or " ")
        at = m.end()

    def match(n: Node, root: Node | None, k: int = len(steps) - 1) -> bool:
        if not steps[k](n, root):
            return False
        if k == 0:
            return True
        how = steps[k - 1]
        if how == ">":
            return n.parent is not None and n.parent.type == ELEMENT and match(n.parent, root, k - 2)
        if how == " ":
            p = n.parent
            while p is not None and p.type == ELEMENT:
                if match(p, root, k - 2):
                    return True
                p = p.parent
            return False
        if how == "+":
            p = n.prev_element
            return p is not None and match(p, root, k - 2)
        p = n.prev_element
        while p is not None:
            if match(p, root, k - 2):
                return True
            p = p.prev_element
        return False

    return match


def _split(css: str) -> list[str]:
    out, depth, quote, now = [], 0, "", ""
    for c in css:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(now)
            now = ""
            continue
        now += c
    return [*out, now]


@lru_cache(512)
def compile_selector(css: str) -> Callable:
    """A test of (node, scope); ValueError for what isn't a selector."""
    tests = [_complex(s) for s in _split(css)]
    return tests[0] if len(tests) == 1 else lambda n, root: any(t(n, root) for t in tests)


def select(root: Node, css: str) -> list[Node]:
    """All elements below root that match, in document order."""
    test = compile_selector(css)
    return [n for n in root.elements() if test(n, root)]


def select_first(root: Node, css: str) -> Node | None:
    test = compile_selector(css)
    return next((n for n in root.elements() if test(n, root)), None)


def matches(node: Node, css: str) -> bool:
    return node.type == ELEMENT and compile_selector(css)(node, node)
