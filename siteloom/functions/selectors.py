"""CSS selectors over parsed HTML: type, universal, #id, .class, [attribute] with its operators, the four combinators,
lists, :first-child, :last-child, :only-child, :nth-child(an+b), :empty and :not() of a compound."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the key's kind closes. Fixed values.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_PART = re.compile(
    rf"""(?P<tag>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})
    |\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"[^"]*"|'[^']*'|{_NAME})\s*(?P<flag>[iI]?)\s*)?\]
    |:(?P<pseudo>[\w-]+)(?:\(\s*(?P<arg>[^()]*(?:\([^()]*\))?[^()]*)\s*\))?""", re.X)


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)

    def elements(self):
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.elements()[::-1]

    def text(self) -> str:
        out, stack = [], self.children[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack += x.children[::-1]
            else:
                out.append(x)
        return "".join(out)

    def inner_html(self) -> str:
        return "".join(c.outer_html() if isinstance(c, Node) else (c if self.tag in ("script", "style") else escape(c, quote=False)) for c in self.children)

    def outer_html(self) -> str:
        attrs = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{self.inner_html()}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        ends = CLOSED_BY.get(tag, set())
        if self.at.tag in ends or (self.at.tag == "p" and tag in _BLOCKS_END_P):
            self.at = self.at.parent
        node = Node(tag, {}, self.at)
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def document(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _nth(arg: str) -> tuple[int, int]:
    arg = arg.replace(" ", "").lower()
    if arg in ("odd", "even"):
        return (2, 1) if arg == "odd" else (2, 0)
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not m or not arg:
        raise ValueError(f"bad position {arg!r}")
    a = m[1]
    return (0 if a is None else int(a + "1") if a in ("", "+", "-") else int(a)), int(m[2] or 0)


def _test(m: re.Match):
    if m["tag"]:
        return (lambda n: True) if m["tag"] == "*" else (lambda n, t=m["tag"].lower(): n.tag == t)
    if m["id"]:
        return lambda n, v=m["id"]: n.attrs.get("id") == v
    if m["cls"]:
        return lambda n, v=m["cls"]: v in n.attrs.get("class", "").split()
    if m["attr"]:
        name, op, value, fold = m["attr"].lower(), m["op"], m["val"] or "", bool(m["flag"])
        value = value[1:-1] if value[:1] in ("'", '"') else value
        same = (lambda s: s.lower()) if fold else (lambda s: s)
        value = same(value)
        check = {
            None: lambda s: True, "=": lambda s: s == value, "~=": lambda s: value != "" and value in s.split(), "|=": lambda s: s == value or s.startswith(value + "-"),
            "^=": lambda s: value != "" and s.startswith(value), "$=": lambda s: value != "" and s.endswith(value), "*=": lambda s: value != "" and value in s}[op]
        return lambda n: name in n.attrs and check(same(n.attrs[name]))
    kind, arg = m["pseudo"].lower(), m["arg"]
    place = lambda n: [c for c in n.parent.elements()].index(n) + 1
    size = lambda n: len(n.parent.elements())
    if kind == "not" and arg:
        inner = _compound(arg)
        return lambda n: not all(t(n) for t in inner)
    if kind == "nth-child" and arg:
        a, b = _nth(arg)
        return lambda n: (place(n) - b) == 0 if a == 0 else (place(n) - b) % a == 0 and (place(n) - b) // a >= 0
    simple = {"first-child": lambda n: place(n) == 1, "last-child": lambda n: place(n) == size(n), "only-child": lambda n: size(n) == 1, "empty": lambda n: not any(isinstance(c, Node) or c for c in n.children),
              "root": lambda n: n.parent is not None and n.parent.parent is None}
    if kind not in simple or arg is not None:
        raise ValueError(f"unsupported :{kind}")
    return simple[kind]


def _compound(text: str) -> list:
    tests, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m or (m["tag"] and at):
            raise ValueError(f"cannot read {text[at:]!r}")
        tests.append(_test(m))
        at = m.end()
    if not tests:
        raise ValueError("an empty selector")
    return tests


def _split(text: str, seps: str) -> list[tuple[str, str]]:
    """(separator before, part) at top level, outside brackets and quotes."""
    out, depth, quote, held, before = [], 0, "", "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif not depth and c in seps:
            out.append((before, held))
            held, before = "", c
            continue
        held += c
    if quote or depth:
        raise ValueError("an open bracket or quote")
    return [*out, (before, held)]


def selector(text: str) -> list[list[tuple[str, list]]]:
    """Compiled: alternatives, each a list of (combinator before, tests of a compound); ValueError for what can't be read."""
    out = []
    for _, alternative in _split(text, ","):
        parts = _split(re.sub(r"\s*([>+~])(?!=)\s*", r"\1", re.sub(r"\s+", " ", alternative.strip())), " >+~")
        out.append([(sep, _compound(part)) for sep, part in parts])
    return out


def _holds(node: Node, steps: list, i: int) -> bool:
    sep, tests = steps[i]
    if node.parent is None or not all(t(node) for t in tests):
        return False
    if i == 0:
        return True
    if sep == ">":
        return _holds(node.parent, steps, i - 1)
    if sep == " ":
        up = node.parent
        while up is not None:
            if _holds(up, steps, i - 1):
                return True
            up = up.parent
        return False
    before = node.parent.elements()
    before = before[: before.index(node)]
    return any(_holds(b, steps, i - 1) for b in (before[-1:] if sep == "+" else before))


def select(root: Node, compiled: list):
    """Matching elements in document order."""
    for node in root.walk():
        if any(_holds(node, steps, len(steps) - 1) for steps in compiled):
            yield node
