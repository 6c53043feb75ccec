"""HTML to an element tree, and CSS selection on it; plain Python for Arrow maps.

The tree builder is forgiving: implied ``html``, ``head`` and ``body``, closed-by-next
elements, void elements, stray end tags. Selectors cover types, ``*``, ids, classes,
attributes, the four combinators, groups, ``:nth-*``, ``:first/last/only-*``,
``:not``, ``:empty``, ``:contains`` and a final ``::attr(name)`` or ``::text``.
Anything else is an error rather than a silent miss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("title meta link base style script noscript".split())
#: Elements that a start tag closes when they are the innermost open one of their kind.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody"},
    "tfoot": {"tbody", "tr", "td", "th"},
}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "optgroup": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
_BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    index: int
    depth: int
    children: list = field(default_factory=list)  # nodes and texts in order

    def elements(self) -> list[Node]:
        return [c for c in self.children if type(c) is Node]

    def iter(self):
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            for c in reversed(node.children):
                if type(c) is Node:
                    stack.append(c)

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if type(c) is Node:
                stack.extend(reversed(c.children))
            else:
                out.append(c)
        return "".join(out)

    def ancestors(self) -> list[Node]:
        """From the root down to the parent."""
        out, node = [], self.parent
        while node is not None:
            out.append(node)
            node = node.parent
        return out[::-1]


class _Tree:
    """Start tags, end tags and texts in, an element tree out."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.root = self._add("html", {}, None)
        self.head = self.body = None
        self.open = [self.root]

    def _add(self, tag, attrs, parent):
        node = Node(tag, attrs, parent, len(self.nodes), parent.depth + 1 if parent else 0)
        self.nodes.append(node)
        if parent is not None:
            parent.children.append(node)
        return node

    def _place(self, tag):
        """Open the implied head or body for content that comes without them."""
        if self.open[-1] is not self.root:
            return
        if self.body is None and tag in _HEAD:
            if self.head is None:
                self.head = self._add("head", {}, self.root)
            self.open.append(self.head)
        else:
            if self.body is None:
                self.body = self._add("body", {}, self.root)
            self.open.append(self.body)

    def handle_starttag(self, tag, attrs):
        own = {}
        for k, v in attrs:
            own.setdefault(k, "" if v is None else v)
        self.start(tag, own)

    def start(self, tag, own):
        if tag == "html":
            for k, v in own.items():
                self.root.attrs.setdefault(k, v)
            return
        if tag in ("head", "body"):
            known = getattr(self, tag)
            if known is None:
                known = self._add(tag, own, self.root)
                setattr(self, tag, known)
            else:
                for k, v in own.items():
                    known.attrs.setdefault(k, v)
            self.open = [self.root, known]
            return
        if self.open[-1] is self.head and tag not in _HEAD:
            self.open = [self.root]
        if tag in _CLOSES:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in _SCOPES[tag]:
                    break
                if self.open[i].tag in _CLOSES[tag]:
                    del self.open[i:]
        if tag in _BLOCKS:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in ("table", "td", "th", "button", "object"):
                    break
                if self.open[i].tag == "p":
                    del self.open[i:]
                    break
        if self.open[-1] is self.root:
            self._place(tag)
        parent = self.open[-1]
        node = Node(tag, own, parent, len(self.nodes), parent.depth + 1, [])
        self.nodes.append(node)
        parent.children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("html", "head", "body") and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open[-1] is self.root or self.open[-1] is self.head:
            if not data.strip():
                return
            if self.open[-1] is self.head:
                self.open = [self.root]
            self._place("#text")
        self.open[-1].children.append(data)


class _Builder(_Tree, HTMLParser):
    def __init__(self):
        HTMLParser.__init__(self, convert_charrefs=True)
        _Tree.__init__(self)


#: Plain markup: lower-case tags, quoted values without references, texts.
_PLAIN = re.compile(r"""<(?:([a-z][a-z0-9]*)((?: [a-z][a-z-]*=(?:"[^"&]*"|'[^'&]*'))*)|/([a-z][a-z0-9]*))>|([^<]+)""")
_PAIR = re.compile(r"""([a-z][a-z-]*)=(?:"([^"]*)"|'([^']*)')""")
#: Elements whose content is read by rules of its own.
_RAW = frozenset("script style textarea xmp iframe noembed noframes noscript plaintext".split())


@lru_cache(maxsize=1 << 12)
def _own(text: str) -> dict[str, str]:
    own: dict[str, str] = {}
    for k, a, b in _PAIR.findall(text):
        own.setdefault(k, a or b)
    return own


def _plain(html: str) -> Node | None:
    """The tree of a page in plain markup, as the parser builds it; None for any other page."""
    tree, at, titled = _Tree(), 0, False
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        tag, attrs, end, text = m.groups()
        if text is not None:
            tree.handle_data(unescape(text) if "&" in text else text)
        elif titled and end != "title":
            return None
        elif end is not None:
            titled = False
            tree.handle_endtag(end)
        elif tag in _RAW:
            return None
        else:
            titled = tag == "title"
            tree.start(tag, dict(_own(attrs)) if attrs else {})
    return None if at != len(html) or titled else tree.root


def parse(html: str | None) -> Node:
    """The ``html`` element of a page; an empty page is an element without children."""
    root = _plain(html or "")
    if root is not None:
        return root
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


# Selectors ------------------------------------------------------------------

_TOKEN = re.compile(
    r"(?P<ws>\s*(?P<comb>[>+~])\s*|\s+)|(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w\\-]+)|\.(?P<cls>[\w\\-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]"
    r"|:(?P<pseudo>[a-z-]+)(?:\((?P<arg>(?:\"[^\"]*\"|'[^']*'|[^()])*)\))?",
)
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<c>[+-]?\d+))\s*\Z")


class SelectorError(ValueError):
    """A selector this engine doesn't support."""


def _nth(arg: str) -> tuple[int, int]:
    m = _NTH.match(arg or "")
    if not m:
        raise SelectorError(f"bad nth expression {arg!r}")
    if m["word"]:
        return (2, 1) if m["word"] == "odd" else (2, 0)
    if m["c"] is not None:
        return 0, int(m["c"])
    a = m["a"]
    return int(a + "1" if a in ("", "+", "-") else a), int((m["sign"] or "+") + (m["b"] or "0"))


def _nth_ok(position: int, a: int, b: int) -> bool:
    return position == b if a == 0 else (position - b) % a == 0 and (position - b) // a >= 0


def _siblings(node: Node, same_tag: bool) -> list[Node]:
    if node.parent is None:
        return [node]
    return [c for c in node.parent.elements() if not same_tag or c.tag == node.tag]


def _pseudo(name: str, arg: str | None):
    same = name.endswith("of-type")
    if name in ("first-child", "first-of-type"):
        return lambda n: _siblings(n, same)[0] is n
    if name in ("last-child", "last-of-type"):
        return lambda n: _siblings(n, same)[-1] is n
    if name in ("only-child", "only-of-type"):
        return lambda n: len(_siblings(n, same)) == 1
    if name in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type"):
        a, b = _nth(arg)
        last = "last" in name

        def ok(n):
            line = _siblings(n, same)
            at = next(i for i, s in enumerate(line) if s is n)
            return _nth_ok(len(line) - at if last else at + 1, a, b)

        return ok
    if name == "not":
        inner = compile_selector(arg or "").groups
        return lambda n: not any(_matches(n, g) for g in inner)
    if name == "empty":
        return lambda n: not n.children
    if name == "root":
        return lambda n: n.parent is None
    if name == "contains":
        needle = (arg or "").strip().strip("\"'")
        return lambda n: needle in n.text()
    raise SelectorError(f"unsupported pseudo-class :{name}")


def _attribute(name: str, op: str | None, value: str | None):
    if op is None:
        return lambda n: name in n.attrs
    tests = {
        "=": lambda have: have == value,
        "~=": lambda have: value in have.split(),
        "|=": lambda have: have == value or have.startswith(value + "-"),
        "^=": lambda have: bool(value) and have.startswith(value),
        "$=": lambda have: bool(value) and have.endswith(value),
        "*=": lambda have: bool(value) and value in have,
    }
    return lambda n: name in n.attrs and tests[op](n.attrs[name])


@dataclass(frozen=True)
class Compiled:
    groups: tuple
    take: str | None  # None for elements, "::text", or an attribute's name


def _split_groups(text: str) -> list[str]:
    out, depth, quote, at = [], 0, None, 0
    for i, c in enumerate(text):
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


@lru_cache(maxsize=1024)
def compile_selector(text: str) -> Compiled:
    take = None
    m = re.search(r"::(?:attr\(\s*([\w:-]+)\s*\)|(text))\s*\Z", text)
    if m:
        take, text = m[1] or "::text", text[: m.start()]
    groups = []
    for part in _split_groups(text):
        part = part.strip()
        if not part:
            raise SelectorError("empty selector")
        steps, tests, comb, at = [], [], None, 0
        while at < len(part):
            m = _TOKEN.match(part, at)
            if not m or m.end() == at:
                raise SelectorError(f"unsupported selector {text!r} at {at}")
            if m["ws"] is not None:
                steps.append((comb, tuple(tests)))
                tests, comb = [], m["comb"] or " "
            elif m["tag"]:
                tag = m["tag"].lower()
                tests.append((lambda n: True) if tag == "*" else (lambda n, t=tag: n.tag == t))
            elif m["id"]:
                tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
            elif m["cls"]:
                tests.append(lambda n, v=m["cls"]: v in n.attrs.get("class", "").split())
            elif m["attr"]:
                value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), None)
                tests.append(_attribute(m["attr"].lower(), m["op"], value))
            else:
                tests.append(_pseudo(m["pseudo"], m["arg"]))
            at = m.end()
        steps.append((comb, tuple(tests)))
        groups.append(tuple(steps))
    return Compiled(tuple(groups), take)


def _matches(node: Node, steps: tuple, at: int | None = None) -> bool:
    at = len(steps) - 1 if at is None else at
    comb, tests = steps[at]
    for t in tests:
        if not t(node):
            return False
    if at == 0:
        return True
    if comb == ">":
        return node.parent is not None and _matches(node.parent, steps, at - 1)
    if comb == " ":
        up = node.parent
        while up is not None:
            if _matches(up, steps, at - 1):
                return True
            up = up.parent
        return False
    line = _siblings(node, False)
    here = next(i for i, s in enumerate(line) if s is node)
    if comb == "+":
        return here > 0 and _matches(line[here - 1], steps, at - 1)
    return any(_matches(s, steps, at - 1) for s in line[:here])


def matching(root: Node, selector: str) -> Iterator[Node]:
    """Matching elements below ``root`` (``root`` itself only for a whole page), in order."""
    groups = compile_selector(selector).groups
    nodes = root.iter()
    if root.parent is not None:
        next(nodes)
    for n in nodes:
        for g in groups:
            if _matches(n, g):
                yield n
                break


def select(root: Node, selector: str) -> list[Node]:
    """:func:`matching` as a list."""
    return list(matching(root, selector))


# Derived values -------------------------------------------------------------

#: Attributes that tell states apart, and elements left out of a state.
STATE_ATTRIBUTES = (
    "role", "type", "disabled", "checked", "selected", "open", "aria-expanded", "aria-selected", "aria-checked", "aria-disabled",
)
DROPPED = frozenset({"script", "style", "noscript"})
#: Volatile texts, in the order they are masked.
VOLATILE = tuple(
    re.compile(p, re.I)
    for p in (
        r"\d{4}-\d{2}-\d{2}([t ]\d{2}:\d{2}(:\d{2})?(\.\d+)?z?)?",
        r"\b\d{1,2}:\d{2}(:\d{2})?\s*(am|pm)?\b",
        r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
        r"\b[0-9a-f]{16,}\b",
        r"\b[a-z0-9_-]{24,}\b",
        r"\d+",
    )
)


def state_id(html: str | None) -> str:
    """One id for renderings of the same state: structure, state attributes and masked text."""
    lines, texts, stack = [], [], [(parse(html), 0)]
    while stack:
        node, depth = stack.pop()
        if type(node) is str:
            texts.append(node)
            continue
        if node.tag in DROPPED:
            continue
        kept = ",".join(sorted(f"{a}={node.attrs[a]}" for a in STATE_ATTRIBUTES if a in node.attrs))
        lines.append(f"{depth}:{node.tag}[{kept}]")
        stack.extend((c, depth + 1) for c in reversed(node.children))
    text = " ".join(texts).lower()
    for pattern in VOLATILE:
        text = pattern.sub("\0", text)
    text = " ".join(text.split())
    return hashlib.sha256(("\n".join(lines) + "\0" + text).encode("utf-8", "backslashreplace")).hexdigest()


def normal_text(node: Node) -> str:
    """Text of an element as XPath normalize-space gives it: other blanks stay."""
    return re.sub("[ \t\r\n]+", " ", node.text()).strip(" ")


def fingerprints(root: Node, with_text: bool = True) -> dict[int, dict]:
    """What identifies each element once its selector no longer does, by ``id`` of the node.

    One walk down for ancestors and positions, one up for descendants and texts.
    """
    order, prints = [], {}
    stack: list[tuple[Node, tuple[str, ...], int]] = [(root, tuple(a.tag for a in root.ancestors()), _position(root))]
    while stack:
        node, above, position = stack.pop()
        order.append(node)
        attrs = dict(node.attrs)
        prints[id(node)] = {
            "tag": node.tag,
            "element_id": attrs.pop("id", ""),
            "classes": sorted(set(attrs.pop("class", "").split())),
            "attrs": dict(sorted(attrs.items())),
            "text": "",
            "ancestors": above,
            "sibling_index": position,
            "descendants": {},
            "visual_hash": None,
        }
        seen: dict[str, int] = {}
        inside = (*above, node.tag)
        for child in node.children:
            if type(child) is Node:
                stack.append((child, inside, seen.get(child.tag, 0)))
                seen[child.tag] = seen.get(child.tag, 0) + 1
    texts: dict[int, str] = {}
    for node in reversed(order):
        own = prints[id(node)]
        below: dict[str, int] = {}
        for child in node.children:
            if type(child) is Node:
                below[child.tag] = below.get(child.tag, 0) + 1
                for tag, n in prints[id(child)]["descendants"].items():
                    below[tag] = below.get(tag, 0) + n
        own["descendants"] = dict(sorted(below.items()))
        if with_text:
            texts[id(node)] = "".join(c if type(c) is str else texts[id(c)] for c in node.children)
            own["text"] = " ".join(texts[id(node)].split())
    return prints


Mark = tuple[str, tuple, tuple, int, tuple]


@lru_cache(maxsize=1 << 12)
def _below(children: tuple) -> tuple:
    below: dict[str, int] = {}
    for tag, inside in children:
        below[tag] = below.get(tag, 0) + 1
        for t, n in inside:
            below[t] = below.get(t, 0) + n
    return tuple(sorted(below.items()))


def marks(root: Node) -> dict[int, Mark]:
    """What :func:`fingerprints` without texts are made of, by ``id`` of the node; equal elements of many pages
    have equal marks, so what follows from a mark can be kept."""
    order, out, below = [], {}, {}
    stack = [(root, tuple(a.tag for a in root.ancestors()), _position(root))]
    while stack:
        node, above, position = visit = stack.pop()
        children = [c for c in node.children if type(c) is Node]
        order.append((visit, children))
        if children:
            inside, seen = (*above, node.tag), {}
            for child in children:
                tag = child.tag
                n = seen.get(tag, 0)
                seen[tag] = n + 1
                stack.append((child, inside, n))
    for (node, above, position), children in reversed(order):
        at = id(node)
        below[at] = inside = _below(tuple([(c.tag, below[id(c)]) for c in children])) if children else ()
        out[at] = (node.tag, tuple(node.attrs.items()), above, position, inside)
    return out


@lru_cache(maxsize=1 << 12)
def marked(mark: Mark) -> dict:
    """The fingerprint without text of a mark; shared, so not to be changed."""
    tag, items, above, position, below = mark
    attrs = dict(items)
    return {
        "tag": tag,
        "element_id": attrs.pop("id", ""),
        "classes": sorted(set(attrs.pop("class", "").split())),
        "attrs": dict(sorted(attrs.items())),
        "text": "",
        "ancestors": above,
        "sibling_index": position,
        "descendants": dict(below),
        "visual_hash": None,
    }


def _position(node: Node) -> int:
    return next(i for i, s in enumerate(_siblings(node, True)) if s is node)


def fingerprint(node: Node, with_text: bool = True) -> dict:
    """:func:`fingerprints` of one element."""
    return fingerprints(node, with_text)[id(node)]
