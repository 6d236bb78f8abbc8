"""A tolerant HTML tree on the standard library, with CSS selectors and a subset of XPath."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

# Fixed values of the HTML standard: elements without content, and those that a following one of the same kind closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IMPLIED = {"p": frozenset(["p"]), "li": frozenset(["li"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
_P_CLOSERS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPES = {"li": ("ul", "ol"), "td": ("table",), "th": ("table",), "tr": ("table",), "dt": ("dl",), "dd": ("dl",)}
_HIDDEN = frozenset(["script", "style", "template"])


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str | Comment] = []

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def tokens(self, name: str) -> list[str]:
        return (self.attrs.get(name) or "").split()

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node):
                    yield x
                    stack.append(iter(x.children))
                    break
            else:
                stack.pop()

    def all(self, *tags: str, where: Callable[[Node], bool] | None = None) -> Iterator[Node]:
        return (n for n in self.walk() if (not tags or n.tag in tags) and (where is None or where(n)))

    def first(self, *tags: str, where: Callable[[Node], bool] | None = None) -> Node | None:
        return next(self.all(*tags, where=where), None)

    def strings(self) -> Iterator[str]:
        """Texts below; those of scripts and styles only for such an element itself."""
        own = self.tag in _HIDDEN
        stack: list = [iter(self.children)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node):
                    if own or x.tag not in _HIDDEN:
                        stack.append(iter(x.children))
                        break
                elif isinstance(x, str):
                    yield x
            else:
                stack.pop()

    def text(self, separator: str = "", strip: bool = False) -> str:
        parts = self.strings()
        return separator.join(filter(None, (p.strip() for p in parts)) if strip else parts)

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def index(self) -> int:
        """Place among the element children of the parent, from 1."""
        return 1 + [x for x in self.parent.children if isinstance(x, Node)].index(self) if self.parent else 1

    def remove(self) -> None:
        if self.parent:
            self.parent.children = [x for x in self.parent.children if x is not self]
            self.parent = None

    def html(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                if x.tag:
                    out.append("<" + x.tag + "".join(f' {k}="{escape(v)}"' if v is not None else f" {k}" for k, v in x.attrs.items()) + ("/>" if x.tag in VOID else ">"))
                if x.tag not in VOID:
                    if x.tag:
                        stack.append(Raw(f"</{x.tag}>"))
                    raw = x.tag in _HIDDEN
                    stack += [Raw(c) if raw and isinstance(c, str) else c for c in reversed(x.children)]
            elif isinstance(x, Comment):
                out.append(f"<!--{x.data}-->")
            else:
                out.append(x if isinstance(x, Raw) else escape(x, quote=False))
        return "".join(out)


class Raw(str):
    """Text that is written as it stands."""


class Comment:
    __slots__ = ("data",)

    def __init__(self, data: str) -> None:
        self.data = data


class _Builder(HTMLParser):
    def __init__(self, implied: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.implied = implied

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.implied:
            self._close_implied(tag)
        node = Node(tag, {k: v if v is not None else "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_implied(self, tag: str) -> None:
        closes = IMPLIED.get(tag, frozenset()) | (frozenset(["p"]) if tag in _P_CLOSERS else frozenset())
        scope = _SCOPES.get(tag, ())
        n = self.at
        while n is not self.root and n.tag not in scope:
            if n.tag in closes:
                self.at = n.parent
                return
            if tag == "p" and n.tag in _P_CLOSERS and n.tag != "p":
                return
            n = n.parent

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def handle_comment(self, data: str) -> None:
        self.at.children.append(Comment(data))


def parse(html: str, implied: bool = False) -> Node:
    """Tree of a page. implied: p, li, cells and the like close where the standard says so; else only their end tags close them."""
    b = _Builder(implied)
    b.feed(html)
    b.close()
    return b.root


class SelectorError(ValueError):
    pass


_SIMPLE = re.compile(r"""\s*(?:(?P<tag>[A-Za-z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]|:(?P<pseudo>first-child|last-child|nth-child|first-of-type|not)(?:\((?P<arg>[^()]*)\))?)""", re.X)
_OPS = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "*=": lambda have, want: bool(want) and want in have,
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
}


def _compound(text: str) -> Callable[[Node], bool]:
    """Test of one element, as between two combinators."""
    tests: list[Callable[[Node], bool]] = []
    at = 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or m.group(0).strip() == "":
            raise SelectorError(f"cannot read {text[at:]!r}")
        at = m.end()
        if m["tag"]:
            if m["tag"] != "*":
                tests.append(lambda n, t=m["tag"].lower(): n.tag == t)
        elif m["cls"]:
            tests.append(lambda n, c=m["cls"]: c in n.classes())
        elif m["id"]:
            tests.append(lambda n, i=m["id"]: n.get("id") == i)
        elif m["attr"]:
            name, op = m["attr"].lower(), m["op"]
            want = next((x for x in (m["dq"], m["sq"], m["bare"]) if x is not None), None)
            tests.append((lambda n, a=name: a in n.attrs) if op is None else (lambda n, a=name, f=_OPS[op], w=want: a in n.attrs and f(n.attrs[a], w)))
        else:
            kind, arg = m["pseudo"], m["arg"]
            if kind == "first-child":
                tests.append(lambda n: n.index() == 1)
            elif kind == "last-child":
                tests.append(lambda n: [x for x in n.parent.children if isinstance(x, Node)][-1] is n)
            elif kind == "first-of-type":
                tests.append(lambda n: next(x for x in n.parent.children if isinstance(x, Node) and x.tag == n.tag) is n)
            elif kind == "nth-child" and arg and arg.strip().isdigit():
                tests.append(lambda n, i=int(arg): n.index() == i)
            elif kind == "not" and arg:
                tests.append(lambda n, f=_compound(arg.strip()): not f(n))
            else:
                raise SelectorError(f"unsupported :{kind}({arg})")
    if not text.strip():
        raise SelectorError("empty selector")
    return lambda n: all(t(n) for t in tests)


def _split(selector: str) -> list[tuple[str, str]]:
    """[(combinator before, compound)] of one selector without commas."""
    out, depth, word, comb, quote = [], 0, "", " ", ""
    for ch in selector.strip():
        if quote:
            word += ch
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            word, quote = word + ch, ch
        elif ch in "[(":
            word, depth = word + ch, depth + 1
        elif ch in "])":
            word, depth = word + ch, depth - 1
        elif depth == 0 and ch in " >+~\t\n":
            if word:
                out.append((comb, word))
                word, comb = "", " "
            if ch in ">+~":
                comb = ch
        else:
            word += ch
    if depth or quote or not word:
        raise SelectorError(f"cannot read {selector!r}")
    return [*out, (comb, word)]


def _elements_before(n: Node) -> list[Node]:
    kin = [x for x in n.parent.children if isinstance(x, Node)] if n.parent else []
    return kin[: kin.index(n)] if n in kin else []


def select(root: Node, selector: str) -> list[Node]:
    """Elements that match a CSS selector, in document order."""
    groups = []
    for part in re.split(r",(?![^\[(]*[\])])", selector):
        groups.append([(comb, _compound(text)) for comb, text in _split(part)])

    def matches(n: Node, steps: list, i: int) -> bool:
        if not n.tag or not steps[i][1](n):
            return False
        if i == 0:
            return True
        comb = steps[i][0]
        if comb == ">":
            return n.parent is not None and matches(n.parent, steps, i - 1)
        if comb == "+":
            return bool(k := _elements_before(n)) and matches(k[-1], steps, i - 1)
        if comb == "~":
            return any(matches(x, steps, i - 1) for x in _elements_before(n))
        return any(matches(a, steps, i - 1) for a in n.ancestors())

    return [n for n in root.walk() if any(matches(n, g, len(g) - 1) for g in groups)]


_STEP = re.compile(r"(//?)(?:(text\(\))|@([\w:-]+)|(\*|[A-Za-z][\w-]*))((?:\[[^\]]*\])*)")
_PREDICATE = re.compile(r"""^(?:(?P<n>\d+)|@(?P<has>[\w:-]+)|@(?P<eq>[\w:-]+)\s*=\s*(["'])(?P<v>.*?)\4|contains\(\s*(?:@(?P<in>[\w:-]+)|(?P<text>text\(\)|\.))\s*,\s*(["'])(?P<w>.*?)\8\s*\))$""")


def xpath(root: Node, path: str) -> list[Node | str]:
    """Elements or strings of a path of steps /tag, //tag, *, text(), @attribute, with predicates [n], [@a], [@a='v'], [contains(@a, 'v')] and [contains(text(), 'v')], joined by `and`."""
    found: list[Node | str] = [root]
    order = {id(n): i for i, n in enumerate(root.walk())}
    at = 0
    path = path.strip()
    path = path if path.startswith("/") else "//" + path.removeprefix("./")
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise SelectorError(f"cannot read {path[at:]!r}")
        at = m.end()
        deep, text, attr, tag, rest = m.groups()
        following: list[Node | str] = []
        seen: set[int] = set()
        for n in found:
            if not isinstance(n, Node):
                raise SelectorError("a step follows a string")
            if text:
                around = [n, *n.walk()] if deep == "//" else [n]
                following += [c for x in around for c in x.children if isinstance(c, str)]
                continue
            if attr:
                around = [n, *n.walk()] if deep == "//" else [n]
                following += [x.attrs[attr] for x in around if attr in x.attrs]
                continue
            for parent in [n, *n.walk()] if deep == "//" else [n]:
                kin = [c for c in parent.children if isinstance(c, Node) and tag in ("*", c.tag)]
                for predicate in re.findall(r"\[([^\]]*)\]", rest):
                    for clause in re.split(r"\s+and\s+", predicate.strip()):
                        kin = _filtered(kin, clause)
                following += [k for k in kin if not (id(k) in seen or seen.add(id(k)))]
        if not (text or attr):
            following.sort(key=lambda x: order[id(x)])
        found = following
    return found


def _filtered(kin: list[Node], clause: str) -> list[Node]:
    m = _PREDICATE.match(clause)
    if not m:
        raise SelectorError(f"unsupported predicate [{clause}]")
    if m["n"]:
        return kin[int(m["n"]) - 1 : int(m["n"])]
    if m["has"]:
        return [k for k in kin if m["has"] in k.attrs]
    if m["eq"]:
        return [k for k in kin if k.attrs.get(m["eq"]) == m["v"]]
    if m["in"]:
        return [k for k in kin if m["w"] in k.attrs.get(m["in"], "")]
    return [k for k in kin if m["w"] in (k.text() if m["text"] == "." else next((c for c in k.children if isinstance(c, str)), ""))]
