"""A small HTML tree on the standard library's parser, with what main-content extraction and page features need."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Opening one of these ends an open paragraph.
BLOCK = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Opening the key ends an open element of the values, up to the given boundary.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}


class Node:
    """An element; ``begin`` and ``end`` are its places in the source."""

    __slots__ = ("attrs", "begin", "children", "end", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None, begin: int = 0):
        self.tag, self.attrs, self.parent, self.children, self.begin, self.end = tag, attrs or {}, parent, [], begin, begin

    def walk(self) -> Iterator[Node]:
        """This element and all below, in document order."""
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))

    def find(self, *tags: str) -> list[Node]:
        return [x for x in self.walk() if x is not self and x.tag in tags]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def lead(self) -> str:
        """Text before the first child element."""
        return self.children[0] if self.children and isinstance(self.children[0], str) else ""

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def append(self, child: Node) -> None:
        child.drop()
        child.parent = self
        self.children.append(child)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def names(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def html(self) -> str:
        """Markup of this element and all below; the root's own is that of its children."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                out.append(x[0])
            elif isinstance(x, str):
                out.append(escape(x, quote=False))
            elif x.tag == "#root":
                stack.extend(reversed(x.children))
            else:
                out.append(f"<{x.tag}{''.join(f' {k}="{escape(v)}"' for k, v in x.attrs.items())}>")
                if x.tag not in VOID:
                    stack.append((f"</{x.tag}>",))
                    stack.extend(reversed(x.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.source, self.root = source, Node("#root")
        self.at = self.root
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _leave(self, x: Node, place: int) -> None:
        """End all open elements up to ``x``, that one included."""
        while self.at is not x:
            self.at.end = place
            self.at = self.at.parent
        x.end, self.at = place, x.parent

    def _close(self, tags: set[str], stop: set[str]) -> None:
        x = self.at
        while x is not self.root and x.tag not in stop:
            if x.tag in tags:
                self._leave(x, self._place())
                return
            x = x.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._close({"p"}, BLOCK - {"p"} | {"td", "li", "body"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, self._place())
        node.end = node.begin + len(self.get_starttag_text() or "")
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave(self.at, self.at.end)

    def handle_endtag(self, tag):
        x = self.at
        while x is not self.root and x.tag != tag:
            x = x.parent
        if x is not self.root:
            place = self._place()
            self._leave(x, place)
            x.end = self.source.find(">", place) + 1 or len(self.source)

    def handle_data(self, data):
        if self.at.children and isinstance(self.at.children[-1], str):
            self.at.children[-1] += data
        else:
            self.at.children.append(data)

    def finish(self) -> Node:
        self.feed(self.source)
        self.close()
        while self.at is not self.root:
            self._leave(self.at, len(self.source))
        return self.root


def parse(html: str | None) -> Node:
    """The tree of a page; broken markup gives a tree all the same, null an empty one."""
    return _Builder(html or "").finish()


class Flat:
    """A page's elements in document order, number 0 the root: descendants, text and source of an element are slices."""

    def __init__(self, html: str | None):
        self.source = html or ""
        self.nodes: list[Node] = []
        self.up: list[int] = []
        self._last: list[int] = []
        self._text: list[list[int]] = []
        pieces, size, open_, work = [], 0, -1, [parse(html)]
        while work:
            x = work.pop()
            if isinstance(x, str):
                pieces.append(x)
                size += len(x)
            elif x is None:
                self._text[open_][1], self._last[open_] = size, len(self.nodes)
                open_ = self.up[open_]
            else:
                self.up.append(open_)
                open_ = len(self.nodes)
                self.nodes.append(x)
                self._text.append([size, size])
                self._last.append(open_ + 1)
                work.append(None)
                work.extend(reversed(x.children))
        self._all = "".join(pieces)

    def text(self, k: int) -> str:
        return self._all[slice(*self._text[k])]

    def markup(self, k: int) -> str:
        return self.source[self.nodes[k].begin : self.nodes[k].end]

    def tagged(self, *tags: str) -> list[int]:
        return [k for k, x in enumerate(self.nodes) if x.tag in tags]

    def below(self, k: int, some: list[int]) -> list[int]:
        """Those of the ascending numbers ``some`` that lie below element k."""
        return some[bisect_left(some, k + 1) : bisect_left(some, self._last[k])]


def squeeze(text: str) -> str:
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\s*\n\s*", "\n", text)).strip()
