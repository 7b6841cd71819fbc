"""A small document tree on the standard library's HTML tokenizer.

Just what record extraction needs: tags, classes, own text, ancestors. An end
tag without a start is ignored; a new p, li or heading ends an open p.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = frozenset("p div ul ol li table h1 h2 h3 h4 h5 h6 blockquote section article header footer nav aside pre form".split())


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Element]:
        todo = list(reversed(self.children))
        while todo:
            e = todo.pop()
            if isinstance(e, Element):
                yield e
                todo += reversed(e.children)

    def text(self) -> str:
        parts, todo = [], list(reversed(self.children))
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                parts.append(e)
            else:
                todo += reversed(e.children)
        return " ".join(" ".join(parts).split())

    def inside(self, tags: tuple[str, ...], stop: Element | None = None) -> bool:
        e = self.parent
        while e is not None and e is not stop:
            if e.tag in tags:
                return True
            e = e.parent
        return False

    def first(self, *, tag: str | None = None, cls: str | None = None) -> Element | None:
        return next((e for e in self.walk() if (tag is None or e.tag == tag) and (cls is None or cls in e.classes)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P and self.at.tag == "p":
            self.at = self.at.parent
        if tag == "li" and self.at.tag == "li":
            self.at = self.at.parent
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_endtag(self, tag):
        e = self.at
        while e is not self.root and e.tag != tag:
            e = e.parent
        if e is not self.root:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
