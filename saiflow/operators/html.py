"""Page markup to rows (P1-P3b): a small element tree over the standard HTML parser.

Each extractor is a UDF from a page to an array of structs, so
entities, quoting, extra attributes and nested tags are read as a browser
reads them. A page without the expected block gives an empty array, a null
page too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Element:
    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def walk(self) -> Iterator["Element"]:
        """All elements below, in page order (no recursion: pages may nest deeply)."""
        todo = [iter(self.children)]
        while todo:
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
            elif isinstance(child, Element):
                yield child
                todo.append(iter(child.children))

    def find(self, tag: str, cls: str = "", **attrs: str) -> Iterator["Element"]:
        want = set(cls.split())
        return (e for e in self.walk() if e.tag == tag and want <= e.classes() and all(e.attrs.get(k) == v for k, v in attrs.items()))

    def all(self, tag: str, cls: str = "", **attrs: str) -> list["Element"]:
        return list(self.find(tag, cls, **attrs))

    def first(self, tag: str, cls: str = "", **attrs: str) -> "Element | None":
        """The first one; what comes after it is not looked at."""
        return next(self.find(tag, cls, **attrs), None)

    def text(self) -> str:
        out, todo = [], [iter(self.children)]
        while todo:
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
            elif isinstance(child, Element):
                if child.tag not in ("script", "style"):
                    todo.append(iter(child.children))
            else:
                out.append(child)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "p" and any(e.tag == "p" for e in self.open):  # a paragraph ends where the next one starts
            self.handle_endtag("p")
        e = Element(tag, dict(attrs))
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(page: str | None) -> Element:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def forum_posts(page: str | None) -> list[dict]:
    """Place among the blocks, time text, title (an attribute) and author of each post block; a block
    without a title is skipped."""
    listing, out = parse(page).first("div", id="articlelistnew"), []
    for pos, block in enumerate(listing.all("div", "normal_post") if listing else ()):
        when, head, who = block.first("span", "l5 a5"), block.first("span", "l3 a3"), block.first("span", "l4 a4")
        link, font = head.first("a") if head else None, who.first("font") if who else None
        title = link.attrs.get("title") if link else None
        if title is not None:
            out.append({"pos": pos, "time_text": when.text() if when else None, "title": title, "author": font.text() if font else None})
    return out


def sector_anchors(page: str | None) -> list[dict]:
    """The anchors of the sector block of a list page."""
    block = parse(page).first("div", "cate_inner")
    return [{"href": a.attrs.get("href"), "text": a.text()} for a in (block.all("a") if block else ())]


def table_anchors(page: str | None) -> list[str]:
    """Anchor texts of the table body of a constituent page."""
    box = parse(page).first("div", "body m-pager-box")
    body = box.first("tbody") if box else None
    return [a.text() for a in (body.all("a") if body else ())]


def blank_anchors(page: str | None) -> list[str]:
    """Texts of the anchors that open a new window."""
    return [a.text() for a in parse(page).all("a", target="_blank")]


def text_items(page: str | None) -> list[dict]:
    """Whole texts of the title, headings and paragraphs, nested tags included."""
    return [{"kind": e.tag, "text": e.text()} for e in parse(page).walk() if e.tag in ("title", "h1", "p")]


def column(extract: Callable, ddl: str, html_col: str):
    """``extract`` of a page column as a column of type ``ddl``; a worker holds the trees and results of a few
    pages, not of a whole Arrow batch of them, whose size in bytes nothing bounds."""
    return F.udf(extract, ddl, useArrow=False)(F.col(html_col))
