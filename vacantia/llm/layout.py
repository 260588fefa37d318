"""Layout-aware rendering of HTML to plain text.

A tree is built from the tags, with end tags implied where HTML lets them be left out; invisible parts are dropped; the
visible text comes out as blocks on lines of their own, list items with their marker, table cells in aligned columns.
Text without markup is one text node whose line ends are kept, so plain pages pass through line by line. Every line
knows the line of the source it began on.

Defined results: null gives null; unknown tags ("<role>") are text; unclosed and stray tags never fail; pages of any
length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE = set("a abbr b bdi bdo big button cite code data dfn em font i img input ins kbd label link mark meta output q s samp select option small span strong strike sub sup textarea time u var wbr br title del picture source iframe object canvas svg path video audio center nobr".split())
HIDDEN = set("script style template noscript head title iframe object canvas svg select textarea audio video datalist".split())
#: Elements that hold the navigation and the frame of a page.
FRAME = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
#: An opening tag that ends the open elements of these kinds, up to a border.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"td", "th", "tr"}, {"table"}), "tbody": ({"td", "th", "tr", "tbody", "thead"}, {"table"}), "tfoot": ({"td", "th", "tr", "tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "legend", "summary", "figcaption"}
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?!\.)|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)", re.I)
MARKUP = re.compile(r"<(?:/?[a-zA-Z]|!--|!doctype)|&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]{2,8});", re.I)


#: Deeper elements are laid out as children of the last one that is open; their text is kept.
DEEPEST = 150


class Node:
    __slots__ = ("tag", "children", "hidden", "line", "start")

    def __init__(self, tag: str, line: int, hidden: bool = False, start: int = 1) -> None:
        self.tag, self.children, self.hidden, self.line, self.start = tag, [], hidden, line, start


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", 1)
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        line = self.getpos()[0]
        if tag not in BLOCK and tag not in INLINE and tag not in HIDDEN and tag not in VOID:
            self.handle_data(self.get_starttag_text() or "")
            return
        if tag in ENDS_P:
            self._end({"p"}, {"td", "th", "li", "div", "table", "section", "article"})
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        a = dict(attrs)
        hidden = tag in HIDDEN or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true" or bool(UNSEEN.search(a.get("style") or "")) or tag == "input"
        start = int(a["start"]) if tag == "ol" and (a.get("start") or "").isdigit() else 1
        node = Node(tag, line, hidden, start)
        self.stack[-1].children.append(node)
        if tag not in VOID and len(self.stack) < DEEPEST:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.stack[1:]):
            while self.stack.pop().tag != tag:
                pass
        elif tag not in BLOCK | INLINE | HIDDEN | VOID:
            self.handle_data(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append((data, self.getpos()[0]))

    def _end(self, kinds: set[str], border: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in kinds:
                del self.stack[k:]
            elif self.stack[k].tag in border:
                return


class Writer:
    """Lines as (source line, text); ``flow`` collects the text of the open line. ``frame`` holds for each line whether it
    stands in the frame of the page or is mostly links; ``inside`` and ``links`` are the depths of such elements."""

    def __init__(self) -> None:
        self.lines: list[tuple[int, str]] = []
        self.frame: list[bool] = []
        self.flow, self.at, self.prefix = "", 0, ""
        self.inside = self.links = self.linked = 0

    def put(self, line: int, text: str) -> None:
        self.lines.append((line, text))
        self.frame.append(bool(text) and (self.inside > 0 or 2 * self.linked > len(text)))
        self.linked = 0

    def text(self, data: str, line: int, keep: bool) -> None:
        if keep:
            for k, part in enumerate(data.split("\n")):
                if k:
                    self.close(blank=True)
                if part:
                    self.at = self.at or line + k
                    self.flow += part
                    self.linked += len(part) if self.links else 0
                elif not self.flow:
                    self.at = line + k
            return
        data = re.sub(r"[ \t\r\n\f]+", " ", data)
        if not self.flow:
            data = data.lstrip(" ")
        if data:
            self.at = self.at or line
            self.flow = self.flow + (data[1:] if self.flow.endswith(" ") and data.startswith(" ") else data)
            self.linked += len(data) if self.links else 0

    def close(self, blank: bool = False) -> None:
        text = self.flow if blank else self.flow.strip(" ")
        if text or blank:
            self.put(self.at, self.prefix + text)
            self.prefix = " " * len(self.prefix)
        self.flow, self.at = "", 0

    def gap(self) -> None:
        self.close()
        if self.lines and self.lines[-1][1]:
            self.put(0, "")


def _write(node: Node, w: Writer, depth: int, keep: bool) -> None:
    tag = node.tag
    if node.hidden:
        return
    if tag == "br":
        w.close(blank=not w.flow and bool(w.lines))
        return
    if tag == "hr":
        w.gap()
        return
    if tag == "table":
        _table(node, w)
        return
    number = node.start
    w.inside += tag in FRAME
    w.links += tag == "a"
    spaced = tag in {"p", "ul", "ol", "dl", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"} and depth < 2
    if spaced:
        w.gap()
    elif tag in BLOCK:
        w.close()
    for child in node.children:
        if isinstance(child, tuple):
            w.text(child[0], child[1], keep or tag == "pre")
        elif child.tag == "li" and not child.hidden:
            w.close()
            outer = w.prefix
            w.prefix = "  " * max(0, depth - 1) + (f"{number}. " if tag == "ol" else "- ")
            number += 1
            _write(child, w, depth, keep)
            w.close()
            w.prefix = outer
        else:
            _write(child, w, depth + (child.tag in {"ul", "ol"}), keep or child.tag == "pre")
    if spaced:
        w.gap()
    elif tag in BLOCK:
        w.close()
    w.inside -= tag in FRAME
    w.links -= tag == "a"


def _table(table: Node, w: Writer) -> None:
    w.gap()
    rows: list[tuple[int, list[str]]] = []

    def walk(node: Node) -> None:
        for child in node.children:
            if isinstance(child, tuple) or child.hidden:
                continue
            if child.tag == "tr":
                cells = []
                for cell in child.children:
                    if isinstance(cell, Node) and cell.tag in {"td", "th"} and not cell.hidden:
                        inner = Writer()
                        _write(Node("div", cell.line), inner, 2, False)
                        for x in cell.children:
                            inner.text(x[0], x[1], False) if isinstance(x, tuple) else _write(x, inner, 2, False)
                        inner.close()
                        cells.append(" ".join(t.strip() for _, t in inner.lines if t.strip()))
                if any(cells):
                    rows.append((child.line, cells))
            else:
                walk(child)

    walk(table)
    width = [max((len(r[k]) for _, r in rows if k < len(r)), default=0) for k in range(max((len(r) for _, r in rows), default=0))]
    for line, cells in rows:
        w.put(line, "  ".join(c.ljust(width[k]) for k, c in enumerate(cells)).rstrip())
    w.gap()


def render_blocks(source: str) -> tuple[list[tuple[int, str]], list[bool] | None]:
    """(source line, text) of the visible lines, blank ones included; and for each line of a page with markup whether it
    stands in the frame of the page (navigation, header, footer, sidebar, form) or is mostly links."""
    if not MARKUP.search(source):
        return [(k + 1, line) for k, line in enumerate(source.split("\n"))], None
    builder = Builder()
    builder.feed(source)
    builder.close()
    w = Writer()
    plain = not re.search(r"<(?:p|div|br|li|ul|ol|td|tr|table|h[1-6]|body|html|section|nav|header|footer|main|article|aside)\b", source, re.I)
    _write(builder.root, w, 0, plain)
    w.close()
    while w.lines and not w.lines[-1][1]:
        w.lines.pop()
    return w.lines, w.frame[: len(w.lines)]


def render_lines(source: str) -> list[tuple[int, str]]:
    """(source line, text) of the visible lines, blank ones included."""
    return render_blocks(source)[0]


def render(source: str) -> str:
    return "\n".join(text for _, text in render_lines(source))


@F.pandas_udf(T.StringType())
def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The visible text of each page."""
    for s in batches:
        yield pd.Series([render(t) if isinstance(t, str) else None for t in s], dtype=object)
