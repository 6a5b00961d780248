"""HTML extraction by layout: a tree with implied tags and visibility, rendered to text as a reader would see it.

Each page is read by one row of a pandas UDF; pages need nothing from one another, so there is no shuffle.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import plain

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript noframes iframe object svg math canvas audio video datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset details".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form li dt dd tr caption figcaption legend "
                           "summary center menu dir thead tbody tfoot option".split())
ENDS_P = BLOCK - frozenset("html body tr caption thead tbody tfoot option".split())
#: A start tag closes open elements of these kinds, up to the given boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
IN_HEAD = frozenset("title meta link base script style template noscript head html".split())
_NO_BOX = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_NUMBER = re.compile(r"-?[0-9]{1,9}\Z")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_DEEP_TABLES = 12  # tables nested deeper are laid out as blocks: their text stays


class Node:
    """An element; ``shown`` is its inherited visibility, which its style may set anew and which its own text has."""

    __slots__ = ("tag", "attrs", "children", "shown")

    def __init__(self, tag: str, attrs: dict, parent: Node | None = None):
        self.tag, self.attrs, self.children = tag, attrs, []
        own = _VISIBILITY.findall(attrs.get("style") or "")
        self.shown = own[-1].lower() == "visible" if own else parent is None or parent.shown


def seen(node: Node) -> bool:
    """Does the element have a box?  A hidden one has, as its children may be visible."""
    a = node.attrs
    return not (node.tag in UNSEEN or "hidden" in a or _NO_BOX.search(a.get("style") or "")
                or (node.tag == "dialog" and "open" not in a) or (node.tag == "input"))


def _number(value: str | None, missing: int) -> int:
    return int(value) if _NUMBER.match(value or "") else missing


class TreeBuilder(HTMLParser):
    """Builds the tree; closes what a start tag implies, ignores end tags that close nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def _close(self, kinds: set, bounds: set) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in bounds:
                return
            if tag in kinds:
                del self.open[i:]
                if kinds == {"p"}:
                    return
                self._close(kinds, bounds)
                return

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag not in IN_HEAD and any(n.tag == "head" for n in self.open[1:3]):
            self._close({"head"}, set())
        if tag in ENDS_P:
            self._close({"p"}, {"td", "th", "caption", "button", "object"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and any(n.tag in ("svg", "math") for n in self.open):  # only foreign elements close themselves
            self.open.pop()

    def parse_html_declaration(self, i):
        """Declarations that are none, such as ``<![>``, are comments up to the next ``>``."""
        if self.rawdata[i: i + 4] == "<!--" or self.rawdata[i: i + 9].lower() == "<!doctype":
            return super().parse_html_declaration(i)
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else -1

    def unknown_decl(self, data):
        pass

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        bounds = set() if tag in ("table", "head") else {"table"} if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else {"td", "th", "table"}
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in bounds:
                return

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._close({"head"}, set())
        if self.open[-1].shown:
            self.open[-1].children.append(data)


class Flow:
    """Lines of text: blanks collapsed, one line per block, an empty line around spaced blocks, list marks, indents."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space, self.gap, self.pre = False, 0, 0
        self.indent: list[str] = []
        self.mark = ""

    def text(self, s: str) -> None:
        if self.pre:
            head, *rest = s.replace("\r\n", "\n").split("\n")
            self.now.append(head)
            for line in rest:
                self.end(keep=True)
                self.now.append(line)
            return
        parts = _BLANK.split(s)
        if parts[0] == "" and len(parts) > 1:
            self.space = True
            parts = parts[1:]
        for k, p in enumerate(parts):
            if p:
                if self.space and self.now:
                    self.now.append(" ")
                self.now.append(p)
                self.space = False
            if k < len(parts) - 1:
                self.space = True

    def end(self, keep: bool = False) -> None:
        line = "".join(self.now)
        self.now, self.space = [], False
        if not line.strip() and not (keep and self.lines):
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        pad = "".join(self.indent)
        if self.mark:
            pad, self.mark = pad[: len(pad) - len(self.mark)] + self.mark, ""
        self.lines.append((pad + line).rstrip() if not self.pre else pad + line)

    def block(self, spaced: bool) -> None:
        self.end()
        if spaced:
            self.gap = 1

    def result(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return self.lines


def _table(node: Node, flow: Flow, depth: int) -> None:
    rows, captions, todo = [], [], [(x, None) for x in reversed(node.children)]
    row = None
    while todo:
        x, row_of = todo.pop()
        if isinstance(x, str):
            if x.strip():
                rows.append([(x, 1)])  # text outside of cells
            continue
        if not seen(x):
            continue
        if x.tag == "caption":
            captions.append(x)
        elif x.tag in ("td", "th"):
            if row_of is None:
                row_of = row = row if row is not None and rows and rows[-1] is row else rows.append([]) or rows[-1]
            row_of.append((x, max(1, min(100, _number(x.attrs.get("colspan"), 1)))))
        elif x.tag == "tr":
            rows.append([])
            todo += [(y, rows[-1]) for y in reversed(x.children)]
        elif x.tag in ("thead", "tbody", "tfoot"):
            todo += [(y, None) for y in reversed(x.children)]
        else:
            rows.append([(x, 1)])
    for x in captions:
        for line in render([x], depth + 1):
            flow.now.append(line)
            flow.end()
    laid = [[(render([x], depth + 1), span) for x, span in r] for r in rows]
    laid = [r for r in laid if any(lines for lines, _ in r)]
    width: list[int] = []
    for r in laid:
        at = 0
        for lines, span in r:
            width += [0] * (at + span - len(width))
            if span == 1:
                width[at] = max([width[at], *map(len, lines)])
            at += span
    for r in laid:
        for k in range(max(len(lines) for lines, _ in r)):
            out, at = "", 0
            for lines, span in r:
                out += (lines[k] if k < len(lines) else "").ljust(sum(width[at: at + span]) + 2 * (span - 1)) + "  "
                at += span
            flow.now.append(out.rstrip())
            flow.end(keep=True)


def render(nodes: list, depth: int = 0) -> list[str]:
    """Lines of the given nodes; walks with a stack of its own, so depth of nesting does not matter."""
    flow, todo, counters = Flow(), [("in", x) for x in reversed(nodes)], []
    while todo:
        what, x = todo.pop()
        if what == "out":
            tag = x.tag
            if tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
            if tag == "li":
                flow.end()
                flow.mark = ""
                flow.indent.pop()
            elif tag in ("blockquote", "dd"):
                flow.end()
                flow.indent.pop()
            elif tag == "pre":
                flow.end()
                flow.pre -= 1
            if tag in BLOCK:
                flow.block(tag in SPACED and not (tag in ("ul", "ol") and counters))
            continue
        if isinstance(x, str):
            flow.text(x)
            continue
        if not seen(x):
            continue
        tag = x.tag
        if tag == "br":
            flow.end(keep=True)
        elif tag == "hr":
            flow.block(True)
            if x.shown:
                flow.now.append("---")
            flow.block(True)
        elif tag == "table" and depth < _DEEP_TABLES:
            flow.block(True)
            _table(x, flow, depth)
            flow.block(True)
        else:
            if tag in BLOCK:
                flow.block(tag in SPACED and not (tag in ("ul", "ol") and counters))
            elif tag in ("td", "th"):
                flow.space = True
            if tag in ("ul", "menu", "dir"):
                counters.append(None)
            elif tag == "ol":
                counters.append(_number(x.attrs.get("start"), 1))
            elif tag == "li":
                mark = "- "
                if counters and counters[-1] is not None:
                    mark = f"{counters[-1]}. "
                    counters[-1] += 1
                flow.mark = mark
                flow.indent.append(" " * len(mark))
            elif tag in ("blockquote", "dd"):
                flow.indent.append("  ")
            elif tag == "pre":
                flow.pre += 1
            todo.append(("out", x))
            todo += [("in", y) for y in reversed(x.children)]
    return flow.result()


def page_text(html: str) -> str:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return "\n".join(render([builder.root]))


def _page_texts(pages: pd.Series) -> pd.Series:
    return pages.map(page_text)


def rendered(html: Column | str = "html") -> Column:
    """Visible text of a page. Null and empty pages have the empty text; markup that is no HTML is text."""
    return F.pandas_udf(_page_texts, "string")(plain(html))


def extract_pages(pages: DataFrame, *, html: str = "html", into: str = "page_text") -> DataFrame:
    """``pages`` with the visible text in ``into``: row by row, repeated rows too; other columns pass through."""
    return pages.withColumn(into, rendered(html))
