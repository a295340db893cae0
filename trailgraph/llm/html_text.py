"""Visible text of HTML pages, laid out by blocks, lists and tables.

A page is cut into tags and text, a tree is built from them with the tags that
HTML implies, and the visible part of the tree is written out: blocks apart,
list items with their marks, table cells in columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

from trailgraph.llm.common import add_struct, free_name

# Fixed values of HTML: elements by how they are built and shown.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set(
    "head script style template title noscript iframe noembed noframes object audio video canvas "
    "datalist desc defs metadata annotation annotation-xml".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCKS = SPACED | set(
    "address article aside body center details dd dialog div dt figcaption footer form header hgroup hr "
    "html legend li main menu nav option search section summary caption textarea tr thead tbody tfoot".split()
)
CLOSES_P = (BLOCKS - set("body html caption tr thead tbody tfoot legend".split())) | {"hr"}
#: An opened element ends open ones of these kinds, up to the nearest of the others.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
GROUPS = {"thead", "tbody", "tfoot"}
#: Parts of a table, and the open elements that hold them directly.
PARTS = {
    "td": {"table", "tr"} | GROUPS, "th": {"table", "tr"} | GROUPS, "tr": {"table"} | GROUPS,
    "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "caption": {"table"}, "colgroup": {"table"},
}
#: Open elements beyond which deeper ones, except parts of an open table, are put side by side.
DEEPEST = 150
#: Columns that a column of a table takes for alignment, and blanks before a cell, at
#: most; so what a page gives is in proportion to it.
MOST_WIDTH = 40
MOST_BLANKS = 40
#: Columns and rows that a cell spans at most, as in browsers.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NOT_STYLE = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*\"|'[^']*'", re.S)
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")
_BLANKS = re.compile(r"[ \t\r\n\f]+")


@dataclass
class Node:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)


def attribute_values(attributes: str) -> dict[str, str]:
    """Values by lower-case name; of repeated names the first counts."""
    found: dict[str, str] = {}
    for match in _ATTRIBUTE.finditer(attributes):
        found.setdefault(match.group(1).lower(), unescape(match.group(2) or match.group(3) or match.group(4) or ""))
    return found


def number_in(node: Node, name: str, otherwise: int) -> int:
    """The whole number that an attribute starts with."""
    if name not in node.attributes.lower():
        return otherwise
    found = _NUMBER.match(attribute_values(node.attributes).get(name, ""))
    return int(found.group(1)) if found else otherwise


def style_of(node: Node) -> dict[str, str]:
    """The declarations of the style of an element; the last counts, important ones before others."""
    found: dict[str, tuple[bool, str]] = {}
    style = attribute_values(node.attributes).get("style", "")
    for part in _NOT_STYLE.sub(" ", style).lower().split(";"):
        name, _, value = part.partition(":")
        value, mark, _ = value.partition("!")
        if bool(mark) >= found.get(name.strip(), (False, ""))[0]:
            found[name.strip()] = bool(mark), value.strip()
    return {name: value for name, (_, value) in found.items()}


def invisible(node: Node) -> bool:
    """Whether the element is not rendered, with all inside: by an attribute or
    its style, or as a dialog that is not open."""
    if node.tag == "dialog" and "open" not in attribute_values(node.attributes):
        return True
    if not node.attributes or not _MAY_HIDE.search(node.attributes):
        return False
    return "hidden" in attribute_values(node.attributes) or style_of(node).get("display") == "none"


def visibility(node: Node, seen: bool) -> bool:
    """Whether text in the element is seen, if what is around it is ``seen`` or not."""
    if not node.attributes or not _MAY_HIDE.search(node.attributes):
        return seen
    own = style_of(node).get("visibility")
    return own == "visible" if own in ("visible", "hidden", "collapse") else seen


def width_of(text: str) -> int:
    """Columns that a text takes: two for a wide character, none for a mark upon another."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


def build(html: str) -> Node:
    """The tree of a page; text is held as strings, entities resolved."""
    root = Node("#root")
    open_ = [root]
    at = 0

    def text(upto: int) -> None:
        if upto > at:
            open_[-1].children.append(unescape(html[at:upto]))

    def close(kinds: set[str], limits: set[str]) -> None:
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth].tag in limits:
                return
            if open_[depth].tag in kinds:
                last = depth
                while last > 1 and open_[last - 1].tag in kinds:
                    last -= 1
                del open_[last:]
                return

    def clear(holders: set[str]) -> None:
        """End what stands between an open table and a new part of it."""
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth].tag in holders:
                del open_[depth + 1 :]
                return
            if open_[depth].tag in HIDDEN or open_[depth].tag in ("td", "th"):
                return

    while found := _MARKUP.search(html, at):
        text(found.start())
        at = found.end()
        slash, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            continue
        tag = name.lower()
        if slash:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth].tag == tag:
                    del open_[depth:]
                    break
                if open_[depth].tag in ("td", "th", "table") and tag not in IMPLIED and tag != "table":
                    break  # an end tag inside a cell ends nothing outside it
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button"})
        if tag in PARTS:
            clear(PARTS[tag])
        if tag in ("td", "th") and open_[-1].tag in ("table", "thead", "tbody", "tfoot"):
            open_[-1].children.append(row := Node("tr"))
            open_.append(row)
        holder = open_[-1].tag
        open_[-1].children.append(node := Node(tag, attributes))
        if tag == "form" and holder in PARTS["td"]:
            continue  # among the parts of a table a form holds nothing
        part = tag in PARTS and holder in PARTS[tag]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            node.children.append(unescape(html[at : end.start()]))
            at = end.end()
        elif tag not in VOID and not attributes.endswith("/") and (part or len(open_) < DEEPEST):
            open_.append(node)
    text(len(html))
    return root


class Page:
    """Lines of laid-out text, with at most one empty line in between."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0

    def write(self, text: str) -> None:
        if not self.line:
            text = text.lstrip(" ")
            if not text:
                return
            if self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
        elif self.line.endswith(" "):
            text = text.lstrip(" ")
        self.line += text

    def end(self, gap: int = 1) -> None:
        """End the line; ``gap`` 2 leaves an empty line before what follows."""
        if self.line.strip():
            self.lines.append(self.line.rstrip())
            self.line = ""
        self.line = ""
        self.gap = max(self.gap, gap)

    def whole(self, lines: list[str]) -> None:
        """Lines that are written as they are."""
        if lines:
            if self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.lines.extend(lines)
            self.gap = 1

    def result(self) -> list[str]:
        self.end()
        return self.lines


def laid_out(nodes: list, pre: bool = False, seen: bool = True) -> list[str]:
    page = Page()
    _show(nodes, page, pre, seen)
    return page.result()


def _show(nodes: list, page: Page, pre: bool, seen: bool) -> None:
    for node in nodes:
        if isinstance(node, str):
            if not seen:
                continue
            if pre:
                first, *more = node.split("\n")
                page.line += first
                for line in more:
                    page.lines.append(page.line.rstrip())
                    page.line = line
            else:
                page.write(_BLANKS.sub(" ", node))
            continue
        tag = node.tag
        if tag in HIDDEN or invisible(node):
            continue
        inner = visibility(node, seen)
        if tag == "br":
            page.end()
        elif tag in ("ul", "ol", "menu"):
            page.end(2)
            page.whole(_list(node, inner))
            page.end(2)
        elif tag == "table":
            page.end(2)
            page.whole(_table(node, inner))
            page.end(2)
        elif tag in ("pre", "textarea"):
            page.end(2)
            lines = laid_out(node.children, True, inner)
            page.whole(lines[1:] if lines and not lines[0] else lines)
            page.end(2)
        elif tag in ("blockquote", "dd"):
            page.end(2 if tag == "blockquote" else 1)
            page.whole(["  " + line if line else "" for line in laid_out(node.children, seen=inner)])
            page.end(2 if tag == "blockquote" else 1)
        elif tag in ("td", "th"):  # outside a table
            page.write(" ")
            _show(node.children, page, pre, inner)
            page.write(" ")
        elif tag in BLOCKS:
            gap = 2 if tag in SPACED else 1
            page.end(gap)
            _show(_unfolded(node), page, pre, inner)
            page.end(gap)
        else:
            _show(node.children, page, pre, inner)


def _unfolded(node: Node) -> list:
    """What is shown of a block: closed details show their first summary alone."""
    if node.tag != "details" or "open" in attribute_values(node.attributes):
        return node.children
    return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]


def _list(node: Node, seen: bool) -> list[str]:
    """Items behind their marks, further lines indented; nested lists stay tight."""
    number = number_in(node, "start", 1)
    out: list[str] = []
    for child in node.children:
        if isinstance(child, str) and not child.strip():
            continue
        lines = [line for line in laid_out([child], seen=seen) if line]
        if not lines:
            continue
        if isinstance(child, Node) and child.tag == "li":
            number = number_in(child, "value", number)
        mark = "- "
        if isinstance(child, Node) and child.tag in ("ul", "ol", "menu"):
            mark = "  "
        elif node.tag == "ol":
            mark, number = f"{number}. ", number + 1
        out.append(mark + lines[0])
        out.extend(" " * len(mark) + line for line in lines[1:])
    return out


def _parts(node: Node, seen: bool, rows: list[tuple[list[Node], bool]], stray: list) -> None:
    """Cells by rows, with whether they are seen, and everything else, which is shown before the table."""
    for child in node.children:
        if isinstance(child, str) or child.tag != "tr" and child.tag not in GROUPS:
            stray.append(child)
        elif invisible(child):
            continue
        elif child.tag in GROUPS:
            _parts(child, visibility(child, seen), rows, stray)
        else:
            cells = []
            for cell in child.children:
                (cells if isinstance(cell, Node) and cell.tag in ("td", "th") else stray).append(cell)
            rows.append((cells, visibility(child, seen)))


def _table(node: Node, seen: bool) -> list[str]:
    """Cells in columns; one over several columns or rows keeps the others in theirs.

    What stands in the table outside of cells goes before it, as in browsers.  A
    column is at most ``MOST_WIDTH`` wide: longer cells run over, and what follows
    them on the line moves on.
    """
    rows: list[tuple[list[Node], bool]] = []
    stray: list = []
    _parts(node, seen, rows, stray)
    out = laid_out(stray, seen=seen)
    grid: list[list[tuple[int, list[str]]]] = []
    widths: dict[int, int] = {}
    taken: dict[int, int] = {}  # rows that a cell from above still takes of a column
    for row, row_seen in rows:
        column, cells, begun = 0, [], {}
        for cell in row:
            if invisible(cell):
                continue
            while taken.get(column, 0):
                column += 1
            across = min(max(1, number_in(cell, "colspan", 1)), MOST_COLUMNS)
            down = min(number_in(cell, "rowspan", 1), MOST_ROWS)
            lines = [line for line in laid_out(cell.children, seen=visibility(cell, row_seen)) if line]
            if lines:
                cells.append((column, lines))
            if across == 1:
                wide = max([0, *map(width_of, lines)])
                widths[column] = max(widths.get(column, 0), min(wide, MOST_WIDTH))
            if down != 1:
                begun.update(dict.fromkeys(range(column, column + across), MOST_ROWS if down < 1 else down))
            column += across
        taken = {c: left - 1 for c, left in {**taken, **begun}.items() if left > 1}
        grid.append(cells)
    ordered = sorted(widths)
    before = dict(zip(ordered, accumulate([widths[c] + 2 for c in ordered], initial=0)))
    for cells in grid:
        placed = [(before[ordered[at]] if (at := bisect_left(ordered, column)) < len(ordered) else 0, lines)
                  for column, lines in cells]
        for height in range(max([0, *(len(lines) for _, lines in placed)])):
            line, end = "", 0
            for place, lines in placed:
                if height < len(lines):
                    blanks = min(max(place - end, 2 if line else 0), MOST_BLANKS)
                    line += " " * blanks + lines[height]
                    end += blanks + width_of(lines[height])
            out.append(line.rstrip())
    return [line for line in out if line]


def visible_text(html: str | None) -> str:
    """All visible text of a page; a null or empty page has none."""
    return "\n".join(laid_out(build(html or "").children)).strip("\n")


def extract_text(pages: DataFrame, *, html="html") -> tuple[DataFrame, str]:
    """``pages`` with a struct column holding ``text``, and its name.

    One row per row, repeated ones too; null and empty pages have an empty text.
    """
    name = free_name(pages.columns, "visible")

    def make():
        def compute(texts: pa.Array) -> pa.Array:
            return pa.array([{"text": visible_text(t)} for t in texts.to_pylist()], pa.struct({"text": pa.string()}))

        return compute

    return add_struct(pages, html, name, "text string", make), name
