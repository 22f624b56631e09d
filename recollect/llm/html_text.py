"""Text of web pages, laid out as a browser would show it.

A tree is built with the tags that HTML implies, elements that are not shown
are left out, and the rest is rendered: blocks on lines of their own, a blank
line around paragraphs, markers before list items, table cells in columns.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})")
BLANK = re.compile(r"[ \t\r\n\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas meta link".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre xmp blockquote figure hr form fieldset".split())
BLOCKS = PARAGRAPHS | frozenset("html body div article section nav aside header footer main address li dt dd tr caption figcaption details summary legend option center dir menu hgroup search".split())
#: An opening tag ends open elements of these kinds, up to the nearest of the limits.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
#: Tags that may stand in the head; any other, and text, ends it.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title html".split())
#: Elements of drawings and formulas whose text is not shown; there ``/>`` ends an element.
FOREIGN = frozenset(("svg", "math"))
FOREIGN_UNSEEN = frozenset("defs desc metadata symbol clippath mask pattern marker annotation annotation-xml".split())
SCOPE = frozenset("table td th caption html body".split())
#: Characters up to which a column is padded and up to which the columns of a row are aligned together, list levels that are indented, and tables in tables that are aligned: bounds of the blanks in a text, not of its words.
COLUMN, ROW, LEVELS, DEEP = 80, 240, 20, 8


def number(value: str, least: int, most: int, default: int) -> int:
    """An attribute's leading integer, within bounds; ASCII digits only, and at most nine of them."""
    found = NUMBER.match(value)
    return max(least, min(int(found[1]), most)) if found else default


class Node:
    __slots__ = ("children", "attributes", "tag", "rows")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.rows = False  # has rows of the table around it

    def shown(self) -> bool:
        a = self.attributes
        return self.tag not in UNSEEN and "hidden" not in a and not HIDING.search(a.get("style", "")) and not (self.tag == "dialog" and "open" not in a)

    def dark(self, inherited: bool) -> bool:
        """Whether text in it is unseen; unlike ``display``, a child may turn visible again."""
        found = VISIBILITY.search(self.attributes.get("style", ""))
        return found[1].lower() != "visible" if found else inherited


def build(html: str) -> Node:
    """The tree of a page, with implied end tags and rows; unmatched end tags are passed over."""
    root = Node("html", {})
    stack, at = [root], 0
    head = foreign = 0  # places in the stack, 0 for none
    opened: dict[str, list[int]] = defaultdict(list)  # places of each tag in the stack, so that none is walked for

    def push(node: Node) -> None:
        opened[node.tag].append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag].pop()
        del stack[i:]

    def nearest(tags: frozenset | set) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close(kinds: set, limits: frozenset | set) -> None:
        i = nearest(kinds)
        if i and i >= nearest(limits):
            cut(i)

    def add(node: Node) -> None:
        if node.tag == "tr":
            for n in reversed(stack):
                if n.rows or n.tag in SCOPE:
                    break
                n.rows = True
        stack[-1].children.append(node)

    def text(piece: str) -> None:
        if stack[-1].tag == "head" and piece.strip():
            cut(len(stack) - 1)
        stack[-1].children.append(piece)

    while match := MARKUP.search(html, at):
        if match.start() > at:
            text(html[at : match.start()])
        at = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag == "p" and not opened.get("p"):
                stack[-1].children.append(Node("p", {}))
            close({tag}, set() if tag == "table" else {"table"} if tag in BLOCKS else SCOPE - {tag})
            continue
        if tag == "html":
            continue
        if head and (len(stack) <= head or stack[head].tag != "head"):
            head = 0
        if head and tag not in HEAD:
            close({"head"}, {"template", "noscript"})
        if len(stack) <= foreign:
            foreign = 0
        kinds, limits = IMPLIED.get(tag, (None, None))
        if kinds:
            close(kinds, limits)
        if tag in ("tr", "tbody", "thead", "tfoot"):
            close({"td", "th"}, {"table"})
            close({"tr"}, {"table"})
        if tag in BLOCKS:
            close({"p"}, SCOPE)
        if tag in ("td", "th") and stack[-1].tag != "tr" and opened.get("table"):
            row = Node("tr", {})
            add(row)
            push(row)
        node = Node(tag, {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(match[3])} if match[3] else {})
        if foreign and tag in FOREIGN_UNSEEN:
            node.attributes["hidden"] = ""
        add(node)
        if (foreign or tag in FOREIGN) and match[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
            if tag not in UNSEEN:
                inner = html[at : end.start() if end else len(html)]
                node.children.append(inner if tag == "textarea" else inner.replace("&", "&amp;"))
            at = end.start() if end else len(html)
            if end:
                at = html.find(">", end.start()) + 1 or len(html)
        elif tag not in VOID:
            if tag == "head":
                head = len(stack)
            elif tag in FOREIGN:
                foreign = foreign or len(stack)
            push(node)
    if at < len(html):
        text(html[at:])
    return root


class Page:
    """Lines of rendered text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.open, self.gap, self.lead = "", 0, ""

    def end_line(self, gap: int = 0) -> None:
        if self.open.strip(" "):
            if self.lines and self.gap:
                self.lines.append("")
            self.lines.append(self.open.rstrip(" "))
            self.gap = 0
        self.open = ""
        self.gap = max(self.gap, gap)

    def put(self, text: str, kept: bool = False) -> None:
        text = unescape(text) if "&" in text else text
        if kept:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self.start(first)
            for line in more:
                self.end_line()
                self.start(line)
            return
        text = BLANK.sub(" ", text)
        if text[:1] == " " and (not self.open or self.open[-1] == " "):
            text = text[1:]
        if text:
            self.start(text)

    def start(self, text: str) -> None:
        if not self.open and text:
            self.open, self.lead = self.lead, re.sub(r"\S", " ", self.lead)
        self.open += text

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def render(node: Node, page: Page) -> None:
    """Depth first, without recursion: a page, and tables in tables, may nest without bound."""
    running, lines = [flow(node, page)], None
    while running:
        try:
            inner = running[-1].send(lines)
        except StopIteration as done:
            running.pop()
            lines = done.value
        else:
            running.append(inner)
            lines = None


def flow(node: Node, page: Page, dark: bool = False, depth: int = 0) -> Generator:
    """Renders a node; yields the parts that have pages of their own to ``render``, which runs them first."""
    todo: list = [("open", node, False, dark)]
    marks: list[tuple[str, int]] = []
    while todo:
        what, node, kept, dark = todo.pop()
        if what == "text":
            if not dark:
                page.put(node, kept)
        elif what == "table":
            page.end_line(1)
            if lines := (yield table(node, depth)):
                page.lines += ([""] if page.lines and page.gap else []) + lines
                page.gap = 1
        elif what == "close":
            page.end_line(1 if node.tag in PARAGRAPHS and not (node.tag in ("ul", "ol") and len(marks) > 1) else 0)
            if node.tag in ("ul", "ol", "menu", "dir"):
                marks.pop()
            elif node.tag == "li":
                page.lead = page.lead[: 2 * min(max(len(marks) - 1, 0), LEVELS)]
        elif node.tag == "br":
            page.end_line(0 if page.open.strip(" ") else 1)
        elif node.shown():
            tag, dark = node.tag, node.dark(dark)
            if tag == "table":
                before, rows = parts_of(node, dark)
                todo.append(("table", rows, kept, dark))
                for child, unseen in reversed(before):
                    todo.append(("text" if isinstance(child, str) else "open", child, kept, unseen))
                continue
            if tag in BLOCKS:
                page.end_line(1 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and marks) else 0)
                todo.append(("close", node, kept, dark))
                if tag in ("ul", "ol", "menu", "dir"):
                    marks.append((tag, number(node.attributes.get("start", "1"), -999_999_999, 999_999_999, 1) - 1))
                elif tag == "li":
                    kind, n = marks.pop() if marks else ("ul", 0)
                    marks.append((kind, n + 1))
                    page.lead = "  " * min(len(marks) - 1, LEVELS) + (f"{n + 1}. " if kind == "ol" else "- ")
            inside = kept or tag in ("pre", "xmp", "textarea")
            children = [c for c in node.children if isinstance(c, str) or c.tag == "summary"] if tag == "details" and "open" not in node.attributes else node.children
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if not isinstance(c, str)]
            for child in reversed(children):
                todo.append(("text" if isinstance(child, str) else "open", child, inside, dark))


def parts_of(node: Node, dark: bool) -> tuple[list, list]:
    """What stands in a table outside its cells, which is shown before it, and its captions and rows (lists of cells); each with whether it is unseen."""
    before, rows = [], []
    todo = [(child, None, dark) for child in reversed(node.children)]
    while todo:
        child, cells, dark = todo.pop()
        if isinstance(child, str):
            if child.strip(" \t\r\n\f"):
                before.append((child, dark))
            continue
        if not child.shown():
            continue
        unseen = child.dark(dark)
        if child.tag == "caption":
            rows.append((child, dark))
        elif child.tag in ("td", "th") and cells is not None:
            cells.append((child, unseen))
        elif child.tag == "tr" or child.rows or child.tag in ("thead", "tbody", "tfoot", "colgroup"):
            if child.tag == "tr" and cells is None:
                cells = []
                rows.append(cells)
            for c in reversed(child.children):
                if isinstance(c, str) and child.rows and child.tag in BLOCKS:
                    line = Node("div", {})
                    line.children.append(c)
                    c = line if c.strip() else c
                todo.append((c, cells, unseen))
        else:
            before.append((child, dark))
    return before, rows


def table(rows: list, depth: int) -> Generator:
    """Lines of a table: columns as wide as their widest cells, the last that a cell spans wide enough for it; cells that span rows keep their columns free below.

    Text is never cut or wrapped: a cell wider than COLUMN pushes the cells after
    it in its own row, and where columns would begin beyond ROW, or in tables
    deeper than DEEP in others, two blanks stand between cells.
    """
    head, grid, widths, begins, wide = [], [], [], set(), []
    taken: dict[int, int] = {}  # rows for which a column is taken by a cell above
    for row in rows:
        if isinstance(row, tuple):
            page = Page()
            yield flow(row[0], page, row[1], depth + 1)
            head += page.text().split("\n")
            continue
        cells, at = [], 0
        below: dict[int, int] = {}
        for cell, dark in row:
            page = Page()
            for child in cell.children:
                if not isinstance(child, str):
                    yield flow(child, page, dark, depth + 1)
                elif not dark:
                    page.put(child)
            lines = page.text().split("\n")
            span = number(cell.attributes.get("colspan", "1"), 1, 1000, 1)
            down = number(cell.attributes.get("rowspan", "1"), 0, 65_534, 1) or 65_534
            while taken.get(at, 0):
                at += 1
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max(widths[at], *map(len, lines))
            else:
                wide.append((at, span, max(map(len, lines))))
            cells.append((at, lines))
            begins.add(at)
            if down > 1:
                below.update(dict.fromkeys(range(at, at + span), down))
            at += span
        taken = {c: n - 1 for c, n in (taken | below).items() if n > 1}
        if cells:
            grid.append(cells)
    for at, span, width in wide:
        room = sum(widths[at : at + span]) + 2 * sum(c in begins for c in range(at + 1, at + span))
        widths[at + span - 1] += max(0, width - room)
    places, place = [], 0
    for c, width in enumerate(widths):
        places.append(place if place <= ROW and depth <= DEEP else 0)
        place += min(width, COLUMN) + 2 * (c + 1 in begins)
    out = []
    for cells in grid:
        for i in range(max(len(lines) for _, lines in cells)):
            line = ""
            for at, lines in cells:
                line = line + "  " if line and len(line) + 2 > places[at] else line.ljust(places[at])
                line += lines[i] if i < len(lines) else ""
            out.append(line.rstrip())
    return [x for x in head if x] + out


def visible_text(html: str | None) -> str:
    page = Page()
    if html:
        render(build(html), page)
    return page.text()


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``, the visible text, in place of the html.

    Blanks that align cells and indent lists are bounded (COLUMN, ROW, LEVELS,
    DEEP), so a text is at most a small multiple of its page; words are never
    cut.  Null and empty pages give an empty text; broken markup is read as far as it
    goes; every row is read on its own, so repeated rows and empty tables need
    nothing special.  A column named as ``out_col`` is replaced.
    """
    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    schema = pages.select(*kept).withColumn(out_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(x) for x in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out_col])

    return pages.select(*kept, html_col).mapInArrow(run, schema)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
