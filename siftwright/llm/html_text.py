"""Visible text of HTML pages as a layout-aware renderer shows it.

A tree builder supplies the tags that HTML lets authors leave out, visibility rules drop what
no reader sees, and a renderer writes the rest: paragraphs apart by an empty line, other blocks
by a line break, list items with markers and indentation, table cells in aligned columns,
preformatted text as it is. Nothing visible is judged or left out (menus, footers and
advertisements stay).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship

# Names of elements by role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HIDDEN = frozenset("head script style template title noembed noframes iframe datalist audio video canvas object svg math".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu pre blockquote table figure fieldset form hr article section details".split())
LINE = frozenset("html body div li dt dd tr td th address aside center figcaption footer header hgroup legend main nav search summary caption optgroup option thead tbody tfoot dialog".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# start tag: (open elements it closes, elements that bound the search)
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
}
CELL_BOUND = frozenset(["table", "td", "th", "caption", "button", "object", "template"])
MAX_TABLE_DEPTH = 20
MAX_SPAN = 1000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?/][^>]*>?|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = " \t\n\f\r"
_RUN = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attr(self, name: str) -> str | None:
        """Value of an attribute, "" if it has none, None if absent; the first of its name counts."""
        if name not in self.attrs.lower():
            return None
        for key, value in _ATTR.findall(self.attrs):
            if key.lower() == name:
                return html.unescape(value[1:-1] if value[:1] in "\"'" and value else value)
        return None

    def number(self, name: str, default: int) -> int:
        value = (self.attr(name) or "").strip()
        return min(MAX_SPAN, int(value)) if re.fullmatch(r"[0-9]{1,9}", value) else default


def build_tree(page: str) -> Node:
    """Element tree of a page; missing end tags, table rows and list items are supplied, stray end tags ignored."""
    root = Node("#root", "")
    stack = [root]

    def close(tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        last = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                last = i
            elif stack[i].tag in bounds:
                break
        if last:
            del stack[last:]

    def push(tag: str, attrs: str) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        return node

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m.group("text")
        if text is not None:
            stack[-1].children.append(html.unescape(text))
            continue
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("end"):
            if tag == "br":
                push("br", "")
            elif tag not in ("html", "body"):
                inner = tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption")
                bounds = frozenset() if tag == "table" else {"table"} if inner else CELL_BOUND - {tag}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in bounds:
                        break
            continue
        attrs = m.group("attrs")
        if tag in ("html", "body"):
            close({"head"}, set())
            continue
        if tag in ENDS_P:
            close({"p"}, CELL_BOUND)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in IMPLIED_ENDS:
            close(*IMPLIED_ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            stack.append(push("tr", ""))
        if stack[-1].tag == "head" and tag not in RAW and tag not in VOID and tag not in ("template", "noscript"):
            stack.pop()
        node = push(tag, attrs)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else n] if tag != "textarea" else html.unescape(page[at : end.start() if end else n]))
            at = n if end is None else (page.find(">", end.end()) + 1 or n)
        else:
            stack.append(node)
    return root


def is_hidden(node: Node) -> bool:
    """Elements without a rendering, and those hidden by attribute or inline style."""
    if node.tag in HIDDEN:
        return True
    if not node.attrs:
        return False
    if node.attr("hidden") is not None:
        return True
    style = node.attr("style")
    return style is not None and _NONE.search(style) is not None


class Writer:
    """Collects text with collapsed white space, line breaks and indentation."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks = 0
        self.space = False
        self.indent = 0
        self.marker = ""

    def line(self, n: int = 1) -> None:
        self.breaks = max(self.breaks, n)
        self.space = False

    def newline(self) -> None:
        """A forced line break; several add up."""
        self.breaks += 1
        self.space = False

    def put(self, text: str) -> None:
        if self.parts and self.breaks:
            self.parts.append("\n" * self.breaks)
        if not self.parts or self.breaks or self.marker:
            pad = " " * self.indent
            self.parts.append(pad[: len(pad) - len(self.marker)] + self.marker if self.marker else pad)
        elif self.space:
            self.parts.append(" ")
        self.breaks, self.space, self.marker = 0, False, ""
        self.parts.append(text)

    def text(self, text: str) -> None:
        flat = _RUN.sub(" ", text)
        if flat.startswith(" "):
            self.space = True
            flat = flat[1:]
        trailing = flat.endswith(" ")
        if trailing:
            flat = flat[:-1]
        if flat:
            self.put(flat)
            self.space = trailing

    def exact(self, text: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                self.newline()
            if line:
                self.put(line)

    def done(self) -> str:
        return "".join(self.parts)


def _marker(node: Node, counters: list) -> str:
    kind = counters[-1]
    if isinstance(kind, list):
        number = node.number("value", kind[0])
        kind[0] = number + 1
        return f"{number}. "
    return "- "


def _cells(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions and rows of a table; what lies outside rows is a caption, so that no text is lost."""
    captions: list[Node] = []
    rows: list[list[Node]] = []
    todo: list = list(reversed(table.children))
    loose = Node("div", "")
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            if child.strip(_SPACE):
                loose.children.append(child)
        elif is_hidden(child):
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            todo += reversed(child.children)
        elif child.tag == "tr":
            row: list[Node] = []
            for cell in child.children:
                if isinstance(cell, str):
                    if cell.strip(_SPACE):
                        loose.children.append(cell)
                elif not is_hidden(cell):
                    row.append(cell)
            rows.append(row)
        elif child.tag == "caption":
            captions.append(child)
        elif child.tag not in ("col", "colgroup"):
            loose.children.append(child)
    if loose.children:
        captions.append(loose)
    return captions, rows


def _table(table: Node, depth: int) -> str:
    captions, rows = _cells(table)
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}  # column: rows it stays taken
    for r, row in enumerate(rows):
        line: dict[int, tuple[list[str], int]] = {}
        column = 0
        used = {c for c, left in taken.items() if left > 0}
        taken = {c: left - 1 for c, left in taken.items() if left > 1}
        for cell in row:
            while column in used:
                column += 1
            span, down = max(1, cell.number("colspan", 1)), max(1, cell.number("rowspan", 1))
            text = render(cell, depth + 1)
            line[column] = (text.split("\n") if text else [""], span)
            if down > 1:
                taken |= {c: min(down, len(rows) - r) - 1 for c in range(column, column + span)}
            column += span
        grid.append(line)
    width: dict[int, int] = {}
    for wide in (False, True):
        for line in grid:
            for c, (texts, span) in line.items():
                if (span > 1) != wide:
                    continue
                need = max(map(len, texts))
                have = sum(width.get(c + k, 0) for k in range(span)) + 2 * (span - 1)
                if need > have:
                    width[c + span - 1] = width.get(c + span - 1, 0) + need - have
    # columns that only spans name have no width of their own
    starts, place = {}, 0
    for c in sorted({c for line in grid for c in line} | set(width)):
        starts[c] = place
        place += width.get(c, 0) + 2
    out = [t for c in captions if (t := render(c, depth + 1))]
    for line in grid:
        height = max((len(t) for t, _ in line.values()), default=0)
        for i in range(height):
            text = ""
            for c, (texts, _) in sorted(line.items()):
                if i < len(texts) and texts[i]:
                    text = text.ljust(starts[c]) + texts[i]
            out.append(text.rstrip(" "))
    while out and not out[-1]:
        out.pop()
    return "\n".join(out)


def render(root: Node, depth: int = 0) -> str:
    """Text of an element's content. Tables inside more than MAX_TABLE_DEPTH tables are written as plain blocks."""
    out = Writer()
    counters: list = [None]
    items: list[int] = []
    pre = 0
    todo: list = [(child, True) for child in reversed(root.children)]
    while todo:
        node, enter = todo.pop()
        if isinstance(node, str):
            out.exact(node) if pre else out.text(node)
            continue
        tag = node.tag
        if enter:
            if is_hidden(node):
                continue
            if tag == "br":
                out.newline()
                continue
            if tag == "wbr" or tag in VOID and tag != "hr":
                if tag == "input" and (node.attr("type") or "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel") and node.attr("value"):
                    out.text(f" {node.attr('value')} ")
                continue
            if tag in APART:
                out.line(2)
            elif tag in LINE:
                out.line(1)
            if tag == "hr":
                continue
            if tag == "table" and depth < MAX_TABLE_DEPTH:
                text = _table(node, depth)
                if text:
                    out.exact(text)
                out.line(2)
                continue
            if tag in ("ul", "ol", "menu"):
                counters.append([node.number("start", 1)] if tag == "ol" else "-")
                out.indent += 2
            elif tag == "li":
                out.marker = _marker(node, counters)
                items.append(max(0, len(out.marker) - 2) if len(counters) > 1 else 2)
                out.indent += items[-1]
            elif tag in ("dd", "blockquote"):
                out.indent += 2
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
            elif tag == "q":
                out.text('"')
            todo.append((node, False))
            children = node.children
            if tag == "details" and node.attr("open") is None:
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
            if tag in ("pre", "textarea") and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            todo += [(c, True) for c in reversed(children)]
            continue
        if tag in ("ul", "ol", "menu"):
            counters.pop()
            out.indent -= 2
        elif tag == "li":
            out.marker = ""  # an empty item shows nothing
            out.indent -= items.pop()
        elif tag in ("dd", "blockquote"):
            out.indent -= 2
        elif tag in ("pre", "textarea", "xmp"):
            pre -= 1
        elif tag == "q":
            out.text('"')
        if tag in APART:
            out.line(2)
        elif tag in LINE:
            out.line(1)
    return out.done()


def page_text(page: str | None) -> str:
    """Visible text of a page; null and empty pages give an empty text."""
    return render(build_tree(page)) if page else ""


def extract_text(df: DataFrame, page: str, *, to: str = "text") -> DataFrame:
    """``df`` with the page's visible text in column ``to``; a column of that name is replaced.

    Every row comes back; null pages give an empty text. What ``noscript`` holds is shown, as
    no script runs; the content of closed ``details`` is not, except its summary.
    """
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(page_text, na_action=None)

    return df.select(*[c for c in df.columns if c != to or c == page], run(F.col(page)).alias("_text")).drop(*[to]).withColumnRenamed("_text", to)
