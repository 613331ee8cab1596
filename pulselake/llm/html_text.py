"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, and a text rendering."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_BLANK = " \t\n\r\f"
#: Tags without attributes, which most are.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><\"'=]*)[ \t\n\r\f]*>")
_TAG_NAME = re.compile(r"[a-zA-Z][^ \t\n\r\f/>]*")
_BETWEEN = re.compile(r"[ \t\n\r\f/]*")
_NAME = re.compile(r"=?[^ \t\n\r\f/>=]*")
_EQUALS = re.compile(r"[ \t\n\r\f]*=[ \t\n\r\f]*")
_UNQUOTED = re.compile(r"[^ \t\n\r\f>]*")
_COMMENT_END = re.compile(r"--!?>")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")
#: Attributes that the rendering looks at.
_WANTED = frozenset("hidden style colspan rowspan start type".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object video audio canvas datalist title noembed noframes".split())
#: What may stand in a head; text and other tags end it.
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Blocks by the number of empty lines around them.
BLOCK = dict.fromkeys("address article aside body center dd details dialog div dt fieldset figcaption figure footer form header hgroup html legend li main menu nav option optgroup section select summary tbody td tfoot th thead tr caption".split(), 0)
BLOCK |= dict.fromkeys("blockquote dl h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split(), 1)
#: Start tags that close an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
#: For a start tag: (open elements that it closes, elements that stop the search for them).
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
_P_STOPS = frozenset("td th table li div button object".split())
_TABLE_PARTS = frozenset("td th tr tbody thead tfoot table".split())
_CELL_STOPS = frozenset("td th table".split())
_PARENT = {"td": "tr", "th": "tr"}

#: Layout bounds: they keep a page's text in proportion to the page, and never drop text.
#: Indents deeper than this many characters stay there; tables inside this many tables are
#: read as plain blocks; cells wider than this do not widen their column; spans count up to
#: this many columns.
DEEPEST, NESTED, WIDEST, SPAN = 40, 6, 80, 64


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def number(self, name: str, default: int) -> int:
        found = re.match(r"\s*([+-]?\d{1,9})", self.attributes.get(name, ""))
        return int(found[1]) if found else default


class _Source:
    """A page being read from left to right; remembers which quotes and marks do not come any more."""

    def __init__(self, text: str):
        self.text = text
        self._gone: set[str] = set()

    def find(self, mark: str, at: int) -> int:
        """The next place of ``mark``, or -1. After one -1 it is not sought again, as reading only moves on."""
        if mark in self._gone:
            return -1
        found = self.text.find(mark, at)
        if found < 0:
            self._gone.add(mark)
        return found

    def tag(self, at: int) -> tuple[int, dict[str, str]]:
        """(end, wanted attributes) of a tag whose name ends at ``at``.

        Quotes count only right after '='. A value whose quote never closes ends at the next
        '>', so that the text behind it is kept. A tag without '>' reaches to the page's end.
        """
        text, found = self.text, {}
        while True:
            at = _BETWEEN.match(text, at).end()
            if at >= len(text):
                return at, found
            if text[at] == ">":
                return at + 1, found
            named = _NAME.match(text, at)
            at = named.end()
            value = ""
            if equals := _EQUALS.match(text, at):
                at = equals.end()
                quote = text[at : at + 1]
                if quote in ('"', "'"):
                    end = self.find(quote, at + 1)
                    if end < 0:
                        end = self.find(">", at + 1)
                        value, at = (text[at + 1 : end], end) if end >= 0 else (text[at + 1 :], len(text))
                    else:
                        value, at = text[at + 1 : end], end + 1
                elif quote and quote != ">":
                    value = _UNQUOTED.match(text, at)[0]
                    at += len(value)
            name = named[0].lower()
            if name in _WANTED and name not in found:
                found[name] = html.unescape(value)


class _Stack:
    """Open elements, with the places of each tag, so that a search costs the tags and not the depth."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags: set | frozenset | tuple) -> int:
        """The innermost place of any of the tags, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: set, stops: set | frozenset) -> None:
        at = self.last(tags)
        if at and at > self.last(stops):
            while at > 1 and self.nodes[at - 1].tag in tags:
                at -= 1
            self.cut(at)


_RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.I) for tag in RAW}


def build_tree(page: str) -> Node:
    """The tree of a page: implied end tags (p, li, dt, dd, options, table parts), implied rows,
    void and raw-text elements, and unmatched end tags ignored. The work grows with the page."""
    source, root = _Source(page), Node("html")
    stack, at, text_from = _Stack(root), 0, 0

    def add_text(until: int) -> None:
        if until > text_from:
            text = page[text_from:until]
            text = html.unescape(text) if "&" in text else text
            if stack.nodes[-1].tag == "head" and text.strip(_BLANK):
                stack.cut(len(stack.nodes) - 1)
            stack.nodes[-1].children.append(text)

    while True:
        at = page.find("<", at)
        if at < 0:
            break
        plain = _PLAIN_TAG.match(page, at)
        if plain:
            closing, tag, end, attributes = bool(plain[1]), plain[2].lower(), plain.end(), {}
        else:
            follows = page[at + 1 : at + 2]
            closing = follows == "/"
            name = _TAG_NAME.match(page, at + 1 + closing)
            if not name:
                if page.startswith("<!--", at):
                    short = next((at + 4 + len(s) for s in (">", "->") if page.startswith(s, at + 4)), 0)
                    done = None if short else _COMMENT_END.search(page, at + 4)
                    end = short or (done.end() if done else len(page))
                elif follows in ("!", "?") or (closing and at + 2 < len(page)):
                    end = source.find(">", at + 1) + 1 or len(page)
                else:  # a sign like others
                    at += 1
                    continue
                add_text(at)
                at = text_from = end
                continue
            tag = name[0].lower()
            end, attributes = source.tag(name.end())
        add_text(at)
        at = text_from = end
        if closing:
            found = stack.last((tag,))
            if found and (tag in _TABLE_PARTS or found > stack.last(_CELL_STOPS)):
                stack.cut(found)
            continue
        if tag in ("html", "body"):
            stack.close({"head"}, frozenset())
            for key, value in attributes.items():
                root.attributes.setdefault(key, value)
            continue
        if stack.nodes[-1].tag == "head" and tag not in _IN_HEAD:
            stack.cut(len(stack.nodes) - 1)
        if tag in _ENDS_P:
            stack.close({"p"}, _P_STOPS)
        if tag in _IMPLIED:
            stack.close(*_IMPLIED[tag])
        if tag in _PARENT and stack.nodes[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack.nodes[-1].children.append(row)
            stack.push(row)
        node = Node(tag, attributes)
        stack.nodes[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            done = _RAW_END[tag].search(page, at)
            inner = page[at : done.start() if done else len(page)]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = text_from = source.tag(done.end())[0] if done else len(page)
        elif not (page[at - 2] == "/" and tag in ("path", "circle", "rect", "g")):
            stack.push(node)
    add_text(len(page))
    return root


def _width(text: str) -> int:
    """Places that a text takes on a fixed-width display."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines of text under construction: inline runs, margins between blocks, hanging indents."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space, self.gap = False, 0
        self.indents: list[int] = []
        self.indent = 0
        self.marker = ""

    def text(self, value: str, pre: bool) -> None:
        if pre:
            *lines, last = value.split("\n")
            for line in lines:
                self.parts.append(line)
                self.line(force=True)
            self.parts.append(last)
            return
        words = _BLANKS.sub(" ", value)
        if not words:
            return
        if words[0] == " ":
            self.space = True
            words = words[1:]
        if words:
            if self.space and self.parts:
                self.parts.append(" ")
            trailing = words[-1] == " "
            self.parts.append(words[:-1] if trailing else words)
            self.space = trailing

    def push(self, width: int) -> None:
        self.indents.append(width)
        self.indent += width

    def pop(self) -> None:
        self.indent -= self.indents.pop()
        self.marker = ""

    def line(self, force: bool = False) -> None:
        """End the line; without ``force`` an empty one is not written."""
        value = "".join(self.parts).rstrip()
        self.parts, self.space = [], False
        if value or force:
            self.write(value)

    def write(self, value: str) -> None:
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        indent = " " * min(self.indent, DEEPEST)
        if self.marker:
            indent = indent[: max(0, len(indent) - len(self.marker))] + self.marker
            self.marker = ""
        self.lines.append((indent + value).rstrip())

    def block(self, margin: int) -> None:
        self.line()
        self.gap = max(self.gap, margin)


class _Table:
    """Cells of a table at their columns; column and row spans push later cells to the right."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self._taken: dict[int, int] = {}  # column -> rows below that a cell above still covers

    def row(self) -> None:
        self._taken = {c: n - 1 for c, n in self._taken.items() if n > 1}
        self.rows.append([])
        self._next = 0

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        while self._taken.get(self._next):
            self._next += 1
        self.rows[-1].append((self._next, columns, lines))
        if rows > 1:
            self._taken |= dict.fromkeys(range(self._next, min(SPAN, self._next + columns)), rows)
        self._next += columns

    def aligned(self) -> Iterator[str]:
        widths: dict[int, int] = {}
        spans: list[tuple[int, int, int]] = []
        for row in self.rows:
            for column, columns, lines in row:
                wide = min(WIDEST, max(map(_width, lines), default=0))
                if columns == 1:
                    widths[column] = max(widths.get(column, 0), wide)
                else:
                    widths.setdefault(column, 0)
                    spans.append((column, columns, wide))
        used = sorted(widths)
        for column, columns, wide in spans:
            inside = used[bisect_left(used, column) : bisect_left(used, column + columns)]
            room = sum(widths[c] + 2 for c in inside) - 2
            widths[inside[-1]] += max(0, wide - room)
        left, at = {}, 0
        for c in used:
            left[c] = at
            at += widths[c] + 2
        for row in self.rows:
            cells = [c for c in row if c[2]]
            for k in range(max((len(lines) for _, _, lines in cells), default=0)):
                out, place = [], 0
                for column, _, lines in cells:
                    if k < len(lines) and lines[k]:
                        pad = max(left[column] - place, 2 if place else 0)
                        out.append(" " * pad + lines[k])
                        place += pad + _width(lines[k])
                yield "".join(out)


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """(whether the element is displayed at all, whether its own text is visible)."""
    style = node.attributes.get("style", "")
    if node.tag in HIDDEN or "hidden" in node.attributes or (style and _DISPLAY.search(style)):
        return False, False
    if style and (found := _VISIBILITY.findall(style)):
        visible = found[-1].lower() == "visible"
    return True, visible


def render(root: Node) -> str:
    """All visible text: blocks on lines of their own, margins as empty lines, list markers with
    hanging indents, preformatted text as it is, tables with aligned columns whose cells keep
    their own lines. What is not displayed is left out with all inside it; of what is merely
    invisible, parts may be visible again."""
    pages: list[_Page] = [_Page()]
    tables: list[_Table | None] = []
    lists: list[list] = []
    cells: list[Node] = []
    pre = 0
    work: list[tuple[bool, Node | str, bool]] = [(True, root, True)]
    while work:
        enter, node, visible = work.pop()
        page = pages[-1]
        if isinstance(node, str):
            if visible:
                page.text(node, pre > 0)
            continue
        tag = node.tag
        table = tables[-1] if tables else None
        if enter:
            shown, visible = _shown(node, visible)
            if not shown:
                continue
            if tag == "br":
                page.line(force=True)
                continue
            if tag in VOID and tag != "hr":
                continue
            if tag == "table":
                page.block(1)
                tables.append(_Table() if len(tables) < NESTED else None)
            elif tag == "tr" and table:
                table.row()
            elif tag in ("td", "th") and table and table.rows:
                pages.append(_Page())
                cells.append(node)
            elif tag in BLOCK:
                page.block(0 if lists and tag in ("ul", "ol") else BLOCK[tag])
                if tag in ("ul", "ol", "menu"):
                    lists.append([tag == "ol", node.number("start", 1)])
                elif tag == "li":
                    mark = "- "
                    if lists and lists[-1][0]:
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    page.push(len(mark))
                    page.marker = mark
                elif tag in ("dd", "blockquote"):
                    page.push(2)
                elif tag == "pre":
                    pre += 1
                elif tag == "hr":
                    page.parts.append("---")
                    page.block(1)
                    continue
            work.append((False, node, visible))
            work.extend((True, child, visible) for child in reversed(node.children))
            continue
        if tag == "table":
            page.line()
            if done := tables.pop():
                for line in done.aligned():
                    page.write(line)
            page.block(1)
        elif cells and cells[-1] is node:
            cells.pop()
            page.line()
            table.cell(pages.pop().lines, min(SPAN, max(1, node.number("colspan", 1))), max(1, node.number("rowspan", 1)))
        elif tag in BLOCK and not (tag == "tr" and table):
            page.block(0 if len(lists) > 1 and tag in ("ul", "ol") else BLOCK[tag])
            if tag in ("ul", "ol", "menu") and lists:
                lists.pop()
            elif tag in ("li", "dd", "blockquote") and page.indents:
                page.pop()
            elif tag == "pre":
                pre -= 1
    pages[0].line()
    return "\n".join(pages[0].lines)


def page_text(source: str | None) -> str:
    """Visible text of a page; null and empty pages have none."""
    return render(build_tree(source)) if source else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every page, without a shuffle.

    Null or empty html gives an empty text; broken markup never fails; pages are read whole
    in time that grows with their length, however deep or broken they are; every row is kept,
    repeated ones and null ids too; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(page_text, part.column(1).to_pylist()), pa.string())], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string")
