"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout that keeps blocks, lists and tables.

The builder follows the rules of HTML for tags that may be left out: block tags end a paragraph, an item ends the
item before it, cells and rows end each other, and tags that never close end with what holds them. The renderer
walks the tree without recursion, so depth is no limit, and writes all visible text (attributes and inline styles hide; rules of style
sheets are not applied; an object shows what stands in its place): paragraphs apart by an empty
line, other blocks on lines of their own, list items with marks and indents, table cells in aligned columns.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import lean

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is text up to their end tag.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style title template noscript noembed noframes iframe datalist audio video canvas".split())
#: Tags that have a sense of their own within svg and math, where they are named with a slash: not drawn, or a line.
UNDRAWN = frozenset("annotation annotation-xml clippath defs desc marker mask metadata pattern symbol".split())
FOREIGN = UNDRAWN | {"text"}
HIDDEN |= {f"{t}/" for t in UNDRAWN}
#: Blocks with an empty line around, and blocks that only begin a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table blockquote pre figure hr address fieldset".split())
LINED = frozenset("html body div section article aside header footer main nav form li dt dd tr td th thead tbody tfoot caption figcaption details summary hgroup center legend option optgroup dialog search text/".split())
BLOCK = SPACED | LINED
ENDS_P = (SPACED | frozenset("article aside center details dialog dir div figcaption footer form header hgroup main nav section summary li dd dt".split()))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends the nearest open tag of the first set, unless one of the second set stands between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: An end tag does not reach beyond these.
WALL = frozenset(["td", "th", "caption", "table"])
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: A quote opens a value only after "=" and white space, and where it is closed somewhere; elsewhere it is a sign like others.
ATTRIBUTE = re.compile(r"""[ \t\n\r\f/]*+([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\r\f>]*+)))?""")
SPACES = re.compile(r"[ \t\n\r\f]+")
#: A declaration of a style attribute; a quoted value is one sign after another, so a ";" in it ends nothing.
DECLARATION = re.compile(r"""([-a-zA-Z]+)\s*:((?:"[^"]*"|'[^']*'|[^;"'])*)""")


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, attributes as written), ("end", tag, "") in order.

    Within svg and math a tag may close itself, and CDATA is text.
    """
    at, n = 0, len(source)
    foreign = 0  # open svg and math
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            yield "text", source[at:], ""
            return
        if lt > at:
            yield "text", source[at:lt], ""
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if foreign and source.startswith("<![CDATA[", lt):
            end = source.find("]]>", lt + 9)
            yield "text", source[lt + 9 : n if end < 0 else end].replace("&", "&amp;"), ""
            at = n if end < 0 else end + 3
            continue
        m = NAME.match(source, lt + 1)
        if not m:
            if source[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        tag = m[2].lower()
        outer = tag in ("svg", "math")
        last, end = m.end(), source.find(">", m.end())
        if end < 0 or foreign or outer or source.find('"', last, end) >= 0 or source.find("'", last, end) >= 0:
            while a := ATTRIBUTE.match(source, last):
                last = a.end()
            end = source.find(">", last)
        end = n if end < 0 else end
        at = end + 1
        name = f"{tag}/" if foreign and tag in FOREIGN else tag
        if m[1]:
            foreign -= outer and foreign > 0
            yield "end", name, ""
            continue
        yield "start", name, source[m.end() : end]
        if (foreign or outer) and source.endswith("/", last, end):
            yield "end", name, ""
            continue
        foreign += outer
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            yield "text", source[at : close.start() if close else n], ""
            at = close.start() if close else n


class Node:
    """An element: tag, attributes as written, and children, texts or elements."""

    __slots__ = ("tag", "written", "children")

    def __init__(self, tag: str, written: str = ""):
        self.tag, self.written, self.children = tag, written, []

    def attributes(self) -> dict[str, str]:
        return {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(self.written)} if self.written else {}


def build(source: str) -> Node:
    """The document's tree."""
    root = Node("#document")
    stack, count = [root], {"#document": 1}

    def push(tag: str, written: str = "") -> Node:
        node = Node(tag, written)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            count[tag] = count.get(tag, 0) + 1
        return node

    def close(tags: frozenset[str], walls: frozenset[str]) -> bool:
        """End the nearest of tags and all that it holds, if no wall stands between."""
        if not any(count.get(t) for t in tags):
            return False
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for node in stack[i:]:
                    count[node.tag] -= 1
                del stack[i:]
                return True
            if stack[i].tag in walls:
                return False
        return False

    for kind, value, written in tokens(source):
        if kind == "text":
            stack[-1].children.append(value)
        elif kind == "start":
            if value in ENDS_P and count.get("p"):
                close(frozenset(["p"]), WALL)
            if value in HEADINGS and stack[-1].tag in HEADINGS:
                close(HEADINGS, frozenset())
            if value in IMPLIED:
                close(*IMPLIED[value])
            if value in ("td", "th") and count.get("table") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                push("tr")
            push(value, written)
        elif value == "br":
            push("br")
        elif value == "p":
            if not close(frozenset(["p"]), WALL):
                push("p")
                close(frozenset(["p"]), frozenset())
        else:
            walls = frozenset() if value in ("table", "body", "html") else WALL - {value} if value in ("tr", "thead", "tbody", "tfoot") else WALL
            close(frozenset([value]), frozenset(["table"]) if value in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else walls)
    return root


class Box:
    """Lines being written: of the page, or of a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the open line
        self.gap = 0  # empty lines owed before the next text
        self.indent: list[str] = []
        self.mark = ""  # of a list item whose first line is still to come
        self.space = False  # white space owed before the next text of the line

    def text(self, value: str, kept: bool) -> None:
        value = html.unescape(value) if "&" in value else value
        if kept:
            for i, line in enumerate(value.replace("\r\n", "\n").split("\n")):
                if i:
                    self.end_line(force=True)
                if line:
                    self.put(line)
            return
        bare = SPACES.sub(" ", value)
        if bare == " " or not bare:
            self.space = self.space or bool(bare and self.parts)
            return
        if bare[0] == " " and self.parts:
            self.space = True
        self.put((" " if self.space and self.parts else "") + bare.strip(" "))
        self.space = bare[-1] == " "

    def put(self, value: str) -> None:
        if not self.parts:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            head = "".join(self.indent)
            if self.mark:
                head = head[: len(head) - len(self.mark)] + self.mark
                self.mark = ""
            self.parts.append(head)
        self.parts.append(value)

    def end_line(self, force: bool = False) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
            self.parts = []
        elif force and self.lines and not self.gap:
            self.lines.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        if spaced:
            self.gap = 1

    def ready(self, line: str) -> None:
        """A line that is laid out already."""
        self.end_line()
        self.put(line)
        self.end_line()

    def result(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    """Rows of finished cells: (column, span, lines)."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.taken: dict[int, int] = {}  # column -> further rows that a cell above reaches into

    def row(self) -> None:
        self.rows.append([])
        self.at = 0
        self.busy = {c for c, n in self.taken.items() if n > 0}
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.at in self.busy:
            self.at += 1
        self.rows[-1].append((self.at, across, lines))
        if down > 1:
            self.taken.update({c: down - 1 for c in range(self.at, self.at + across)})
        self.at += across

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for column, across, lines in row:
                if across == 1:
                    widths[column] = max(widths.get(column, 0), *map(wide, lines), 0) if lines else widths.get(column, 0)
        columns = sorted({c for row in self.rows for c, _, _ in row})
        starts, at = {}, 0
        for c in columns:
            starts[c] = at
            at += widths.get(c, 0) + 2
        out = []
        for row in self.rows:
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                line, length = [], 0
                for column, _, lines in row:
                    if i < len(lines) and lines[i]:
                        pad = max(starts[column] - length, 2 if length else 0)
                        line.append(" " * pad + lines[i])
                        length += pad + wide(lines[i])
                out.append("".join(line))
        return out


def wide(text: str) -> int:
    """The columns that a text takes: two for wide signs, none for those that combine."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def number(value: str | None, most: int) -> int:
    return min(max(int(value), 1), most) if value and value.isascii() and value.isdigit() else 1


def visible(node: Node, shown: bool, attributes: dict[str, str]) -> tuple[bool, bool]:
    """(whether the element is laid out at all, whether its own text shows)."""
    if node.tag in HIDDEN or "hidden" in attributes or (node.tag == "dialog" and "open" not in attributes):
        return False, False
    style = declared(attributes.get("style", ""))
    if style.get("display") == "none":
        return False, False
    seen = style.get("visibility")
    return True, shown if seen not in ("hidden", "collapse", "visible") else seen == "visible"


def declared(style: str) -> dict[str, str]:
    """The display and visibility that a style attribute sets: of several the last, but one that is marked important wins."""
    out: dict[str, str] = {}
    marked: set[str] = set()
    for name, value in DECLARATION.findall(style) if ":" in style else ():
        name, value = name.lower(), value.strip().lower()
        bare = re.sub(r"\s*!\s*important$", "", value)
        if name in ("display", "visibility") and (bare != value or name not in marked):
            out[name] = bare
            if bare != value:
                marked.add(name)
    return out


def render(root: Node) -> str:
    """All visible text of a tree."""
    page = Box()
    boxes, tables, lists = [page], [], []
    work: list[tuple] = [("open", root, True, False)]
    while work:
        step, node, shown, kept = work.pop()
        box = boxes[-1]
        if step == "text":
            if shown:
                box.text(node, kept)
            continue
        tag = node.tag
        if step == "close":
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag == "li":
                box.end_line()
                box.mark = ""
            elif tag in ("td", "th") and tables:
                boxes.pop()
                a = node.attributes()
                tables[-1].cell(box.result(), number(a.get("colspan"), 1000), number(a.get("rowspan"), 65534))
                continue
            elif tag == "table":
                for line in tables.pop().lines():
                    box.ready(line)
            if tag in ("li", "dd", "blockquote"):
                box.end_line()
                box.indent.pop()
            if tag in BLOCK:
                box.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists))
            continue
        a = node.attributes()
        laid, shown = visible(node, shown, a)
        if not laid:
            continue
        if tag == "br":
            box.end_line(force=True)
            continue
        if tag in BLOCK and not (tag in ("td", "th") and tables):
            box.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists))
        if tag in ("ul", "ol", "menu", "dir"):
            lists.append(int(a.get("start", "1")) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", a.get("start", "1")) else 1 if tag == "ol" else None)
        elif tag == "li":
            mark = "- "
            if lists and lists[-1] is not None:
                mark = f"{lists[-1]}. "
                lists[-1] += 1
            box.indent.append(" " * len(mark))
            box.mark = mark
        elif tag in ("dd", "blockquote"):
            box.indent.append("  ")
        elif tag == "table":
            tables.append(Table())
        elif tag == "tr" and tables:
            tables[-1].row()
        elif tag in ("td", "th") and tables:
            boxes.append(Box())
        elif tag == "input" and shown and a.get("type", "").lower() in ("submit", "button", "reset") and a.get("value"):
            box.text(a["value"], False)
        if tag in VOID:
            continue
        kept = kept or tag in ("pre", "textarea")
        work.append(("close", node, shown, kept))
        children = node.children
        if tag == "details" and "open" not in a:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        for child in reversed(children):
            work.append(("text", child, shown, kept) if isinstance(child, str) else ("open", child, shown, kept))
    return "\n".join(page.result())


def html_text(source: str | None) -> str:
    return render(build(source)) if source else ""


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for data in batches:
        yield pa.RecordBatch.from_arrays([data.column(0), pa.array([html_text(s) for s in data.column(1).to_pylist()], pa.string())], names=["page_id", "text"])


def extract_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every row of pages, in one pass without a shuffle.

    A null or empty html gives an empty text; what is no HTML is text. Repeated rows give repeated results, an empty table an empty
    one; further columns are not read.
    """
    lean(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(_texts, "page_id long, text string")
