"""Layout-aware rendering of HTML to text.

A tree builder copes with real pages: end tags that may be left out are implied, stray ones ignored, text that is in a table but
in no cell is moved before the table. Rules of visibility drop what a browser would not show. Everything that is visible is
emitted in the order of the page: blocks on lines of their own with the blank lines of their margins, lists with bullets or numbers
and indentation, preformatted text as it is, and table cells aligned in columns.

Defined cases: null or empty HTML gives empty text; text without tags is rendered as one block; unclosed comments, tags and raw
elements end with the page; nesting beyond MAX_DEPTH is flattened, not lost, and what a table without room for its parts holds becomes plain lines; a very long
page is rendered whole, its tree held by one task; repeated rows give repeated rows; an empty table gives an empty result; columns
other than the id and the HTML are ignored.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtable.llm.common import map_arrow
from streamtable.llm.tokens import slices

MAX_DEPTH = 200
#: A table is only built where it and its section, row and cell can be opened.
TABLE_LEVELS = 4
#: Cells are padded to their column's width, but not beyond so many characters; longer ones run over.
MAX_COLUMN = 60
# The HTML standard's largest spans. A rowspan of 0 goes on to the end of the row's group, which no cell leaves.
MAX_SPAN, MAX_DOWN = 1000, 65534

# The HTML standard's sets of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPED_RAW = frozenset("textarea title".split())
HIDDEN = frozenset("area base datalist head iframe link meta noembed noframes noscript param rp script style template title audio video canvas object".split())
BLOCK = frozenset(
    "address article aside body blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table tbody td tfoot th thead tr ul xmp".split()
)
SPACED = frozenset("blockquote dir dl figure h1 h2 h3 h4 h5 h6 hr listing menu ol p plaintext pre table ul xmp".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p "
    "pre listing search section summary table ul li dd dt xmp plaintext".split()
)
#: A start tag ends the nearest of these elements, if none of the others lies in between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup"}, {"table"}),
    "colgroup": ({"caption", "colgroup"}, {"table"}),
}
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
IN_TABLE = frozenset("table tbody tfoot thead tr".split())
#: No end tag but a table's own reaches beyond these.
WALLS = frozenset("caption html table td template th".split())

# The standard's tokeniser states as one pattern: an attribute's name runs to a space, slash, = or >, and a quote opens a value only
# right behind =. Atomic, as no other way to read a tag is tried.
_VALUE = r"""\"[^"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>]*+"""
_NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
_GAP = r"[ \t\n\f\r]*+"
_TAG = re.compile(rf"<(?:!--(?:-?>|(.*?)(?:-->|--!>|\Z))|(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?>[ \t\n\f\r/]++|{_NAME}(?:{_GAP}={_GAP}(?:{_VALUE}))?+)*+)(>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_GAP}={_GAP}(?:\"([^\"]*)\"?|'([^']*)'?|([^ \t\n\f\r>]*)))?")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        """By lower-case name; of equal names the first counts."""
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.attrs):
            found.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
        return found


def parse(page: str) -> Node:
    """The page's tree below a node `html`."""
    root = Node("html")
    stack = [root]
    flat: dict[int, int] = {}  # id of an open node: open tables right in it that are too deep to be built

    def add(child: Node | str) -> None:
        at = stack[-1]
        if at.tag in IN_TABLE and (child.strip(" \t\n\f\r") if isinstance(child, str) else child.tag not in TABLE_PARTS and child.tag not in ("script", "style", "template", "form")):
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "table"), 0)
            if k:
                own = stack[k - 1].children
                own.insert(len(own) - 1, child)
                return
        at.children.append(child)

    def add_text(s: str) -> None:
        if stack[-1].tag in ("head", "colgroup") and s.strip(" \t\n\f\r"):
            stack.pop()
        add(s)

    def close(names: set[str] | frozenset[str], walls) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return True
            if stack[k].tag in walls:
                return False
        return False

    def table() -> int:
        """The place of the innermost table, or of the node that a table too deep to be built is in; 0 without any."""
        return next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "table" or flat.get(id(stack[k]))), 0)

    def start(tag: str, attrs: str, closed: bool) -> None:
        if stack[-1].tag == "head" and tag not in IN_HEAD or stack[-1].tag == "colgroup" and tag not in ("col", "template"):
            stack.pop()
        if tag in TABLE_PARTS:
            k = table()
            if not k:
                return
            if stack[k].tag != "table":
                del stack[k + 1 :]
                add(Node("div"))  # parts the lines
                return
            if tag in IMPLIED:
                if tag in ("td", "th"):
                    close({"td", "th"}, {"table", "tr"})
                    if not _inside(stack, "tr"):
                        start("tr", "", False)
                    while stack[-1].tag != "tr":
                        stack.pop()
                else:
                    ends, walls = IMPLIED[tag]
                    close(ends, walls)
                    while stack[-1].tag not in IN_TABLE or tag not in ("tr",) and stack[-1].tag != "table":
                        stack.pop()
        elif tag in IMPLIED:
            ends, walls = IMPLIED[tag]
            close(ends, walls | WALLS)
        if tag in ENDS_P:
            close({"p"}, WALLS | {"button"})
        if tag in ("html", "body"):
            stack[0].attrs += attrs  # one of each, and it is there already
            return
        if tag == "table" and len(stack) + TABLE_LEVELS > MAX_DEPTH:
            add(Node("div"))
            flat[id(stack[-1])] = flat.get(id(stack[-1]), 0) + 1
            return
        node = Node(tag, attrs)
        add(node)
        if tag == "form" and stack[-1].tag in IN_TABLE:
            return  # stays empty: what follows goes before the table or into its cells
        # What isn't shown may be deeper: it is never descended into.
        if tag not in VOID and not (closed and tag not in BLOCK and tag not in RAW) and (len(stack) < MAX_DEPTH or not visible(node)):
            stack.append(node)

    def end(tag: str) -> None:
        if tag == "br":
            add(Node("br"))
        elif tag == "p" and not any(x.tag == "p" for x in stack):
            add(Node("p"))
        elif re.fullmatch("h[1-6]", tag):
            close({"h1", "h2", "h3", "h4", "h5", "h6"}, WALLS)
        elif (tag == "table" or tag in TABLE_PARTS) and flat and flat.get(id(stack[k := table()])):
            del stack[k + 1 :]
            add(Node("div"))
            flat[id(stack[k])] -= tag == "table"
        elif tag not in ("html", "body"):
            close({tag}, {"html", "table"} - {tag} if tag in TABLE_PARTS or tag == "table" else WALLS - {tag})

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add_text(_text(page[at:]))
            break
        if m.start() > at:
            add_text(_text(page[at : m.start()]))
        at = max(m.end(), m.start() + 1)
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            end(tag)
            continue
        start(tag, m[4], m[4].endswith("/"))
        if tag == "plaintext":
            add(page[at:])
            break
        if tag in RAW or tag in ESCAPED_RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            body = page[at : stop.start() if stop else n]
            if body:
                add(_text(body) if tag in ESCAPED_RAW else body)
            at = stop.start() if stop else n
            close({tag}, ())
    return root


def _inside(stack: list[Node], tag: str) -> bool:
    """Whether `tag` is open in the innermost table."""
    for node in reversed(stack):
        if node.tag == tag:
            return True
        if node.tag == "table":
            return False
    return False


def _text(s: str) -> str:
    return html.unescape(s) if "&" in s else s


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    a = node.attrs
    if not a or not ("hidden" in (low := a.lower()) or "none" in low or "collapse" in low or node.tag in ("dialog", "input")):
        return node.tag != "dialog"
    found = node.attributes()
    if "hidden" in found or _NOT_SHOWN.search(found.get("style", "")) or node.tag == "dialog" and "open" not in found:
        return False
    return not (node.tag == "input" and found.get("type", "").lower() == "hidden")


class Lines:
    """Collects rendered lines: words with collapsed space, line ends, and blank lines between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space, self.gap = False, 0

    def text(self, s: str) -> None:
        words = [w for w in (s.split() if s.isascii() else _SPACES.split(s)) if w]
        if not words:
            self.space = self.space or bool(s) and bool(self.parts)
            return
        if self.parts and (self.space or s[0] in " \t\n\f\r"):
            self.parts.append(" ")
        self.parts.append(" ".join(words))
        self.space = s[-1] in " \t\n\f\r"

    def raw(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.parts.append(first)
        for x in rest:
            self.end_line(True)
            self.parts.append(x)

    def end_line(self, blank: bool = False) -> None:
        line = "".join(self.parts)
        self.parts, self.space = [], False
        if line or blank:
            self.put([line])

    def put(self, lines: list[str]) -> None:
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines += lines

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


def render(node: Node, out: Lines, pre: bool = False) -> None:
    """Emit the visible text below a node."""
    for child in node.children:
        if isinstance(child, str):
            out.raw(child) if pre else out.text(child)
            continue
        tag = child.tag
        if not visible(child):
            continue
        if tag == "br":
            out.end_line(True)
        elif tag == "wbr":
            continue
        elif tag == "input":
            a = child.attributes()
            if a.get("type", "text").lower() not in ("checkbox", "radio", "file", "image", "password", "range", "color"):
                out.text(f" {a.get('value', '')} ")
        elif tag in ("ul", "ol", "menu", "dir"):
            out.block(_gap(node))
            _list(child, out, pre)
            out.block(_gap(node))
        elif tag == "table":
            out.block(1)
            out.put(_table(child))
            out.block(1)
        elif tag == "details" and "open" not in child.attributes():
            out.block(0)
            only = Node("details")
            only.children = [x for x in child.children if isinstance(x, Node) and x.tag == "summary"][:1]
            render(only, out, pre)
            out.block(0)
        elif tag in BLOCK:
            gap = int(tag in SPACED)
            out.block(gap)
            if tag in ("blockquote", "dd"):
                _indented(child, out, pre, "  ", "  ")
            else:
                if tag in ("pre", "listing", "textarea") and child.children and isinstance(child.children[0], str):
                    child.children[0] = re.sub(r"\A\r?\n", "", child.children[0])
                render(child, out, pre or tag in ("pre", "listing", "xmp", "plaintext"))
            out.block(gap)
        else:
            render(child, out, pre or tag == "textarea")


def _gap(parent: Node) -> int:
    """Lists within lists have no margin."""
    return int(parent.tag not in ("li", "ul", "ol", "menu", "dir"))


def _indented(node: Node, out: Lines, pre: bool, first: str, rest: str) -> None:
    inner = Lines()
    render(node, inner, pre)
    lines = inner.finish()
    if lines or first.strip():
        lines = lines or [""]
        out.put([(first + lines[0]).rstrip() if not lines[0] else first + lines[0], *(rest + x if x else x for x in lines[1:])])


def _list(node: Node, out: Lines, pre: bool) -> None:
    a = node.attributes()
    number = _int(a.get("start"), 1)
    step = -1 if "reversed" in a else 1
    if step < 0 and "start" not in a:
        number = sum(isinstance(x, Node) and x.tag == "li" for x in node.children)
    other = Node("div")
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            other.children = [child]
            render(other, out, pre)
            continue
        if not visible(child):
            continue
        out.block(0)
        mark = "- "
        if node.tag == "ol":
            number = _int(child.attributes().get("value"), number)
            mark = f"{number}. "
            number += step
        _indented(child, out, pre, mark, " " * len(mark))


def _int(s: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", s or "")
    return int(m[1]) if m else default


def width(s: str) -> int:
    """Columns that a line takes."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _rows(node: Node) -> Iterator[tuple[int, Node]]:
    """A table's rows in the order shown, head, bodies, foot, each with the number of its group."""
    parts = [x for x in node.children if isinstance(x, Node) and visible(x)]
    group, loose = 0, False
    for kinds in (("thead",), ("tbody", "tr"), ("tfoot",)):
        for x in parts:
            if x.tag in kinds:
                group += not (loose and x.tag == "tr")  # rows in no section make one group with their neighbours
                loose = x.tag == "tr"
                yield from [(group, x)] if loose else ((group, r) for r in x.children if isinstance(r, Node) and r.tag == "tr" and visible(r))


def _leftovers(node: Node) -> Iterator[Node | str]:
    """What is in a table but in none of its cells and captions."""
    for x in node.children:
        if isinstance(x, str):
            if x.strip():
                yield x
        elif x.tag in ("tbody", "thead", "tfoot", "tr", "colgroup"):
            if visible(x):
                yield from _leftovers(x)
        elif x.tag not in TABLE_PARTS:
            yield x


def _table(node: Node) -> list[str]:
    """Lines of a table: captions, whatever is in no cell, then rows with aligned cells."""
    head: list[str] = []
    for x in node.children:
        if isinstance(x, Node) and x.tag == "caption" and visible(x):
            inner = Lines()
            render(x, inner)
            head += inner.finish()
    other = Node("div")
    other.children = list(_leftovers(node))
    if other.children:
        inner = Lines()
        render(other, inner)
        head += inner.finish()
    taken: dict[int, int] = {}  # column: rows still covered from above
    rows: list[list[tuple[int, int, str, list[str]]]] = []
    widths: dict[int, int] = {}
    last_group = 0
    for group, row in _rows(node):
        column, cells, covered = 0, [], taken if group == last_group else {}
        last_group = group
        taken = {c: n - 1 for c, n in covered.items() if n > 1}
        for x in row.children:
            if not isinstance(x, Node) or x.tag not in ("td", "th"):
                continue
            while covered.get(column):
                column += 1
            a = x.attributes() if x.attrs else {}
            span = min(max(_int(a.get("colspan"), 1), 1), MAX_SPAN)
            down = min(_int(a.get("rowspan"), 1), MAX_DOWN)
            down = MAX_DOWN if down == 0 else max(down, 1)
            if down > 1:
                taken |= {c: down - 1 for c in range(column, column + span)}
            inner = Lines()
            if visible(x):
                render(x, inner)
            lines = inner.finish()
            side = (re.search(r"text-align\s*:\s*(\w+)", a.get("style", "")) or [None, a.get("align", "")])[1].lower()
            cells.append((column, span, side, lines))
            if span == 1:
                widths[column] = max(widths.get(column, 0), min(max(map(width, lines), default=0), MAX_COLUMN))
            column += span
        rows.append(cells)
    last = max((c + s for r in rows for c, s, _, _ in r), default=0)
    # Columns that no cell has to itself take no room.
    place, at = [], 0
    for c in range(last + 1):
        place.append(at)
        at += widths[c] + 2 if c in widths else 0
    out = []
    for cells in rows:
        for k in range(max((len(lines) for *_, lines in cells), default=0)):
            line = ""
            for c, span, side, lines in cells:
                s = lines[k] if k < len(lines) else ""
                if not s:
                    continue
                start, room = place[c], place[c + span] - place[c] - 2
                free = max(0, room - width(s))
                start += free if side == "right" else free // 2 if side == "center" else 0
                line += " " * max(start - width(line), 2 if line else 0) + s
            out.append(line)
    return head + out


def to_text(page: str | None) -> str:
    """The page's visible text."""
    if not page:
        return ""
    if sys.getrecursionlimit() < 20 * MAX_DEPTH:
        sys.setrecursionlimit(20 * MAX_DEPTH)
    root, out = parse(page.replace("\0", "�")), Lines()
    if visible(root):
        render(root, out)
    return "\n".join(x.rstrip(" ") for x in out.finish()).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text, and the text's lines and characters, for every page."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([to_text(x.as_py()) for x in part.column("html")], pa.string())], names=["id", "text"])

    rows = map_arrow(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), run, f"id {kind}, text string")
    n_lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return rows.select(F.col("id").alias(id_col), "text", n_lines.alias("n_lines"), F.length("text").cast("long").alias("n_chars"))
