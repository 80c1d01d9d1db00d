"""All visible text of HTML pages, rendered with its layout.

A small tree builder reads the markup: implied end tags close paragraphs, list items and table
parts, raw-text elements run to their own end tag, and stray end tags are skipped. Visibility
rules then hide what a browser would not show, and a renderer walks the tree: blocks stand on
lines of their own with blank lines around paragraphs and headings, lists are indented and
marked, table cells are aligned in columns, and preformatted text keeps its lines. Row groups and
rows that a table implies are built, forms between cells hold nothing, and what stands in a table
outside its cells follows it.

Not shown are scripts, styles, templates, page titles, hidden elements, closed dialogs, suggestions of
a datalist, what stands in for frames, objects, media and missing scripts, annotations of formulas, and
descriptions and definitions of graphics, nor the body of closed details. A select shows its chosen or
first option, a list of options all of them. What is made visible within something invisible is shown.

Time and output stay in proportion to the page, by these rules. Indentation stops growing at 32
columns. Tables within more than 8 others are rendered as blocks, one cell below another. A cell that
begins beyond the 256th column takes one column and one row. A table whose aligned lines would
take more than 8 characters for each character and 16 for each cell that the page has for it is
written with its cells two blanks apart instead. A page then gives at most about 20 characters for
each of its own.

Defined cases: null or empty markup gives an empty text. Text outside any element is rendered.
Elements left open end with the page; nesting of any depth is handled without recursion. Rows
are rendered one by one, so repeated rows and ids are fine. The output column replaces a column
of that name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siltgate.llm.text import column

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
_HIDDEN = frozenset("head script style template noscript iframe noembed noframes object video audio canvas datalist title".split())
#: Not shown within graphics and formulas.
_HIDDEN_FOREIGN = {"svg": frozenset("title desc defs metadata symbol clippath mask marker pattern".split()), "math": frozenset("annotation annotation-xml".split())}
#: Elements of graphics and formulas that hold HTML, and tags that end graphics and formulas.
_INTEGRATION = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split()), "": frozenset()}
_BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Parts that stand apart from what is beside them.
_SPACED = {"svg": frozenset({"text"}), "math": frozenset("math mfrac mtr mtd".split()), "": frozenset("select input button textarea meter progress".split())}
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre figure fieldset hr".split())
_BLOCK = _PARAGRAPH | frozenset("html body div section article nav aside header footer main address li dt dd form figcaption details summary legend center dir tr caption thead tbody tfoot td th option optgroup dialog hgroup search".split())
_TABLE = frozenset("table thead tbody tfoot tr".split())
_APART = frozenset({"template", "noscript"})  # tags in these close nothing around them
_GROUPS = frozenset("thead tbody tfoot".split())
#: A part of a table goes into the nearest of these, and closes what is open below it.
_HOLDERS = {"td": _TABLE, "th": _TABLE, "tr": _GROUPS | {"table"}} | dict.fromkeys((*_GROUPS, "caption", "colgroup", "col"), frozenset({"table"}))

#: A start tag closes these open elements, unless one of the others stands between.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
_CLOSES_P = _PARAGRAPH | frozenset("div section article nav aside header footer main address form details center figcaption li dt dd".split())
_P_BARRIER = frozenset("td th caption button object table".split())

# a quote opens a value only straight after '='; anywhere else it is part of a name or of a value
_VALUE = r"[ \t\n\f\r]*=[ \t\n\f\r]*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^ \t\n\f\r>]+))?"
_ATTRIBUTE = re.compile(rf"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*)(?:{_VALUE})?")
_ATTRIBUTES = re.sub(r"\((?!\?)", "(?:", rf"(?:[ \t\n\f\r]++|/|{_ATTRIBUTE.pattern})*+")
_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*>?"
    rf"|<(?P<end>/?)(?P<name>[A-Za-z][^ \t\n\f\r/>]*)(?P<attrs>{_ATTRIBUTES.replace('|/|', '|(?P<slash>/)|', 1)})>?",
    re.DOTALL,
)
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|opacity\s*:\s*0(?:\.0+)?\s*(?:;|!|$)", re.IGNORECASE)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.IGNORECASE)
_SPACES = re.compile(r"[ \t\n\f\r]+")
_INDENT = 32  # columns that indentation takes at most
_NESTED = 8  # tables around a table that is still laid out
_COLUMNS = 256  # columns in which cells may span several
_PER_CHAR, _PER_CELL = 8, 16  # characters of aligned lines for each character and cell of a table


class Node:
    __slots__ = ("name", "attrs", "children", "parent", "foreign", "veiled")

    def __init__(self, name: str, attrs: dict, parent: Node | None):
        self.name, self.attrs, self.children, self.parent = name, attrs, [], parent
        within = parent.foreign if parent and parent.name not in _INTEGRATION[parent.foreign] else ""
        self.foreign = within or (name if name in ("svg", "math") else "")
        own = _VISIBILITY.findall(attrs["style"]) if "style" in attrs else None
        self.veiled = own[-1].lower() != "visible" if own else parent is not None and parent.veiled


class _Path:
    """The open elements from the root down, with the places of each name, so that none is searched for."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    @property
    def here(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Close the element at a place, and all in it."""
        while len(self.nodes) > max(place, 1):
            self.places[self.nodes.pop().name].pop()

    def nearest(self, names) -> int:
        """The place of the innermost open element with one of the names; 0 if there is none."""
        return max((own[-1] for own in map(self.places.get, names) if own), default=0)

    def above(self, names) -> int:
        """As :meth:`nearest`, but not beyond elements that stand apart."""
        place = self.nearest(names)
        return place if place > self.nearest(_APART) else 0

    def close(self, names, barrier) -> bool:
        """Close the innermost of the named elements, unless a barrier stands between."""
        place = self.above(names)
        if place <= self.nearest(barrier):
            return False
        self.cut(place)
        return True


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return found


def parse(html: str) -> Node:
    """The tree of a page; text children are plain strings."""
    path = _Path(Node("#root", {}, None))
    at, size = 0, len(html)
    endless: set[str] = set()  # raw-text elements whose end tag does not come any more

    def inside(name: str) -> None:
        node = Node(name, {}, path.here)
        path.here.children.append(node)
        path.push(node)

    def content(text: str, shown: str) -> None:
        if path.here.name in ("head", "colgroup") and text.strip():
            path.cut(len(path.nodes) - 1)
        path.here.children.append(shown)

    while at < size:
        m = _MARKUP.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            content(text, unescape(text))
        if not m:
            break
        at = m.end()
        if m["cdata"]:
            content(m["cdata"], m["cdata"])
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            place = path.nearest((name,))
            stop = 0 if name in _TABLE | _APART | {"body", "html"} else path.nearest(("td", "th", "table"))
            stop = max(stop, 0 if name in ("body", "html") else path.nearest(_APART))
            if place and place >= stop:
                path.cut(place)
            elif name == "p":
                path.here.children.append(Node("p", {}, path.here))
            continue
        if path.here.name == "head" and name not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            path.cut(len(path.nodes) - 1)
        if name in _BREAKOUT:
            while path.here.foreign and path.here.name not in _INTEGRATION[path.here.foreign]:
                path.cut(len(path.nodes) - 1)
        if name in ("select", "input", "textarea", "keygen"):
            choice = path.above(("select",))
            if choice:
                path.cut(choice)
                if name == "select":  # ends the one that is open
                    continue
        if path.here.name == "colgroup" and name not in ("col", "template"):
            path.cut(len(path.nodes) - 1)
        holder = path.above(_HOLDERS[name]) if name in _HOLDERS else 0
        if holder:
            if not (name == "col" and path.here.name == "colgroup"):
                path.cut(holder + 1)
            if name in ("td", "th", "tr") and path.here.name == "table":
                inside("tbody")
            if name in ("td", "th") and path.here.name != "tr":
                inside("tr")
        elif name == "table":
            outer = path.above(_TABLE | {"td", "th", "caption"})
            around = path.above(("table",))
            if outer and around and path.nodes[outer].name in _TABLE:  # a table between cells ends the one around it
                path.cut(around)
        elif name in _CLOSES:
            while path.close(*_CLOSES[name]):
                pass
        if name in _CLOSES_P:
            path.close(("p",), _P_BARRIER)
        here = path.here
        if name[0] == "h" and name[1:].isdigit() and here.name[0] == "h" and here.name[1:].isdigit():
            path.cut(len(path.nodes) - 1)
        here = path.here
        node = Node(name, _attributes(m["attrs"]) if m["attrs"].strip() else {}, here)
        here.children.append(node)
        if node.foreign and m["attrs"] and m.end("slash") == m.end("attrs"):
            pass
        elif name in _RAW:
            end = None if name == "plaintext" or name in endless else re.compile(rf"</{name}(?=[ \t\n\f\r/>]){_ATTRIBUTES}>?", re.IGNORECASE).search(html, at)
            if not end:
                endless.add(name)
            inner = html[at : end.start() if end else size]
            if inner:
                node.children.append(unescape(inner) if name in ("textarea", "title") else inner)
            at = end.end() if end else size
        elif name == "form" and here.name in _TABLE:  # holds nothing there
            pass
        elif name not in _VOID:
            path.push(node)
    return path.nodes[0]


def visible(node: Node) -> bool:
    attrs = node.attrs
    if node.name in _HIDDEN or node.foreign and node.name in _HIDDEN_FOREIGN[node.foreign]:
        return False
    if not attrs:
        return True
    if "hidden" in attrs or (node.name == "input" and attrs.get("type", "").lower() == "hidden"):
        return False
    return not ("style" in attrs and _UNSEEN_STYLE.search(attrs["style"])) and not (node.name == "dialog" and "open" not in attrs)


def width(text: str) -> int:
    """Columns that a text takes: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _choices(select: Node) -> list[Node | str]:
    """What a select shows: all of a list's options and group labels, else the chosen or first option."""
    every, stack = [], [(select, False)]
    while stack:
        node, off = stack.pop()
        if node.name == "option":
            every.append((node, off or "disabled" in node.attrs))
        elif node.name == "optgroup":
            every.append((node, True))
        if node.name != "option":
            stack.extend((c, off or node.name == "optgroup" and "disabled" in node.attrs) for c in reversed(node.children) if isinstance(c, Node))
    size = select.attrs.get("size", "").strip()
    if "multiple" in select.attrs or size.isdecimal() and int(size) > 1:
        shown = [node for node, _ in every if visible(node) and (node.parent is select or visible(node.parent))]
    else:
        options = [(node, off) for node, off in every if node.name == "option"]
        chosen = [node for node, _ in options if "selected" in node.attrs]
        shown = chosen[-1:] or [node for node, off in options if not off][:1] or [node for node, _ in options[:1]]
    out: list[Node | str] = []
    for node in shown:
        label = node.attrs.get("label", "")
        parts = [label] if label.strip() else node.children if node.name == "option" else []
        line = Node("div" if len(shown) > 1 else "span", {}, select)
        line.children.extend(parts)
        out.append(line)
    return out


class _Canvas:
    """Lines of text: inline text flows, blocks break lines, gaps of blank lines collapse."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0
        self.indents = [""]
        self.mark: str | None = None

    def inline(self, text: str) -> None:
        words = _SPACES.sub(" ", text)
        if words[:1] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = words[-1] == " "
        self.parts.append(words[:-1] if self.space else words)

    def flush(self) -> None:
        if self.parts:
            self.put("".join(self.parts))
        self.parts, self.space = [], False

    def put(self, line: str) -> None:
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        indent = self.indents[-1] if self.mark is None else self.mark
        self.mark = None
        self.lines.append((indent + line).rstrip())

    def indent(self, blanks: int, mark: str | None = None) -> None:
        """Indent what follows, the first line by a mark."""
        before = self.indents[-1]
        if mark is not None:
            self.mark = before + mark
        self.indents.append(before + " " * min(blanks, _INDENT - len(before)))

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def text(self) -> str:
        self.flush()
        return "\n".join(self.lines)


def _table_parts(table: Node) -> tuple[list[tuple[Node, list[Node]]], list[Node]]:
    """The table's own rows as (row group, visible cells), head first and foot last, and runs of what stands outside its cells."""
    rows, parts = [], {"thead": [], "tbody": [], "tfoot": []}
    runs, joined = [], False
    stack = [(child, table, "tbody") for child in reversed(table.children)]
    while stack:
        node, parent, part = stack.pop()
        if isinstance(node, Node) and (node.name in ("caption", "colgroup", "col") and parent is table or node.name in ("td", "th") and parent.name == "tr"):
            joined = False
        elif isinstance(node, Node) and (node.name == "tr" or node.name in parts and parent is table):
            joined = False
            if visible(node):
                if node.name == "tr":
                    parts[part].append((parent, [c for c in node.children if isinstance(c, Node) and c.name in ("td", "th") and visible(c)]))
                stack.extend((child, node, node.name if node.name in parts else part) for child in reversed(node.children))
        elif joined or not isinstance(node, str) or node.strip():
            if not joined:
                runs.append(Node("div", {}, table))
            runs[-1].children.append(node)
            joined = True
    for part in parts.values():
        rows += part
    return rows, runs


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "1").strip()
    return min(most, int(value)) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def _grid(rows: list[tuple[Node, list[Node]]]) -> list[list[tuple[int, int, Node]]]:
    """Each row's cells as (first column, columns, cell), beside the cells that reach down from rows above."""
    until: list[int] = []  # the row from which a column is free again
    ends, out = {}, []
    for k, (group, _) in enumerate(rows):
        ends[id(group)] = k + 1
    group = None
    for k, (own, cells) in enumerate(rows):
        if own is not group:
            until, group = [], own
        place, row = 0, []
        for cell in cells:
            while place < len(until) and until[place] > k:
                place += 1
            across = max(1, _span(cell, "colspan", 1000)) if place < _COLUMNS else 1
            down = _span(cell, "rowspan", 65534) if place < _COLUMNS else 1
            row.append((place, across, cell))
            if down != 1:
                reach = min(place + across, _COLUMNS)
                until += [0] * (reach - len(until))
                until[place:reach] = [min(k + down, ends[id(own)]) if down else ends[id(own)]] * (reach - place)
            place += across
        out.append(row)
    return out


def _table_lines(rows: list[list[tuple[int, int, list[str]]]], most: int) -> list[str]:
    """Cells as (first column, columns, lines), aligned in columns two blanks apart, in at most so many characters; else unaligned."""
    widths: list[int] = []
    sized = [[(place, span, lines, [width(line) for line in lines]) for place, span, lines in row] for row in rows]
    for row in sized:
        for place, span, _, own in row:
            widths += [0] * (place + span - len(widths))
            if span == 1:
                widths[place] = max(widths[place], max(own, default=0))
    for row in sized:  # what spans columns widens the last of them
        for place, span, _, own in row:
            lack = max(own, default=0) - sum(widths[place : place + span]) - 2 * (span - 1) if span > 1 else 0
            if lack > 0:
                widths[place + span - 1] += lack
    starts = [0, *accumulate(w + 2 for w in widths)]

    def laid(aligned: bool) -> Iterator[str]:
        for row in sized:
            open_ = row
            for k in range(max((len(lines) for _, _, lines, _ in row), default=0)):
                open_ = [cell for cell in open_ if len(cell[2]) > k]
                parts, at = [], 0
                for place, _, lines, own in open_:
                    if lines[k]:
                        gap = starts[place] - at if aligned else 2 * bool(parts)
                        parts += [" " * gap, lines[k]]
                        at += gap + own[k]
                yield "".join(parts).rstrip()

    out, used = [], 0
    for line in laid(True):
        used += len(line)
        if used > most:
            return list(laid(False))
        out.append(line)
    return out


def render(root: Node) -> str:
    """The visible text below a node, laid out."""
    # tables are rendered inside out, so that nested ones are lines of their cell
    tables: dict[int, list[str]] = {}
    order: list[tuple[Node, int]] = []  # tables, and the place in here of the one around each
    room: list[int] = []  # characters that a table's aligned lines may take
    depth: list[int] = []
    stack = [(root, -1)]
    while stack:
        node, around = stack.pop()
        if node is not root and not visible(node):
            continue
        if node.name == "table" and (around < 0 or depth[around] < _NESTED):
            order.append((node, around))
            room.append(0)
            depth.append(depth[around] + 1 if around >= 0 else 0)
            around = len(order) - 1
        if around >= 0:
            room[around] += _PER_CELL * (node.name in ("td", "th")) + _PER_CHAR * sum(len(c) for c in node.children if isinstance(c, str))
        stack.extend((c, around) for c in _shown(node) if isinstance(c, Node))
    for k in range(len(order) - 1, -1, -1):
        table, around = order[k]
        rows = [[(place, span, _walk(cell, tables).split("\n")) for place, span, cell in row] for row in _grid(_table_parts(table)[0])]
        tables[id(table)] = _table_lines(rows, room[k])
        if around >= 0:
            room[around] += room[k]
    return _walk(root, tables)


def _shown(node: Node) -> list[Node | str]:
    """The children of an element that may be seen."""
    children = node.children
    if node.name == "details" and "open" not in node.attrs:
        children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
    return [c for c in children if isinstance(c, Node)] if node.veiled else children


def _whole(text: str | None, other: int) -> int:
    return int(text) if text is not None and re.fullmatch(r"\s*[-+]?[0-9]{1,9}\s*", text) else other


def _numbering(node: Node) -> list[int] | None:
    """An ordered list's first number and step."""
    if node.name != "ol":
        return None
    if "reversed" not in node.attrs:
        return [_whole(node.attrs.get("start"), 1), 1]
    return [_whole(node.attrs.get("start"), sum(isinstance(c, Node) and c.name == "li" and visible(c) for c in node.children)), -1]


def _walk(root: Node, tables: dict[int, list[str]]) -> str:
    canvas, numbers = _Canvas(), []
    todo: list[tuple[str, Node | str]] = [("open", child) for child in reversed(_shown(root))]
    pre = 0
    while todo:
        step, node = todo.pop()
        if isinstance(node, str):
            if pre:
                first, *rest = node.split("\n")
                canvas.parts.append(first)
                for line in rest:
                    canvas.put("".join(canvas.parts))
                    canvas.parts = [line]
            else:
                canvas.inline(node)
            continue
        name = node.name
        if step == "space":
            canvas.space = True
            continue
        if step == "close":
            canvas.block(0 if len(canvas.indents) > 1 and name in ("ul", "ol", "menu") and len(numbers) > 1 else int(name in _PARAGRAPH))
            if name in ("ul", "ol", "menu"):
                numbers.pop()
            elif name in ("li", "blockquote", "dd"):
                canvas.indents.pop()
                canvas.mark = None
            elif name == "pre":
                pre -= 1
            continue
        if not visible(node):
            continue
        if name == "br":
            canvas.flush() if canvas.parts else canvas.put("")
            continue
        if name == "wbr":
            continue
        if name == "img":
            if node.attrs.get("alt", "").strip() and not node.veiled:
                canvas.inline(node.attrs["alt"])
            continue
        if name == "input":
            if node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text") and node.attrs.get("value") and not node.veiled:
                canvas.space = True
                canvas.inline(node.attrs["value"])
                canvas.space = True
            continue
        if name == "hr":
            canvas.block(1)
            continue
        if name == "table" and id(node) in tables:
            canvas.block(1)
            for caption in node.children:
                if isinstance(caption, Node) and caption.name == "caption" and visible(caption):
                    for line in _walk(caption, tables).split("\n"):
                        canvas.put(line)
            for line in tables[id(node)]:
                canvas.put(line)
            canvas.block(1)
            todo.extend(("open", run) for run in reversed(_table_parts(node)[1]))
            continue
        if name in _SPACED[node.foreign] or node.foreign and node.parent.name == "mfrac":
            canvas.space = True
            todo.append(("space", node))
        if name == "select" and node.veiled:
            continue
        if name == "select" and not node.foreign:
            todo.extend(("open", choice) for choice in reversed(_choices(node)))
            continue
        if name in _BLOCK and not node.foreign:
            nested = name in ("ul", "ol", "menu") and numbers
            canvas.block(0 if nested else int(name in _PARAGRAPH))
            if name in ("ul", "ol", "menu"):
                numbers.append(_numbering(node))
            elif name == "li":
                mark, number = "- ", numbers[-1] if numbers else None
                if number is not None:
                    number[0] = _whole(node.attrs.get("value"), number[0])
                    mark = f"{number[0]}. "
                    number[0] += number[1]
                canvas.indent(len(mark), None if node.veiled else mark)
            elif name in ("blockquote", "dd"):
                canvas.indent(2)
            elif name == "pre":
                pre += 1
            todo.append(("close", node))
        todo.extend(("open", child) for child in reversed(_shown(node)))
    return canvas.text()


def html_to_text(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract(df: DataFrame, html: str = "html", output: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the rendered text of each whole page; columns named in ``keep``, or all, are carried."""
    fields = [f for f in df.schema.fields if f.name != output and (keep is None or f.name in keep)]
    names = [f.name for f in fields]
    schema = StructType(fields + [StructField(output, StringType())])
    carried = names if html in names else [*names, html]

    def run(batches):
        for batch in batches:
            pages = column(batch, html)
            for start in range(0, len(pages), 256):
                texts = pa.array([html_to_text(x) for x in pages.slice(start, 256).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([column(batch, name).slice(start, 256) for name in names] + [texts], [*names, output])

    return df.select(*[F.col(f"`{x}`") for x in carried]).mapInArrow(run, schema)
