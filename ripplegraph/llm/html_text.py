"""Visible text of HTML pages, laid out: a tree with implied tags, blocks, lists and tables."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import slices
from ripplegraph.llm.style_sheets import Styles, media_holds

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One step inside a tag: its end, or an attribute with its value, if any. A quote that is never closed is a name's first character.
_STEP = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?)")
_WHOLE = re.compile(r"\s*(-?[0-9]{1,9})(?![0-9])")
_SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist desc metadata defs symbol clippath annotation annotation-xml".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: Blocks with an empty line before and after them.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
#: An opening tag closes these if they are open, up to the barrier.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
}
_P_BARRIER = ("td", "th", "table", "button", "li", "caption", "object")
#: What rows and cells stand in, and what only stands in it.
_GROUPS = ("thead", "tbody", "tfoot")
_IN_TABLE = ("table", *_GROUPS, "tr")
_PARTS = (*_GROUPS, "tr", "td", "th", "caption", "colgroup", "col")
#: What elements hold that are nested deeper stands, block by block, in the one at this depth.
DEEPEST = 512
#: Columns that spans can take, and characters of a column that the ones after it are moved by.
COLUMNS, WIDEST = 1000, 100


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "depth")

    def __init__(self, tag: str, attributes: dict, parent: Node | None):
        self.tag, self.attributes, self.children, self.parent = tag, attributes, [], parent
        self.depth = 0 if parent is None else parent.depth + 1


class _Open:
    """Where the tree grows, and how often each tag is open above that place."""

    def __init__(self):
        self.at, self.count = Node("#root", {}, None), Counter()

    def enter(self, node: Node) -> None:
        self.at = node
        self.count[node.tag] += 1

    def leave(self, to: Node) -> None:
        while self.at is not to:
            self.count[self.at.tag] -= 1
            self.at = self.at.parent

    def close(self, tags: tuple, barrier: tuple) -> None:
        """Closes the outermost of the open tags below the barrier."""
        if any(self.count[t] for t in tags):
            self.leave(_close(self.at, tags, barrier))


def _close(node: Node, tags: tuple, barrier: tuple) -> Node:
    """Where to go on after closing the outermost of the open tags below the barrier."""
    found, at = node, node
    while at.parent is not None and at.tag not in barrier:
        if at.tag in tags:
            found = at.parent
        at = at.parent
    return found


def _attributes(html: str, pos: int) -> tuple[dict, int]:
    """The attributes of a tag from behind its name, and where it ends; without an end, -1."""
    found = {}
    while True:
        m = _STEP.match(html, pos)
        if m is None:
            return found, -1
        pos = m.end()
        if m[1]:
            return found, pos
        found.setdefault(m[2].lower(), unescape(m[3] or m[4] or m[5] or ""))


def parse(html: str) -> tuple[Node, list[str]]:
    """The tree, and the contents of style elements. Missing and misplaced end tags are made up for.

    One pass: what a tag that never ends holds is dropped with it, as in browsers.
    """
    tree, styles, pos, size = _Open(), [], 0, len(html)
    root, once = tree.at, set()
    while pos < size:
        start = html.find("<", pos)
        if start != pos:
            tree.at.children.append(unescape(html[pos : start if start >= 0 else size]))
        if start < 0:
            break
        ends = html.startswith("/", start + 1)
        name = _NAME.match(html, start + 1 + ends)
        if name is None:
            if html.startswith("<!--", start):
                empty = next((x for x in (">", "->") if html.startswith(x, start + 4)), None)
                pos = start + 4 + len(empty) if empty else html.find("-->", start + 4) + 3
                pos = pos if pos > start else size
            elif ends or html.startswith(("<!", "<?"), start):
                pos = html.find(">", start) + 1 or size
            else:
                tree.at.children.append("<")
                pos = start + 1
            continue
        attributes, pos = _attributes(html, name.end())
        if pos < 0:
            break
        tag = name[0].lower()
        if ends:
            _end(tree, tag)
            continue
        if tag in ("html", "body"):
            if tag in once:
                continue
            once.add(tag)
        if tag == "form" and tree.at.tag in _IN_TABLE:
            continue  # as in browsers, what follows stands in the table
        node = _start(tree, tag, attributes)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, pos)
            inside = html[pos : end.start() if end else size]
            node.children.append(unescape(inside) if tag in ("textarea", "title") else inside)
            if tag == "style" and media_holds(attributes.get("media", "")):
                styles.append(inside)
            pos = size if end is None else (html.find(">", end.start()) + 1 or size)
        elif tag not in VOID and html[pos - 2] != "/" and tree.at.depth < DEEPEST:
            tree.enter(node)
    return root, styles


def _end(tree: _Open, tag: str) -> None:
    """An end tag closes the nearest such element, but for one outside the cell it stands in."""
    if tree.count[tag]:
        up = tree.at
        while up is not None and up.tag != tag and not (up.tag in ("td", "th", "table") and (tag == "form" or (tag not in BLOCK and tag not in _CLOSES))):
            up = up.parent
        if up is not None and up.tag == tag:
            tree.leave(up.parent)
            return
    if tag in ("p", "br"):
        tree.at.children.append(Node(tag, {}, tree.at))


def _start(tree: _Open, tag: str, attributes: dict) -> Node:
    """A new element, after what it closes and in what it needs around it."""
    if tag in BLOCK:
        tree.close(("p",), _P_BARRIER)
    if tag in _PARTS and any(tree.count[t] for t in _IN_TABLE):
        up = tree.at  # a part of a table ends what strayed between its parts
        while up is not None and up.tag not in _IN_TABLE and up.tag not in ("td", "th", "caption"):
            up = up.parent
        if up is not None and up.tag in _IN_TABLE:
            tree.leave(up)
    if tag == "body" or (tag in BLOCK and tag != "html" and tree.at.tag == "head"):
        while tree.at.tag == "head":
            tree.leave(tree.at.parent)
    if tag in _CLOSES:
        tree.close(*_CLOSES[tag])
    if tag == "table" and tree.at.tag in _IN_TABLE:
        tree.close(("table",), ("td", "th", "caption"))
    if tag in ("td", "th") and tree.at.tag in ("table", *_GROUPS):
        row = Node("tr", {}, tree.at)
        tree.at.children.append(row)
        tree.enter(row)
    if tree.at.depth >= DEEPEST and tag not in RAW and tag not in VOID:
        tag, attributes = "div" if tag in BLOCK or tag in _PARTS else "span", {}
    node = Node(tag, attributes, tree.at)
    tree.at.children.append(node)
    return node


def _shown(node: Node, styles: Styles, inherited: bool) -> bool:
    """Whether a node's text is visible: by its own style, a style sheet, or as what it stands in."""
    value = styles.of(node, "visibility")
    return value == "visible" if value in ("visible", "hidden", "collapse") else inherited


def _visible(node: Node, styles: Styles) -> bool:
    """Whether a node and all below it take part in the layout.

    What sheets and styles say of ``display`` comes before what attributes do.
    """
    a = node.attributes
    if node.tag in UNSEEN or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    display = styles.of(node, "display") if styles.by or "style" in a else None
    if display is None and ("hidden" in a or (node.tag == "dialog" and "open" not in a)):
        return False
    up = node.parent
    return display != "none" and not (up is not None and up.tag == "details" and "open" not in up.attributes and node.tag != "summary")


class _Page:
    """Lines as they come: inline text runs on, blocks start anew, ``gap`` empty lines at most one.

    Two empty lines in a row are the most, but for those of preformatted text.
    """

    def __init__(self, shown: bool):
        self.lines, self.line, self.indent, self.mark, self.gap, self.pre, self.shown = [], [], [], "", 0, 0, shown

    def text(self, s: str) -> None:
        if not self.shown:
            return
        if self.pre:
            first, *rest = s.expandtabs(8).split("\n")
            self.line.append(first)
            for x in rest:
                self.end(keep=True, exact=True)
                self.line.append(x)
            return
        s = _SPACE.sub(" ", s)
        if not self.line or self.line[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.line.append(s)

    def end(self, keep: bool = False, exact: bool = False) -> None:
        """Ends the line, if it has text (or, to keep an empty one, in any case)."""
        s = "".join(self.line).rstrip(" ")
        self.line = []
        if s or keep:
            if not s and not exact and self.lines[-2:] == ["", ""]:
                return
            if self.gap and self.lines and (s or exact) and self.lines[-2:] != ["", ""]:
                self.lines.append("")
            lead = "".join(self.indent)
            if self.mark:
                lead, self.mark = lead[: len(lead) - len(self.mark)] + self.mark, ""
            self.lines.append((lead + s).rstrip(" "))
            self.gap = self.gap if not s and not exact else 0

    def space(self) -> None:
        self.end()
        self.gap = 1


def _rows(table: Node, styles: Styles) -> tuple[list[Node], list[tuple[Node, list[Node]]], list]:
    """Captions, the cells of each visible row with what the row stands in, and what strays between
    the parts, in order; tables inside cells are left to the cells."""
    captions, rows, strays, stack = [], [], [], [table]
    while stack:
        node = stack.pop()
        if not isinstance(node, Node) or node.tag not in ("table", *_PARTS) or (node.tag == "table" and node is not table):
            if isinstance(node, Node) or node.strip():
                strays.append(node)
        elif node.tag == "caption":
            captions.append(node)
        elif node is table or _visible(node, styles):
            if node.tag == "tr":
                rows.append((node.parent, [c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and _visible(c, styles)]))
            if node.tag in _IN_TABLE:
                stack += [c for c in reversed(node.children) if not (isinstance(c, Node) and (c.tag in ("td", "th") or not _visible(c, styles)))]
    return captions, rows, strays


def _span(cell: Node, name: str, most: int) -> int:
    """How many columns or rows a cell takes; zero rows are all that follow in its group."""
    span = _whole(cell, name, 1)
    return most if span == 0 and name == "rowspan" else max(1, min(most, span))


def _whole(node: Node, name: str, otherwise: int) -> int:
    """A whole number of at most nine digits; anything else counts as not given."""
    m = _WHOLE.match(node.attributes.get(name, ""))
    return int(m[1]) if m else otherwise


def _table(table: Node, styles: Styles, shown: bool) -> list[str]:
    """Cells of a column start at the same character; a cell that spans columns takes their width.

    A cell that spans rows has its text in the first, and keeps its columns free in the others.
    What is wider than WIDEST moves what follows in its own line alone.
    """
    captions, rows, strays = _rows(table, styles)
    lines = [x for c in captions for x in render(c, styles, _shown(c, styles, shown))]
    grid, widths, taken, group = [], [], {}, None
    for place, (inside, row) in enumerate(rows):
        if inside is not group:
            taken, group = {}, inside  # column: the first row where it is free again
        cells, column = [], 0
        for cell in row:
            while taken.get(column, 0) > place:
                column += 1
            span, down = _span(cell, "colspan", max(1, COLUMNS - column)), _span(cell, "rowspan", 65534)
            if down > 1:
                taken.update(dict.fromkeys(range(column, column + span), place + down))
            own = shown
            for node in _between(cell, table):
                own = _shown(node, styles, own)
            text = [x for x in render(cell, styles, own) if x] or [""]
            cells.append((column, span, text))
            widths += [0] * (column + span - len(widths))
            if span == 1:
                widths[column] = min(WIDEST, max(widths[column], *map(len, text)))
            column += span
        grid.append(cells)
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + (2 if w else 0))
    for cells in grid:
        for k in range(max((len(c[2]) for c in cells), default=0)):
            line, used = [], 0
            for column, _, text in cells:
                if k < len(text) and text[k]:
                    lead = " " * max(2 if used else 0, starts[column] - used)
                    line += [lead, text[k]]
                    used += len(lead) + len(text[k])
            lines.append("".join(line).rstrip(" "))
    if strays:  # what browsers move out of the table
        stray = Node("div", {}, None)
        stray.children = strays
        lines = [*render(stray, styles, shown), *lines]
    return lines


def _between(cell: Node, table: Node) -> list[Node]:
    """The nodes below the table down to the cell."""
    found, node = [], cell
    while node is not None and node is not table:
        found.append(node)
        node = node.parent
    return found[::-1]


def render(root: Node, styles: Styles, shown: bool = True) -> list[str]:
    """The lines of what is visible below a node. Walks without recursion, but for tables."""
    page, stack = _Page(shown), [(root, iter(root.children), None, shown)]
    while stack:
        node, children, undo, around = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if undo is not None:
                undo()
            page.shown = stack[-1][3] if stack else around
            continue
        if not isinstance(child, Node):
            if node.tag != "details" or "open" in node.attributes:
                page.text(child)
            continue
        tag = child.tag
        if not _visible(child, styles):
            continue
        inside = _shown(child, styles, around) if child.attributes or styles.by else around
        if tag == "br":
            page.end(keep=True)
        elif tag == "hr":
            page.space()
        elif tag == "img":
            continue  # a picture has no text of its own
        elif tag == "input":
            if inside and child.attributes.get("type", "text").lower() in ("button", "submit", "reset", "text", "search", "email", "url"):
                page.text(child.attributes.get("value", ""))
        elif tag == "table":
            page.space()
            for line in _table(child, styles, inside):
                page.line = [line]
                page.end(keep=True)
            page.space()
        else:
            page.shown = inside
            stack.append((child, iter(child.children), _enter(page, child), inside))
    page.end()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    while page.lines and not page.lines[0]:
        page.lines.pop(0)
    return page.lines


def _enter(page: _Page, node: Node):
    """Starts an element; gives what to do at its end."""
    tag = node.tag
    if tag not in BLOCK:
        if tag in ("td", "th", "option", "button", "tr", "text"):
            page.text(" ")
            return lambda: page.text(" ")
        return None
    lists = ("ul", "ol", "menu", "dir")
    nested = tag in lists and node.parent is not None and node.parent.tag in ("li", *lists)
    around = page.space if tag in SPACED and not nested else page.end
    around()
    indent = ""
    if tag == "li":
        page.mark = f"{_number(node)}. " if node.parent.tag == "ol" else "- "
        indent = " " * len(page.mark)
    elif tag in ("dd", "blockquote"):
        indent = "    " if tag == "dd" else "  "
    if indent:
        page.indent.append(indent)
    page.pre += tag == "pre"

    def leave() -> None:
        if tag == "pre" and page.line and not "".join(page.line).strip():
            page.line = []
        around()
        if indent:
            page.indent.pop()
        if tag == "li":
            page.mark = ""
        page.pre -= tag == "pre"

    return leave


def _number(node: Node) -> int:
    """An item's number: one more (or less) than the item before, or its own; remembered, as long lists ask for every one."""
    around = node.parent.attributes
    numbers = around.get("#numbers")
    if numbers is None or id(node) not in numbers:
        items = [c for c in node.parent.children if isinstance(c, Node) and c.tag == "li"]
        step = -1 if "reversed" in around else 1
        at, numbers = _whole(node.parent, "start", 1 if step > 0 else len(items)), {}
        for c in items:
            at = _whole(c, "value", at)
            numbers[id(c)] = at
            at += step
        around["#numbers"] = numbers
    return numbers[id(node)]


def visible_text(html: str) -> str:
    root, sheets = parse(html)
    return "\n".join(render(root, Styles(sheets)))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the visible text of every page, laid out in lines.

    Blocks start on a line of their own; paragraphs, headings, lists and tables have an empty
    line around them. List items have marks or numbers and are indented by depth; cells of a
    table's column start at the same character. Scripts, the head, and what attributes or style
    rules for single elements hide on a screen give no text, but for what is made visible again
    inside. Very long pages are read whole, in time in proportion to their length. Line breaks and
    empty blocks make two empty lines in a row at most. Null and empty pages give the empty
    text; tag soup and text without tags are read as a browser would. Repeated rows are read
    alike, other columns are ignored, and no rows give none.
    """

    def run(batches):
        for b in slices(batches):
            texts = [visible_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("h")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
