"""Visible text of web pages, laid out: blocks, lists and table cells keep their places.

A tree is built from the tags with the implied ones (``<p>`` ends before a block, ``<li>`` before the
next, cells get a row, ``<head>`` ends before content, unknown ends are dropped), then rendered by
visibility and layout rules.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.styles import Styles, inline_display, on_screen

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(\w+)", re.I)

# Browsers flatten what is nested more deeply, too.
DEPTH = 256
# Columns are padded up to this width; longer cells push what follows to the right.
CELL_WIDTH = 60

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HEAD = frozenset("title meta link script style base template noscript".split())
_HIDDEN = frozenset(
    "head script style template title noscript datalist audio video canvas iframe noembed noframes object".split()
)
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu pre blockquote table figure hr xmp fieldset".split())
_PLAIN = frozenset(
    "html body div section article aside nav header footer main address form li dt dd details summary figcaption "
    "center dialog hgroup search legend caption tr tbody thead tfoot td th option optgroup select".split()
)
_BLOCKS = _SPACED | _PLAIN
_ENDS_P = (_BLOCKS - frozenset("html body option optgroup select tr tbody thead tfoot td th caption".split())) | {"center"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol menu".split())
_CELLS = frozenset(["td", "th"])
_TABLE = frozenset(["table"])
_IN_TABLE = frozenset("table caption tbody thead tfoot tr td th".split())
# HTML within drawings and formulas.
_INSETS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
_SCOPE = frozenset("td th table caption button object template html".split()) | _INSETS
# Start tags that end a drawing or formula left open.
_BREAKS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
# Elements whose children a drawing shows; strings only below text.
_DRAWN = frozenset("svg g a switch text tspan textpath".split())
_TOKENS = frozenset("mi mo mn ms mtext".split())
_NO_FORMULA = frozenset("annotation annotation-xml mphantom".split())
_APART = frozenset("mfrac mtable mtr mlabeledtr".split())
# Start tags that end others: (what they end, where the search stops).
_ENDS = {
    "li": (frozenset(["li"]), _LISTS | _SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _SCOPE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"]) | _SCOPE),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"]) | _SCOPE),
    "tr": (_CELLS | {"tr", "caption"}, _TABLE),
    "td": (_CELLS | {"caption"}, frozenset(["table", "tr"])),
    "th": (_CELLS | {"caption"}, frozenset(["table", "tr"])),
    "tbody": (_CELLS | {"tr", "tbody", "thead", "tfoot", "caption"}, _TABLE),
    "thead": (_CELLS | {"tr", "tbody", "thead", "tfoot", "caption"}, _TABLE),
    "tfoot": (_CELLS | {"tr", "tbody", "thead", "tfoot", "caption"}, _TABLE),
}


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("tag", "attributes", "children", "display")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []
        # (important, display) that style sheets give it.
        self.display: tuple[bool, str] | None = None

    def get(self, name: str) -> str | None:
        """Value of an attribute, empty if it has none, None if it is absent."""
        if name not in self.attributes.lower():
            return None
        for key, *values in _ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape("".join(values))
        return None


def _closed(attributes: str) -> bool:
    """Whether a tag ends itself; a slash that ends a value without quotes does not."""
    before = attributes[:-1]
    return attributes.endswith("/") and (before[-1:] in "\"' \t\n\r\f/" or "=" not in before.split()[-1])


class Tree:
    """Builds the tree of one page; ``style`` collects style sheets."""

    def __init__(self, page: str):
        self.root, self.body = Node("html"), Node("body")
        self.open = [self.root]
        self.counts: Counter[str] = Counter()
        self.style: list[str] = []
        at = 0
        find = _TAG.search
        while m := find(page, at):
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                if page.startswith("<![CDATA[", m.start()) and self.foreign():
                    end = page.find("]]>", m.start())
                    self.open[-1].children.append(page[m.start() + 9 : end if end >= 0 else len(page)])
                    at = end + 3 if end >= 0 else len(page)
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self.end(tag)
                continue
            attributes = m[3] if m[2] else m[6]
            foreign = self.foreign()
            if foreign and tag in _BREAKS:
                while self.foreign():
                    self.pop()
            elif (foreign or tag in ("svg", "math")) and _closed(attributes):
                self.open[-1].children.append(Node(tag, attributes))
                continue
            node = self.start(tag, attributes)
            if tag in _RAW:
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                raw = page[at : close.start()] if close else page[at:]
                # Browsers that run scripts and apply templates later do not read these sheets.
                if tag == "style" and not self.counts["noscript"] > 0 and not self.counts["template"] > 0:
                    if on_screen(node.get("media") or "") and (node.get("type") or "text/css").strip().lower() == "text/css":
                        self.style.append(raw)
                node.children.append(raw if tag == "xmp" else html.unescape(raw))
                at = close.end() if close else len(page)
                if self.open[-1] is node:
                    self.pop()
        if at < len(page):
            self.text(page[at:])

    def pop(self) -> Node:
        node = self.open.pop()
        self.counts[node.tag] -= 1
        return node

    def foreign(self) -> bool:
        """Whether the open element belongs to a drawing or formula, not to HTML within."""
        if not (self.counts["svg"] > 0 or self.counts["math"] > 0):
            return False
        for node in reversed(self.open):
            if node.tag in ("svg", "math"):
                return True
            if node.tag in _INSETS:
                return False
        return False

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        if node.tag not in _VOID and len(self.open) < DEPTH:
            self.open.append(node)
            self.counts[node.tag] += 1

    def close(self, ends: frozenset[str], stops: frozenset[str]) -> None:
        """End every open element of ``ends`` above the nearest of ``stops``."""
        if not any(self.counts[t] > 0 for t in ends):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stops:
                break
            if self.open[i].tag in ends:
                while len(self.open) > i:
                    self.pop()

    def text(self, data: str) -> None:
        if self.counts["head"] > 0 and self.open[-1].tag == "head" and not data.isspace():
            self.pop()
        self.open[-1].children.append(html.unescape(data) if "&" in data else data)

    def start(self, tag: str, attributes: str) -> Node:
        if tag in ("html", "body"):
            # Their attributes hold for the whole page.
            self.close(frozenset(["head"]), frozenset())
            kept = self.root if tag == "html" else self.body
            kept.attributes = kept.attributes or attributes
            return Node(tag)
        if self.counts["head"] > 0 and tag not in _HEAD and self.open[-1].tag == "head":
            self.pop()
        if tag in _ENDS_P:
            self.close(frozenset(["p"]), _SCOPE)
        if tag in _HEADINGS and self.open[-1].tag in _HEADINGS:
            self.pop()
        if tag in _ENDS:
            self.close(*_ENDS[tag])
        if tag in _CELLS and self.counts["table"] > 0 and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.push(Node("tr"))
        node = Node(tag, attributes)
        self.push(node)
        return node

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif self.counts[tag] > 0:
            stops = _TABLE - {tag} if tag in _IN_TABLE else _SCOPE - {tag}
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    while len(self.open) > i:
                        self.pop()
                    break
                if self.open[i].tag in stops:
                    break
        elif tag == "p":
            self.open[-1].children.append(Node("p"))


class Flow:
    """Lines of text; white space collapses, blocks are set apart by blank lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.gap = 0

    def text(self, data: str) -> None:
        data = _BLANKS.sub(" ", data)
        if data == " ":
            self.blank = True
            return
        if not data:
            return
        if self.line and (self.blank or data[0] == " "):
            self.line.append(" ")
        self.blank = data[-1] == " "
        self.line.append(data.strip(" "))

    def preformatted(self, data: str) -> None:
        first, *rest = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line.append(first)
        for line in rest:
            self.newline()
            self.line.append(line)
        self.blank = False

    def newline(self) -> None:
        """End the current line, empty ones too."""
        self.add([("".join(self.line))])
        self.line, self.blank = [], False

    def block(self, gap: int) -> None:
        """End the current line if it has text; at least ``gap`` blank lines follow."""
        if self.line:
            self.newline()
        self.blank = False
        self.gap = max(self.gap, gap)

    def add(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.extend(line.replace("\xa0", " ").rstrip() for line in lines)

    def done(self) -> list[str]:
        self.block(0)
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


class Renderer:
    def __init__(self, tree: Tree):
        self.lists = 0
        Styles(tree.style).decide(tree.root, tree.body, _HEAD | {"head"})

    def hidden(self, node: Node) -> bool:
        if node.tag in _HIDDEN:
            return True
        ruled, attributes = node.display, node.attributes
        if attributes and (style := node.get("style")) and (own := inline_display(style)):
            # The element's own style gives way to important rules only.
            ruled = ruled if ruled and ruled[0] and not own[0] else own
        if ruled and ruled[1] != "revert":
            return ruled[1] == "none"
        if attributes and node.get("hidden") is not None:
            return True
        return node.tag == "dialog" and node.get("open") is None

    def render(self, node: Node, flow: Flow, shown: bool = True, raw: bool = False) -> None:
        """Add what is visible below ``node`` to ``flow``."""
        tag = node.tag
        if tag != "html" and self.hidden(node):
            return
        shown = self.visible(node, shown)
        if tag == "br":
            flow.newline()
            return
        if tag in ("svg", "math"):
            self.drawing(node, flow, shown) if tag == "svg" else self.formula(node, flow, shown)
            return
        gap = 1 if tag in _SPACED and not (tag in _LISTS and self.lists) else 0
        if tag in _BLOCKS:
            flow.block(gap)
        if tag == "table":
            flow.add(self.table(node, flow, shown)) if shown else None
        elif tag in _LISTS:
            self.lists += 1
            self.items(node, flow, shown)
            self.lists -= 1
        else:
            raw = raw or tag in ("pre", "textarea", "xmp")
            closed = tag == "details" and node.get("open") is None
            for child in node.children:
                if not isinstance(child, str):
                    if not closed or child.tag == "summary":
                        self.render(child, flow, shown, raw)
                elif shown and not closed:
                    flow.preformatted(child) if raw else flow.text(child)
        if tag in _BLOCKS:
            flow.block(gap)

    def visible(self, node: Node, shown: bool) -> bool:
        if node.attributes and (style := node.get("style")) and (m := _VISIBILITY.search(style)):
            return m[1].lower() == "visible"
        return shown

    def drawing(self, node: Node, flow: Flow, shown: bool, text: bool = False) -> None:
        """The words of an SVG drawing, set apart where they are placed apart."""
        if (node.get("display") or "").strip().lower() == "none" and not node.display:
            return
        shown = (node.get("visibility") or "visible").strip().lower() == "visible" if node.get("visibility") else shown
        for child in node.children:
            if isinstance(child, str):
                if text and shown:
                    flow.text(child)
                continue
            if child.tag == "foreignobject":
                flow.blank = True
                self.render(child, flow, shown)
                flow.blank = True
            elif child.tag in _DRAWN and not self.hidden(child):
                flow.blank = flow.blank or child.tag == "text"
                self.drawing(child, flow, self.visible(child, shown), text or child.tag == "text")
                flow.blank = flow.blank or child.tag == "text"
            if node.tag == "switch":
                break

    def formula(self, node: Node, flow: Flow, shown: bool) -> None:
        """The symbols of a formula in order; parts that stand above or beside each other are set apart."""
        block = node.tag == "math" and (node.get("display") or "").lower() == "block"
        if block:
            flow.block(0)
        later = False
        for child in node.children:
            if isinstance(child, str):
                if shown and (data := child.strip(" \t\n\r\f")):
                    flow.text(data)
            elif child.tag not in _NO_FORMULA and not self.hidden(child):
                flow.blank = flow.blank or (later and node.tag in _APART)
                later = True
                if node.tag in _TOKENS:
                    self.render(child, flow, shown)
                else:
                    self.formula(child, flow, self.visible(child, shown))
        if block:
            flow.block(0)

    def items(self, node: Node, flow: Flow, shown: bool) -> None:
        number = node.get("start") or "1"
        number = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1
        for child in node.children:
            if isinstance(child, str):
                if shown:
                    flow.text(child)
                continue
            if child.tag != "li":
                self.render(child, flow, shown)
                continue
            if self.hidden(child):
                continue
            value = child.get("value") or ""
            number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
            marker = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            inner = Flow()
            for part in child.children:
                if not isinstance(part, str):
                    self.render(part, inner, shown)
                elif shown:
                    inner.text(part)
            flow.block(0)
            if lines := inner.done():
                pad = " " * len(marker)
                flow.add([marker + lines[0], *(pad + line if line else "" for line in lines[1:])])

    def rows(self, node: Node, outside: Flow, shown: bool) -> Iterator[Node]:
        """Rows of a table in order; captions and what stands outside of rows goes before the table."""
        for child in node.children:
            if isinstance(child, str):
                if shown:
                    outside.text(child)
            elif child.tag in ("tbody", "thead", "tfoot"):
                if not self.hidden(child):
                    yield from self.rows(child, outside, shown)
            elif child.tag == "tr":
                if not self.hidden(child):
                    yield child
            elif child.tag != "col":
                self.render(child, outside, shown)

    def table(self, node: Node, outside: Flow, shown: bool) -> list[str]:
        grid: list[list[list[str]]] = []
        for row in self.rows(node, outside, shown):
            cells: list[list[str]] = []
            for child in row.children:
                if isinstance(child, str):
                    outside.text(child)
                elif child.tag not in _CELLS:
                    self.render(child, outside, shown)
                elif not self.hidden(child):
                    flow = Flow()
                    for part in child.children:
                        flow.text(part) if isinstance(part, str) else self.render(part, flow, shown)
                    cells.append(flow.done())
                    span = child.get("colspan") or "1"
                    cells.extend([[]] * (min(int(span), 100) - 1 if re.fullmatch(r"\d{1,4}", span) else 0))
            grid.append(cells)
        outside.block(1)
        widths = [0] * max(map(len, grid), default=0)
        for cells in grid:
            for i, cell in enumerate(cells):
                widths[i] = max([widths[i], *(len(line) for line in cell if len(line) <= CELL_WIDTH)])
        lines = []
        for cells in grid:
            for k in range(max(map(len, cells), default=0)):
                parts = [(cell[k] if k < len(cell) else "").ljust(widths[i]) for i, cell in enumerate(cells)]
                lines.append("  ".join(parts))
        return lines


def visible_text(page: str) -> str:
    """The text a reader sees, in lines."""
    tree = Tree(page.replace("\x00", ""))
    flow = Flow()
    Renderer(tree).render(tree.root, flow)
    return "\n".join(flow.done())


def extract_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Visible text of every whole page: (id, text, n_chars).

    A narrow job. Null and empty pages have empty texts; broken markup is repaired as the tree builder
    does and never fails; elements nested more deeply than ``DEPTH`` are flattened; repeated rows give
    repeated results; other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(page) if page else "" for page in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [id_column, "text", "n_chars"])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(F.col(f"`{id_column}`"), F.col(f"`{html_column}`").cast("string")).mapInArrow(
        run, f"`{id_column}` {kind}, text string, n_chars bigint"
    )
