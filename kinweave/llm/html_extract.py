"""Layout-aware HTML rendering: all visible text of a page with its block structure.

A tree builder keeps the open elements, closes those that HTML closes by
implication (``<p>`` before a block, ``<li>`` before the next one, table cells, rows
and sections, ``<head>`` before content, everything at the end) and hides what is not
shown. Text is laid out as it is met:

* blocks start on a new line, paragraphs and headings have an empty line around them;
* white space collapses except in ``<pre>`` and ``<textarea>``; ``<br>`` breaks the line;
* list items get "- " or their number, nested lists are indented;
* table cells of a column are padded to the same width, two spaces apart; a cell with
  several lines makes its row taller, ``colspan`` leaves the columns it covers empty.

Hidden: head, script, style, template, noscript and the other elements of ``UNSEEN``,
elements with the ``hidden`` attribute or an inline ``display:none`` or
``visibility:hidden``, dialogs and the inside of details that are not open.

The parser never fails: unknown tags are inline, stray end tags are skipped, a tag or
comment without an end is text or runs to the end of the page. Null stays null, an empty
page is an empty text. Time and memory are linear in the page; nesting has no limit. Rows are
rendered one by one without a shuffle; repeated rows, empty tables and other columns
need no care.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.words import slices

MARKUP = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'<>]|"[^"]*"|'[^']*')*+)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CONCEALED = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
WHITE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript noembed noframes iframe object audio video canvas datalist svg math".split())
RAW = frozenset("script style title textarea noscript noembed noframes iframe template".split())
HEADERS = frozenset("base link meta noscript script style template title".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCKS = PARAGRAPHS | frozenset(
    "address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend "
    "li main menu nav option optgroup search section summary textarea caption".split())
#: An open element of the first kind ends when one of the second starts, unless a boundary lies between.
CLOSES = {
    "p": BLOCKS - {"html", "body", "option", "optgroup", "textarea", "legend"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "td": {"td", "th", "tr", "thead", "tbody", "tfoot"}, "th": {"td", "th", "tr", "thead", "tbody", "tfoot"},
    "tr": {"tr", "thead", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "tfoot": {"tbody"},
    "caption": {"tr", "td", "th", "thead", "tbody", "tfoot"},
}
ENDED_BY: dict[str, list[str]] = {}
for _open, _starts in CLOSES.items():
    for _start in _starts:
        ENDED_BY.setdefault(_start, []).append(_open)
#: Nothing outside of these is closed from within.
BOUNDARY = frozenset("table td th caption ul ol dl select".split())
CELLS = frozenset(("td", "th"))


class Flow:
    """Lines of one column of text: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False
        self.space = False
        self.indent = 0
        self.marker = ""

    def inline(self, text: str) -> None:
        pieces = WHITE.split(text)
        if len(pieces) > 1 and not pieces[0]:
            self.space = True
        words = [p for p in pieces if p]
        if words:
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(" ".join(words))
            self.space = not pieces[-1]

    def verbatim(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.parts.append(first)
        for line in rest:
            self.wrap(blank=True)
            self.parts.append(line)

    def wrap(self, blank: bool = False) -> None:
        """End the line; an empty one only counts if ``blank``."""
        line, self.parts, self.space = "".join(self.parts).rstrip(), [], False
        if line:
            self.put(line)
        elif blank and self.lines and not self.gap:
            self.lines.append("")

    def put(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        margin = self.indent - len(self.marker)
        self.lines.append(" " * max(margin, 0) + self.marker + line)
        self.marker = ""

    def block(self, apart: bool) -> None:
        self.wrap()
        self.gap |= apart and bool(self.lines)

    def done(self) -> list[str]:
        self.wrap()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Element:
    __slots__ = ("tag", "unseen", "flow", "rows", "count", "indent", "span")

    def __init__(self, tag: str, unseen: bool):
        self.tag, self.unseen = tag, unseen
        self.flow: Flow | None = None  # of a cell: the flow around it
        self.rows: list[list[tuple[list[str], int]]] | None = None  # of a table
        self.count = 1
        self.indent = 0
        self.span = 1


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Lines of a table: a column is as wide as its widest single cell."""
    width: list[int] = []
    for row in rows:
        at = 0
        for lines, span in row:
            width += [0] * (at + span - len(width))
            if span == 1:
                width[at] = max(width[at], max(map(len, lines), default=0))
            at += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            at, parts = 0, []
            for lines, span in row:
                room = sum(width[at:at + span]) + 2 * (span - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(room))
                at += span
            out.append("  ".join(parts).rstrip())
    return out


class Builder:
    def __init__(self):
        self.flow = Flow()
        self.open: list[Element] = []
        self.scopes: list[Counter] = [Counter()]  # open tags since the last boundary
        self.all = Counter()
        self.unseen = 0
        self.verbatim = 0

    # ---- elements ----

    def start(self, tag: str, attributes: str) -> None:
        if self.all["head"] and tag not in HEADERS and tag not in ("html", "head"):
            self.close("head")
        for other in ENDED_BY.get(tag, ()):
            while self.scope(other, tag)[other]:
                self.close(other)
        if tag in ("td", "th") and not self.all["table"]:
            tag = "div"
        elif tag in CELLS and not self.scope("tr", tag)["tr"]:
            self.push("tr", "")
        if tag == "br":
            if not self.unseen:
                self.flow.wrap(blank=True)
            return
        if tag == "hr" and not self.unseen:
            self.flow.block(True)
        if tag not in VOID:
            self.push(tag, attributes)

    def scope(self, tag: str, by: str) -> Counter:
        """Open tags that ``by`` may close: cells are boundaries themselves and close from the scope around their inside."""
        if tag in BOUNDARY and len(self.scopes) > 1:
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag in BOUNDARY), None)
            return Counter({tag: int(at is not None and self.open[at].tag == tag)})
        return self.scopes[-1]

    def push(self, tag: str, attributes: str) -> None:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
        parent = self.open[-1] if self.open else None
        unseen = (
            tag in UNSEEN or "hidden" in found or bool(CONCEALED.search(found.get("style", "")))
            or tag == "dialog" and "open" not in found
            or parent is not None and parent.tag == "details" and parent.count == 0 and tag != "summary"
        )
        element = Element(tag, unseen)
        if tag == "details":
            element.count = int("open" in found)
        if tag == "ol" and re.fullmatch(r"-?\d{1,9}", found.get("start", "")):
            element.count = int(found["start"])
        self.open.append(element)
        self.all[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in BOUNDARY:
            self.scopes.append(Counter())
        self.unseen += unseen
        if self.unseen:
            return
        if tag in ("pre", "textarea"):
            self.verbatim += 1
        if tag in BLOCKS:
            self.flow.block(tag in PARAGRAPHS and not (tag in ("ul", "ol") and self.all["li"]))
        element.indent = self.flow.indent
        if tag == "li":
            self.mark_item(element)
        elif tag in ("dd", "blockquote"):
            self.flow.indent += 2
        elif tag == "table":
            element.rows = []
        elif tag == "tr":
            if (table := self.table()) is not None:
                table.rows.append([])
        elif tag in CELLS:
            if (table := self.table()) is not None:
                span = found.get("colspan", "1")
                element.span = min(max(int(span), 1), 1000) if re.fullmatch(r"\d{1,9}", span) else 1
                element.flow, self.flow = self.flow, Flow()

    def mark_item(self, element: Element) -> None:
        group = next((e for e in reversed(self.open[:-1][-4:]) if e.tag in ("ul", "ol", "menu")), None)
        marker = "- "
        if group is not None and group.tag == "ol":
            marker = f"{group.count}. "
            group.count += 1
        self.flow.indent += len(marker)
        self.flow.marker = marker

    def table(self) -> Element | None:
        return next((e for e in reversed(self.open) if e.rows is not None), None) if self.all["table"] else None

    def close(self, tag: str) -> None:
        while self.open:
            if self.pop().tag == tag:
                return

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p" and not self.scopes[-1]["p"]:
            if not self.unseen:
                self.flow.block(True)
        elif tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "table") or tag in BOUNDARY:
            if self.all[tag]:
                self.close(tag)
        elif self.scopes[-1][tag]:
            self.close(tag)
        elif tag in ("body", "html", "div", "article", "section", "main", "form") and self.all[tag] and not self.all["table"]:
            self.close(tag)

    def pop(self) -> Element:
        element = self.open.pop()
        tag = element.tag
        if tag in BOUNDARY:
            self.scopes.pop()
        self.scopes[-1][tag] -= 1
        self.all[tag] -= 1
        if self.unseen:
            self.unseen -= element.unseen
            return element
        if tag in ("pre", "textarea"):
            self.verbatim -= 1
        if element.flow is not None:
            lines, self.flow = self.flow.done(), element.flow
            table = self.table()
            table.rows[-1].append((lines, element.span))
        elif element.rows is not None:
            self.flow.block(True)
            for line in aligned(element.rows):
                if line:
                    self.flow.put(line)
            self.flow.block(True)
        elif tag in BLOCKS:
            self.flow.block(tag in PARAGRAPHS and not (tag in ("ul", "ol") and self.all["li"]))
            if tag == "li":
                if self.flow.marker:  # an item without text still has its marker
                    self.flow.put("")
                    self.flow.lines[-1] = self.flow.lines[-1].rstrip()
                self.flow.marker = ""
        if tag in ("li", "dd", "blockquote"):
            self.flow.indent = element.indent
        return element

    def text(self, text: str) -> None:
        if self.unseen or not text:
            return
        blank = not text.strip(" \t\n\r\f")
        top = self.open[-1].tag if self.open else ""
        if top == "details" and not self.open[-1].count:
            return
        if blank and top in ("table", "tr", "thead", "tbody", "tfoot", "ul", "ol", "dl"):
            return
        text = html.unescape(text).replace("\xa0", " ")
        if self.verbatim:
            self.flow.verbatim(text)
        else:
            self.flow.inline(text)


def render(page: str) -> str:
    """The visible text of a page."""
    builder, at = Builder(), 0
    lowered = None
    while m := MARKUP.match(page, at):
        at = m.end()
        if not m[2]:
            token = m[0]
            if not token.startswith(("<!", "<?")):
                builder.text(token)
            continue
        tag = m[2].lower()
        if m[1]:
            builder.end(tag)
            continue
        builder.start(tag, m[3])
        if tag in RAW and builder.open and builder.open[-1].tag == tag:
            if lowered is None:  # the end tag may be in any case; ASCII only, so that places stay
                lowered = page.translate(_SMALL)
            end = lowered.find(f"</{tag}", at)
            end = len(page) if end < 0 else end
            if tag == "textarea":
                builder.text(page[at:end].removeprefix("\n"))
            at = page.find(">", end) + 1 or len(page)
            builder.close(tag)
    while builder.open:
        builder.pop()
    return "\n".join(builder.flow.done())


_SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) per row."""
    source = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = [None if page is None else render(page) for page in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return source.mapInArrow(scan, f"id {source.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
