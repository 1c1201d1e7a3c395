"""Visible text of HTML pages as it is laid out: blocks, lists, preformatted text and aligned tables.

A page is read tag by tag into a tree, with the end tags that HTML leaves out (a paragraph ends where a block
begins, a list item or cell where the next begins, and so on). Elements that a browser does not show are left out:
heads, scripts and the like, ``hidden``, ``display:none`` and ``visibility:hidden`` (inline or by the style sheets'
cascade, html_style.py), closed details and dialogs, and the options of a list that are not chosen. Of a drawing its
text elements and foreign objects are shown, of a formula all but annotations, of a button input its value. The rest
is rendered in one walk; everything visible is kept.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reelmetrics.llm.html_style import Value, apply_sheets, declarations
from reelmetrics.llm.shared import appended

# Names that the HTML standard fixes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript".split())
ESCAPED_RAW = {"title", "textarea"}
UNSEEN = set("head script style template noscript title iframe noembed noframes datalist video audio canvas progress meter rp param annotation annotation-xml".split())
# Parts of a drawing that are not shown where they stand.
UNDRAWN = set("defs symbol desc title metadata clippath mask marker pattern lineargradient radialgradient filter style script".split())
# Kinds of input that show no text, and those of the others that show a placeholder while they are empty.
TEXTLESS_INPUTS = set("hidden checkbox radio file color range image".split())
PLACEHOLDERS = set("text search url tel email password number".split())
INPUTS = PLACEHOLDERS | TEXTLESS_INPUTS | set("submit reset button date month week time datetime-local".split())
# HTML may stand in these parts of formulas and drawings; elsewhere in them, the elements of BREAKOUT end them.
INTEGRATION = set("mi mo mn ms mtext annotation-xml foreignobject desc title".split())
BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote table pre hr figure fieldset address xmp plaintext menu dir".split())
LINES = set("html body div section article aside header footer main nav form li dt dd tr caption thead tbody tfoot figcaption details summary legend center hgroup search dialog option optgroup select".split())
ENDS_PARAGRAPH = SPACED | set("div section article aside header footer main nav form li dt dd details summary figcaption center hgroup search dialog".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# An element that begins ends these, up to the nearest of those after them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
SCOPES = {"table", "td", "th", "caption", "html", "template", "button", "object"}
DEPTH = 256  # deeper elements become siblings, as in browsers

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>]*))?""")
TAG_END = re.compile(r"[\s/]*>?")
BLANK = re.compile(r"[ \t\n\r\f]+")
FIXED_SPACE = "\N{NO-BREAK SPACE}"


@dataclass
class Element:
    name: str
    attributes: dict[str, str]
    children: list = field(default_factory=list)  # elements and texts
    styles: dict[str, Value] = field(default_factory=dict)  # what the style sheets set


def parsed(source: str) -> tuple[Element, list[str]]:
    """The tree of a page, and its style sheets."""
    root = Element("html", {})
    stack, sheets = [root], []
    at, end, embedded = 0, len(source), False

    def add_text(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text))

    def close(names: set[str], bounds: set[str]) -> None:
        """End the open elements down to the outermost of ``names`` within the nearest of ``bounds``."""
        cut = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in bounds:
                break
            if stack[i].name in names:
                cut = i
        if cut is not None:
            del stack[cut:]

    def in_foreign() -> bool:
        """Whether the open element is part of a formula or drawing, and not one that holds HTML."""
        names = (e.name for e in reversed(stack))
        return next((n for n in names if n in ("svg", "math") or n in INTEGRATION), "") in ("svg", "math")

    while at < end:
        tag = source.find("<", at)
        if tag < 0:
            add_text(source[at:])
            break
        add_text(source[at:tag])
        if source.startswith("<!--", tag):
            stop = source.find("-->", tag + 4)
            at = end if stop < 0 else stop + 3
            continue
        if source.startswith(("<!", "<?"), tag):
            stop = source.find(">", tag)
            at = end if stop < 0 else stop + 1
            continue
        m = TAG.match(source, tag)
        if m is None:
            add_text("<")
            at = tag + 1
            continue
        closing, name, at = m[1], m[2].lower(), m.end()
        attributes: dict[str, str] = {}
        while (a := ATTRIBUTE.match(source, at)) is not None:
            value = a[2] or ""
            if value[:1] in ("'", '"'):
                value = value[1:].removesuffix(value[0])
            attributes.setdefault(a[1].lower(), html.unescape(value))
            at = a.end()
        tag_end = TAG_END.match(source, at)
        at = tag_end.end()
        if closing:
            if name == "br":
                stack[-1].children.append(Element("br", {}))
            else:
                names = HEADINGS if name in HEADINGS else {name}
                bounds = set() if name in SCOPES or name in ("body", "head") or name in IMPLIED else SCOPES
                nearest = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in names or stack[i].name in bounds), 0)
                if nearest and stack[nearest].name in names:
                    del stack[nearest:]
            continue
        if name == "html":
            root.attributes = attributes | root.attributes
            continue
        foreign = embedded and in_foreign()
        if foreign and name in BREAKOUT:
            while in_foreign():
                stack.pop()
            foreign = False
        if name in ENDS_PARAGRAPH:
            close({"p"}, SCOPES)
        if name in HEADINGS and stack[-1].name in HEADINGS:
            stack.pop()
        if name in IMPLIED:
            close(*IMPLIED[name])
        if stack[-1].name == "head" and name in ENDS_PARAGRAPH | {"span", "a", "b", "i"}:
            stack.pop()
        embedded = embedded or name in ("svg", "math")
        element = Element(name, attributes)
        stack[-1].children.append(element)
        if name in VOID or (foreign or name in ("svg", "math")) and tag_end[0].endswith("/>"):
            continue
        if name in RAW or name in ESCAPED_RAW:
            stop = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
            inner = source[at : stop.start() if stop else end]
            if name == "style":
                sheets.append(inner)
            element.children.append(html.unescape(inner) if name in ESCAPED_RAW else inner)
            if stop is None:
                break
            close_at = source.find(">", stop.end())
            at = end if close_at < 0 else close_at + 1
            continue
        if name == "plaintext":  # all that follows is text
            element.children.append(source[at:])
            break
        if name == "pre" and source.startswith("\n", at):
            at += 1  # a line end right after the tag is not part of the text
        if len(stack) < DEPTH:
            stack.append(element)
    return root, sheets


def style(e: Element, name: str) -> str | None:
    """The display or visibility that an element is given, inline or by the style sheets."""
    sheet, own = e.styles.get(name), None
    if "style" in e.attributes:
        own = declarations(e.attributes["style"]).get(name)
    if own is None or sheet is not None and sheet[0] and not own[0]:
        own = sheet
    return own[1] if own is not None else None


def kind_of(e: Element) -> str:
    """The kind of an input; unknown ones are plain text."""
    kind = e.attributes.get("type", "").strip().lower()
    return kind if kind in INPUTS else "text"


def field_text(e: Element) -> str:
    """What an input shows: its value, or while it is empty its placeholder. A password's value is not shown."""
    kind = kind_of(e)
    value, hint = e.attributes.get("value", ""), e.attributes.get("placeholder", "") if kind in PLACEHOLDERS else ""
    if kind == "password":
        return "" if value else hint
    return value or hint


def shown(e: Element) -> bool:
    """Whether an element takes part in the layout."""
    a = e.attributes
    if e.name in UNSEEN or e.name == "input" and kind_of(e) in TEXTLESS_INPUTS or e.name == "object" and "data" in a:
        return False
    display = style(e, "display")
    if display is None or display in ("revert", "revert-layer"):  # as the browser's own sheet has it
        return not ("hidden" in a or e.name == "dialog" and "open" not in a)
    return display != "none"


def seen_in(e: Element, inherited: bool) -> bool:
    """Whether an element's own text is visible, given whether that of the element around it is."""
    value = style(e, "visibility")
    if e.name == "mphantom":
        return False
    return inherited if value not in ("visible", "initial", "hidden", "collapse") else value in ("visible", "initial")


class Page:
    """Lines of text under way. A block's space is asked for before and after it, and made once there is text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0
        self.indent = ""
        self.mark = ""  # a list item's mark, before its first line

    def words(self, text: str, kept: bool) -> None:
        if kept:
            for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
                if i:
                    self.flush(always=True)
                self.line += part
            return
        text = BLANK.sub(" ", text)
        if not self.line or self.line.endswith(" "):
            text = text.removeprefix(" ")
        self.line += text

    def flush(self, always: bool = False) -> None:
        line, self.line = self.line.rstrip(" "), ""
        if not line and not always:
            return
        if self.gap and self.lines:
            self.lines.extend([""] * (self.gap - 1))
        self.gap = 0
        self.lines.append((self.indent + self.mark + line).rstrip(" ") if line or self.mark else "")
        if self.mark:
            self.indent, self.mark = self.indent + " " * len(self.mark), ""

    def space(self, gap: int) -> None:
        """1: a new line; 2: an empty line between."""
        self.flush()
        self.gap = max(self.gap, gap)

    def text(self) -> str:
        self.flush()
        return "\n".join(self.lines).strip("\n").replace(FIXED_SPACE, " ")


def render(e: Element, page: Page, pre: bool = False, visible: bool = True, level: int = 0) -> None:
    for child in e.children:
        if isinstance(child, str):
            if visible:
                page.words(child, pre)
            continue
        if not shown(child):
            continue
        seen = seen_in(child, visible)
        name = child.name
        if name == "input":
            text = field_text(child) if seen else ""
            if text:  # a box of its own, apart from the words beside it
                page.words(f" {text} ", pre)
            continue
        if name == "svg":
            render_drawing(child, page, seen)
            continue
        if name in ("mtr", "mlabeledtr"):
            page.space(1)
        if name == "mtd":
            page.words(" ", False)
        if name == "br":
            page.flush(always=True)
            continue
        if name == "table":
            page.space(2)
            for line in table_lines(child, seen):
                page.line = line
                page.flush(always=True)
            page.space(2)
            continue
        if name in ("td", "th"):  # a cell outside a table
            page.words(" ", False)
        if name == "details" and "open" not in child.attributes:
            child = Element(name, {}, [c for c in child.children if isinstance(c, Element) and c.name == "summary"][:1])
        if name == "select":
            child = Element(name, {}, chosen(child))
        if name == "textarea" and not any(child.children):
            child = Element(name, {}, [child.attributes.get("placeholder", "")])
        inner_list = name in ("ul", "ol", "menu", "dir", "dl") and level > 0
        gap = 1 if inner_list or name in LINES else 2 if name in SPACED else 0
        if gap:
            page.space(gap)
        if name in ("ul", "ol", "menu", "dir"):
            render_list(child, page, seen, level + 1)
        elif name in ("blockquote", "dd"):
            before, page.indent = page.indent, page.indent + "  "
            render(child, page, pre, seen, level)
            page.flush()
            page.indent = before
        elif name == "q":
            page.words("“", pre)
            render(child, page, pre, seen, level)
            page.words("”", pre)
        else:
            render(child, page, pre or name in ("pre", "textarea", "xmp", "plaintext"), seen, level)
        if gap:
            page.space(gap)


def render_drawing(e: Element, page: Page, visible: bool) -> None:
    """The text elements of a drawing, set apart by spaces, and its foreign objects."""
    for child in e.children:
        if isinstance(child, str) or child.name in UNDRAWN or not shown(child):
            continue
        if "display" not in child.attributes or style(child, "display") is not None or child.attributes["display"].strip() != "none":
            seen = seen_in(child, visible)
            if style(child, "visibility") is None and child.attributes.get("visibility", "").strip() in ("hidden", "collapse"):
                seen = False
            if child.name == "text":
                page.words(" ", False)
                render(Element("text", {}, [c for c in child.children if isinstance(c, str) or c.name not in UNDRAWN]), page, False, seen)
                page.words(" ", False)
            elif child.name == "foreignobject":
                page.space(1)
                render(child, page, False, seen)
                page.space(1)
            else:
                render_drawing(child, page, seen)


def render_list(e: Element, page: Page, visible: bool, level: int) -> None:
    items = sum(isinstance(c, Element) and c.name == "li" for c in e.children)
    step = -1 if "reversed" in e.attributes else 1
    number = _number(e.attributes.get("start"), items if step < 0 else 1)
    for child in e.children:
        if isinstance(child, str) or child.name != "li":
            render(Element("li", {}, [child]), page, False, visible, level)
            continue
        if not shown(child):
            continue
        number = _number(child.attributes.get("value"), number)
        page.space(1)
        before = page.indent
        page.mark = f"{number}. " if e.name == "ol" else "- "
        number += step
        render(child, page, False, seen_in(child, visible), level)
        page.space(1)
        page.indent, page.mark = before, ""


def chosen(select: Element) -> list:
    """The options of a list that show when it is closed: the selected ones, else the first; all of a long list."""
    options, waiting = [], [select]
    while waiting:
        e = waiting.pop()
        options += [c for c in e.children if isinstance(c, Element) and c.name == "option"]
        waiting += [c for c in e.children if isinstance(c, Element) and c.name == "optgroup"]
    if "multiple" in select.attributes or "size" in select.attributes:
        return options
    return [o for o in options if "selected" in o.attributes][:1] or options[:1]


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?\d{1,9}\s*", text) else default


def width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table_lines(e: Element, visible: bool) -> Iterator[str]:
    """A table's lines: its captions, then its rows with columns padded to one width and set apart by ' | '."""
    rows: list[list[tuple[list[str], int, int]]] = []

    def lines_of(cell: Element, inherited: bool) -> list[str]:
        page = Page()
        render(cell, page, False, seen_in(cell, inherited))
        text = page.text()
        return text.split("\n") if text else []

    outside: list[list[str]] = []
    waiting = [(e, visible)]
    while waiting:
        part, seen = waiting.pop()
        loose = []
        for child in part.children:
            if isinstance(child, Element) and child.name in ("thead", "tbody", "tfoot", "tr", "caption", "td", "th"):
                continue
            if isinstance(child, str) and not child.strip():
                continue
            loose.append(child)
        if loose and part.name != "tr":
            outside.append(lines_of(Element("div", {}, loose), seen))
        elif loose:
            kept = [c for c in part.children if not isinstance(c, str) or c.strip()]
            cell = [isinstance(c, Element) and c.name in ("td", "th") for c in kept]
            part = Element("tr", {}, [c if own else Element("td", {}, [c]) for c, own in zip(kept, cell)])
        below = []
        cells = []
        for child in part.children:
            if not isinstance(child, Element) or not shown(child):
                continue
            if child.name in ("thead", "tbody", "tfoot", "tr"):
                below.append((child, seen_in(child, seen)))
            elif child.name == "caption":
                outside.append(lines_of(child, seen))
            elif child.name in ("td", "th"):
                a = child.attributes
                across = min(max(_number(a.get("colspan"), 1), 1), 1000)
                cells.append((lines_of(child, seen), across, min(max(_number(a.get("rowspan"), 1), 1), 65534)))
        if cells:
            rows.append(cells)
        waiting.extend(reversed(below))
    for lines in outside:
        yield from lines
    # Each cell at its column; cells that span rows keep their columns in the rows below.
    taken: dict[int, int] = {}
    placed: list[dict[int, tuple[list[str], int]]] = []
    for row in rows:
        column, here = 0, {}
        for lines, across, down in row:
            while taken.get(column, 0) > 0:
                column += 1
            here[column] = (lines, across)
            for c in range(column, column + across):
                taken[c] = down
            column += across
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        placed.append(here)
    used = sorted({c for here in placed for c, (lines, _) in here.items() if lines})
    alone = {c: [x for here in placed if c in here and here[c][1] == 1 for x in here[c][0]] for c in used}
    widths = {c: max(map(width, lines), default=0) for c, lines in alone.items()}
    for here in placed:
        for i in range(max((len(lines) for lines, _ in here.values()), default=0)):
            cells = [here[c][0][i] if c in here and i < len(here[c][0]) else "" for c in used]
            while cells and not cells[-1]:
                cells.pop()
            yield " | ".join(x + " " * (widths[c] - width(x)) for c, x in zip(used, cells)).rstrip(" ")


def visible_text(source: str | None) -> str:
    """The visible text of a page; that of a null page is empty."""
    root, sheets = parsed(source or "")
    apply_sheets(root, sheets)
    page = Page()
    if shown(root):
        render(root, page, visible=seen_in(root, True))
    return page.text()


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """The rows with ``text``, the visible text of each page, in place of the page; an old ``text`` goes.

    Null and empty pages have an empty text. Equal pages give equal texts, whatever their other columns hold.
    """
    kept = [c for c in pages.columns if c not in ("text", column)]
    schema = StructType([pages.schema[c] for c in kept] + [StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [visible_text(p) for p in part.column(part.schema.get_field_index(column)).to_pylist()]
                yield appended(part, kept, {"text": pa.array(texts, pa.string())})

    return pages.select(*kept, column).mapInArrow(run, schema)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars (code points) and text_sha256 of every page."""
    return extract(pages.select("page_id", "html")).select(
        "page_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )
