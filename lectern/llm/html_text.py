"""Layout-aware text of web pages.

A tokenizer and tree builder (implied html, head and body; implied ends of
p, li, dt, dd, option, rows, cells and sections of tables; formatting ends
that cross blocks are ignored) makes a tree. Rendering leaves out what is not
shown: head, scripts, styles, templates, hidden attributes, `display:none`,
`visibility:hidden` (but for descendants made visible again), the rest of
closed details, closed dialogs, and inputs that show no text; style sheets are
not applied. Blocks stand on lines of their own, paragraphs and headings apart
by an empty line; list items have bullets or numbers by depth; table cells are
padded to the width of their column; pre keeps its spaces.

Time and memory follow the page's length, whatever its nesting: beyond NESTED
lists or quotes nothing is indented further, beyond TABLES tables inside each
other a table's rows are plain lines, and a column is padded to COLUMN at most.
Tables of any size are aligned: what bounds the work is a rule of a single row,
which shows ABOVE empty places of cells from above at most (its cells after
those follow unpadded) and ROOM spaces in those and in cells of several
columns. No text is left out by these bounds.

Null or empty html: empty text. Broken markup: whatever text the tree shows; a
tag that the page's end cuts off shows nothing. Invalid UTF-8: replacement
characters. Repeated rows: each extracted. Empty table: empty result. Extra
columns: ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import base

NESTED = 24
TABLES = 6
COLUMN = 120
ABOVE = 100
ROOM = 480

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their end tag; of the second group, with
#: character references.
RAW = frozenset("script style iframe noembed noframes noscript xmp".split())
RAW_CHARACTERS = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template noscript noembed noframes title meta link base iframe object video audio canvas datalist param source track area rp".split())
#: Inputs whose value is text on the page.
TEXT_INPUTS = frozenset("text search url tel email number date month week time datetime-local button submit reset".split())
#: Inside svg and math these show nothing.
FOREIGN_UNSEEN = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
#: Start tags that end an open svg or math, unless an element that may hold HTML is nearer.
BREAKOUT = frozenset("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li menu ol p pre s small span strong sub sup table u ul var".split())
HOLDS_HTML = ("foreignobject", "desc", "title", "annotation-xml", "mtext", "mi", "mo", "mn", "ms")
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr".split())
BLOCK = APART | frozenset("html body div section article aside main nav header footer address form fieldset details summary dialog li dt dd figcaption legend center tr thead tbody tfoot caption option optgroup select menu search hgroup".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
#: A start tag ends the open elements named, unless one of the barriers is nearer.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
}
ENDS_P = APART | frozenset("address article aside center details dialog div dd dt fieldset figcaption footer form header hgroup li main menu nav search section summary".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NAME = re.compile(r"[^ \t\n\f/>]+")
_ATTRIBUTE = re.compile(r"[ \t\n\f/]*(?:(>)|([^ \t\n\f/>][^ \t\n\f/>=]*)(?:[ \t\n\f]*(=)[ \t\n\f]*)?)")
_UNQUOTED = re.compile(r"[^ \t\n\f>]*")
_LONG_NUMBER = re.compile(r"&#(?:0*([0-9]+)|[xX]0*([0-9a-fA-F]+))")


def _characters(text: str) -> str:
    """Character references resolved; numbers beyond Unicode, of any length,
    are the replacement character."""
    if "&" not in text:
        return text
    short = lambda m: "&#1114112" if len(m[1] or m[2]) > 8 else m[0]
    return html.unescape(_LONG_NUMBER.sub(short, text))


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


class TreeBuilder:
    """The tree of a page, in one pass. For each tag it knows where on the
    stack elements of it are open, so that an implied end looks at no others."""

    def __init__(self):
        self.root, self.head, self.body = Node("html", {}), Node("head", {}), Node("body", {})
        self.root.kids = [self.head, self.body]
        self.stack = [self.root]  # then head or body, then what is open
        self.open_at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.foreign = False  # an svg or math has been seen

    def read(self, source: str) -> None:
        source = source.replace("\r\n", "\n").replace("\r", "\n")
        at, end = 0, len(source)
        while at < end:
            mark = source.find("<", at)
            if mark < 0:
                self.text(_characters(source[at:]))
                return
            next_ = source[mark + 1 : mark + 2]
            if next_ not in ("!", "?", "/") and not ("a" <= next_.lower() <= "z"):
                # no tag: text up to the next one
                stop = source.find("<", mark + 1)
                stop = end if stop < 0 else stop
                self.text(_characters(source[at:stop]))
                at = stop
                continue
            if mark > at:
                self.text(_characters(source[at:mark]))
            if source.startswith("<!--", mark):
                if source.startswith((">", "->"), mark + 4):
                    at = source.index(">", mark) + 1
                else:
                    at = self._after(source, "-->", mark + 4)
            elif self.foreign and source.startswith("<![CDATA[", mark):
                at = self._after(source, "]]>", mark + 9)
                self.text(source[mark + 9 : at - 3 if source.endswith("]]>", 0, at) else at])
            elif next_ in ("!", "?") or next_ == "/" and not ("a" <= source[mark + 2 : mark + 3].lower() <= "z"):
                at = self._after(source, ">", mark + 2)
            else:
                at = self._tag(source, mark, next_ == "/")

    @staticmethod
    def _after(source: str, mark: str, at: int) -> int:
        found = source.find(mark, at)
        return len(source) if found < 0 else found + len(mark)

    def _tag(self, source: str, at: int, closing: bool) -> int:
        """Read one tag, and what is raw after it; returns where it ends."""
        name = _NAME.match(source, at + 1 + closing)
        tag, at, attrs = name[0].lower(), name.end(), {}
        while True:
            m = _ATTRIBUTE.match(source, at)
            if m is None:
                return len(source)  # cut off
            at = m.end()
            if m[1]:
                break
            value = ""
            if m[3]:
                quote = source[at : at + 1]
                if quote in ('"', "'"):
                    stop = source.find(quote, at + 1)
                    if stop < 0:
                        return len(source)
                    value, at = source[at + 1 : stop], stop + 1
                else:
                    value = _UNQUOTED.match(source, at)[0]
                    at += len(value)
            attrs.setdefault(m[2].lower(), _characters(value))
        if closing:
            self.end(tag)
            return at
        alone = source.startswith("/>", at - 2)
        self.start(tag, attrs, alone)
        if (tag in RAW or tag in RAW_CHARACTERS) and not (alone and self._inside_foreign()):
            m = re.compile(f"</{tag}(?=[ \\t\\n\\f/>])", re.I).search(source, at)
            stop = m.start() if m else len(source)
            self.text(_characters(source[at:stop]) if tag in RAW_CHARACTERS else source[at:stop])
            return stop
        if tag == "plaintext":
            self.text(source[at:])
            return len(source)
        return at

    def _push(self, node: Node) -> None:
        self.open_at[node.tag].append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def _cut(self, size: int) -> None:
        """Close all elements from this place on the stack up."""
        while len(self.stack) > max(2, size):
            tag = self.stack.pop().tag
            self.open_at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
        del self.stack[size:]

    def _nearest(self, tags: Iterable[str]) -> int:
        return max((self.open_at[t][-1] for t in tags if self.open_at.get(t)), default=-1)

    def _end(self, tags: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        while (at := self._nearest(tags)) > self._nearest(barriers):
            self._cut(at)

    def _to_body(self) -> None:
        self._cut(1)
        self.stack.append(self.body)

    def start(self, tag: str, own: dict[str, str], alone: bool = False) -> None:
        if tag in ("html", "head", "body"):
            {"html": self.root, "head": self.head, "body": self.body}[tag].attrs |= own
            if tag == "head" and len(self.stack) == 1:
                self.stack.append(self.head)
            elif tag == "body" and len(self.stack) <= 2 and self.stack[-1] is not self.body:
                self._to_body()
            return
        if len(self.stack) == 2 and self.stack[-1] is self.head and tag not in HEAD_ONLY:
            self._to_body()
        if len(self.stack) == 1:
            self.stack.append(self.head if tag in HEAD_ONLY else self.body)
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag in ENDS_P:
            self._end(("p",), ("button", "td", "th", "caption", "table", "object"))
        if tag in ("svg", "math"):
            self.foreign = True
        elif self.foreign and tag in BREAKOUT:
            self._end(("svg", "math"), HOLDS_HTML)
        elif tag in FOREIGN_UNSEEN and self._inside_foreign():
            own["hidden"] = ""
        node = Node(tag, own)
        self.stack[-1].kids.append(node)
        if tag not in VOID and not (alone and (self._inside_foreign() or tag in ("svg", "math"))):
            self._push(node)

    def _inside_foreign(self) -> bool:
        return self.foreign and self._nearest(("svg", "math")) >= 0

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
            return
        if tag == "head" and self.stack[-1] is self.head:
            self._cut(1)
            return
        if tag in ("html", "body", "head") or tag in VOID:
            return
        barrier = -1
        if tag not in BLOCK and tag not in UNSEEN and tag not in ("svg", "math"):
            barrier = self.blocks[-1] if self.blocks else -1  # an end of formatting does not cross a block
        if tag not in ("table", "tr", "tbody", "thead", "tfoot"):
            barrier = max(barrier, self._nearest(("td", "th", "table")))
        at = self._nearest((tag,))
        if at >= max(0, barrier):
            self._cut(at)
        elif tag == "p":
            self.start("p", {})
            self.end("p")

    def text(self, data: str) -> None:
        if len(self.stack) <= 2 and self.stack[-1] is not self.body:
            if not data.strip():
                return
            self._to_body()
        self.stack[-1].kids.append(data)


def _styles(node: Node) -> dict[str, str]:
    """The display and visibility that a style attribute ends up with."""
    found: dict[str, tuple[bool, str]] = {}
    style = node.attrs.get("style")
    if style and ("display" in style.lower() or "visibility" in style.lower()):
        for part in style.lower().split(";"):
            name, _, value = part.partition(":")
            name, strong = name.strip(), "!" in value
            if name in ("display", "visibility") and strong >= found.get(name, (False, ""))[0]:
                found[name] = (strong, value.partition("!")[0].strip())
    return {name: value for name, (_, value) in found.items()}


def hidden(node: Node) -> bool:
    """Neither the element nor anything in it is shown."""
    a = node.attrs
    return node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or ("style" in a and _styles(node).get("display") == "none")


def visible(node: Node, around: bool) -> bool:
    """Whether the element's own text is shown; around: whether its parent's is."""
    own = _styles(node).get("visibility") if "style" in node.attrs else None
    return around if own in (None, "inherit") else own not in ("hidden", "collapse")


def shown_kids(node: Node) -> list:
    """Of closed details only the summary is shown."""
    if node.tag == "details" and "open" not in node.attrs:
        return [x for x in node.kids if isinstance(x, Node) and x.tag == "summary"][:1]
    return node.kids


def width(text: str) -> int:
    """Columns of a terminal: wide letters take two, combining marks none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Level:
    """A list item or quote that is being written: its prefix on the first
    line and on others, and its first line, once there is one."""

    __slots__ = ("mark", "rest", "gap", "base")

    def __init__(self, mark: str, rest: str, gap: bool):
        self.mark, self.rest, self.gap, self.base = mark, rest, gap, -1


class Out:
    """Lines written from top to bottom."""

    def __init__(self):
        self.lines: list[str] = []
        self.blank: list[bool] = []
        self.line = ""
        self.parts: list[str] = []
        self.gap = False  # an empty line is due before the next one
        self.spaced = True  # the line so far ends in collapsible space
        self.levels: list[Level] = []
        self.opened = 0  # how many of the levels have lines

    def text(self, data: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(data.split("\n")):
                if i:
                    self.newline(True)
                self.put(part)
            return
        data = _SPACE.sub(" ", data)
        if self.spaced:
            data = data.lstrip(" ")
        if data:
            self.put(data)
            self.spaced = data.endswith(" ")

    def put(self, data: str) -> None:
        if data:
            self.parts.append(data)
            self.spaced = False

    def newline(self, keep: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        self.parts, self.spaced = [], True
        if line:
            self.emit(line)
        elif keep and self.opened == len(self.levels) and len(self.lines) > self._base():
            self._add("", True)

    def _base(self) -> int:
        return self.levels[self.opened - 1].base if self.opened else 0

    def _add(self, line: str, blank: bool) -> None:
        self.lines.append(("".join([x.rest for x in self.levels[: self.opened]]) + line).rstrip())
        self.blank.append(blank)

    def _space(self) -> None:
        if len(self.lines) > self._base() and not self.blank[-1]:
            self._add("", True)

    def emit(self, line: str) -> None:
        """Write a line; the levels it is the first one of show their marks."""
        old = self.opened
        if old == len(self.levels):
            if self.gap:
                self._space()
            self._add(line, False)
        else:
            if self.levels[old].gap:
                self._space()
            prefix = "".join([x.rest for x in self.levels[:old]] + [x.mark for x in self.levels[old:]])
            self.lines.append((prefix + line).rstrip())
            self.blank.append(False)
            for x in self.levels[old:]:
                x.base = len(self.lines) - 1
            self.opened = len(self.levels)
        self.gap = False

    def enter(self, mark: str, rest: str) -> None:
        self.levels.append(Level(mark, rest, self.gap))
        self.gap = False

    def leave(self, always: bool) -> None:
        """End the innermost level; always: it has a line, if an empty one."""
        self.newline()
        if self.opened < len(self.levels) and always:
            self.emit("")
        level = self.levels.pop()
        if level.base < 0:
            self.gap = level.gap
            return
        self.opened = len(self.levels)
        while self.blank[-1] and len(self.lines) - 1 > level.base:
            self.lines.pop()
            self.blank.pop()
        self.gap = False

    def done(self) -> list[str]:
        self.newline()
        while self.blank and self.blank[-1]:
            self.lines.pop()
            self.blank.pop()
        return self.lines


class Frame:
    """An element whose kids are being rendered."""

    __slots__ = ("kids", "kind", "pre", "shown", "leave", "number", "started", "loose")

    def __init__(self, kids: Iterable, kind: str, pre: bool, shown: bool, leave=None, number: int = 0):
        self.kids, self.kind, self.pre, self.shown, self.leave, self.number = iter(kids), kind, pre, shown, leave, number
        self.started = self.loose = False


def _whole(text: str | None, default: int, least: int, most: int) -> int:
    m = re.match(r"\s*([+-]?[0-9]{1,9})", text or "")
    return min(most, max(least, int(m[1]))) if m else default


def _render(out: Out, kids: Iterable, pre: bool, shown: bool, tables: int) -> None:
    """Write kids to out. tables: how many tables stand around them."""
    todo = [Frame(kids, "flow", pre, shown)]

    def block(apart: bool) -> None:
        out.newline()
        out.gap = out.gap or apart

    def leave_list(lines: int, gap: bool) -> None:
        out.newline()
        out.gap = True if len(out.lines) > lines else gap

    while todo:
        frame = todo[-1]
        kid = next(frame.kids, None)
        if kid is None:
            todo.pop()
            if frame.leave:
                frame.leave()
            continue
        node = isinstance(kid, Node)
        if node and hidden(kid) or not node and (frame.kind == "svg" or frame.kind == "list" and not kid.strip()):
            continue
        pre, shown = frame.pre, frame.shown
        tag = kid.tag if node else ""
        if node:
            shown = visible(kid, shown)
            if frame.kind == "svg" and tag not in ("text", "foreignobject"):
                todo.append(Frame(kid.kids, "svg", pre, shown))
                continue
        inner = tag in ("ul", "ol", "menu")
        if frame.kind == "list":
            if tag == "li" or inner or not frame.loose:
                out.newline()
                if frame.started:
                    out.gap = False
                frame.started = True
            frame.loose = not (tag == "li" or inner)
        if not node:
            if shown:
                out.text(kid, pre)
        elif tag == "li" and frame.kind == "list":
            mark = f"{frame.number}. " if frame.number else "- "
            mark_shown = shown
            if frame.number:
                frame.number += 1
            if len(out.levels) < NESTED:
                out.enter(mark, " " * len(mark))
                todo.append(Frame(kid.kids, "flow", pre, shown, lambda always=mark_shown: out.leave(always)))
            else:
                if shown:
                    out.put(mark)
                    out.spaced = True
                todo.append(Frame(kid.kids, "flow", pre, shown, out.newline))
        elif inner:
            number = _whole(kid.attrs.get("start"), 1, 0, 10**9) if tag == "ol" else 0
            if frame.kind == "list" and len(out.levels) < NESTED:
                out.enter("  ", "  ")
                todo.append(Frame(kid.kids, "list", pre, shown, lambda: out.leave(False), number))
            else:
                before = out.gap
                block(frame.kind != "list")
                todo.append(Frame(kid.kids, "list", pre, shown, lambda n=len(out.lines), gap=before: leave_list(n, gap), number))
        elif tag == "br":
            out.newline(True)
        elif tag == "wbr":
            continue
        elif tag == "hr":
            if shown:
                block(True)
                out.emit("---")
                out.gap = True
        elif tag == "img":
            if shown:
                out.text(kid.attrs.get("alt", ""), False)
        elif tag == "input":
            kind = kid.attrs.get("type", "").strip().lower() or "text"
            if shown and kind == "image":
                out.text(kid.attrs.get("alt", ""), False)
            elif shown and (kind in TEXT_INPUTS or not kind.replace("-", "").isalpha()):
                out.text(kid.attrs.get("value", ""), False)
        elif tag == "table" and tables < TABLES:
            lines = _table(kid, pre, shown, tables + 1)
            some = [i for i, line in enumerate(lines) if line]
            lines = lines[some[0] : some[-1] + 1] if some else []
            out.newline()
            if lines:
                out.gap = True
                for line in lines:
                    out.emit(line) if line else out.newline(True)
                out.gap = True
        elif tag == "svg":
            todo.append(Frame(kid.kids, "svg", pre, shown))
        elif tag == "blockquote" and len(out.levels) < NESTED:
            out.newline()
            before, out.gap = out.gap, True
            out.enter("> ", "> ")

            def leave_quote(lines: int = len(out.lines), gap: bool = before) -> None:
                out.leave(False)
                out.gap = True if len(out.lines) > lines else gap

            todo.append(Frame(kid.kids, "flow", pre, shown, leave_quote))
        else:
            if tag in ("td", "th"):
                out.text(" ", False)
            own_block = tag in BLOCK or frame.kind == "svg" or tag == "tspan" and not kid.attrs.keys().isdisjoint(("x", "y", "dy"))
            apart = tag in APART
            if own_block:
                block(apart)
            todo.append(Frame(shown_kids(kid), "flow", pre or tag in ("pre", "textarea"), shown, (lambda a=apart: block(a)) if own_block else None))


def _lines(kids: Iterable, pre: bool, shown: bool, tables: int) -> list[str]:
    out = Out()
    _render(out, kids, pre, shown, tables)
    return out.done()


def _members(node: Node, tags: tuple[str, ...]) -> Iterator[Node | str]:
    """The kids of node; those of sections, and of other elements that stand
    around any of the tags (a form around rows), take their place."""
    above, around, todo = {}, set(), [node]
    while todo:
        at = todo.pop()
        for kid in at.kids:
            if not isinstance(kid, Node) or kid.tag == "table" or hidden(kid):
                continue
            if kid.tag in tags:
                up = at
                while up is not node and id(up) not in around:
                    around.add(id(up))
                    up = above[id(up)]
            else:
                above[id(kid)] = at
                todo.append(kid)
    levels = [iter(node.kids)]
    while levels:
        kid = next(levels[-1], None)
        if kid is None:
            levels.pop()
        elif isinstance(kid, Node) and (id(kid) in around or kid.tag in ("thead", "tbody", "tfoot", "colgroup") and not hidden(kid)):
            levels.append(iter(kid.kids))
        elif isinstance(kid, Node) and kid.tag != "col" or isinstance(kid, str) and kid.strip():
            yield kid


def _rows(node: Node) -> tuple[list[Node], list[Node | str]]:
    """The rows of a table, and all else it holds. Cells outside of rows make
    a row."""
    rows, strays, implied = [], [], None
    for kid in _members(node, ("tr", "td", "th")):
        tag = kid.tag if isinstance(kid, Node) else ""
        if tag in ("td", "th"):
            if implied is None:
                implied = Node("tr", {})
                rows.append(implied)
            implied.kids.append(kid)
            continue
        if tag == "tr":
            implied = None
            if not hidden(kid) and _styles(kid).get("visibility") != "collapse":
                rows.append(kid)
        else:
            strays.append(kid)
    return rows, strays


def _grid(rows: list[list[tuple[Node, list[str]]]]) -> list[list[tuple[list[str], int, int, bool]]]:
    """Cells of each row as (lines, first column, end, from above). Cells that
    reach down from above leave one empty place, ABOVE in a row at most; the
    row's cells after those stand in no column (first and end are -1). Only
    columns where some cell begins or ends are told apart."""
    grid, over, ends = [], [], defaultdict(list)  # over: (begin, end, last row) of cells from above, sorted
    edges = set()
    for r, row in enumerate(rows):
        for x in ends.pop(r - 1, ()):
            del over[bisect_left(over, x)]
        line, c, i, above, new = [], 0, 0, 0, []
        for node, lines in row:
            while i < len(over) and over[i][0] <= c and above <= ABOVE:
                if over[i][1] > c:
                    above += 1
                    if above <= ABOVE:
                        line.append(([""], c, over[i][1], True))
                        edges |= {c, over[i][1]}
                        c = over[i][1]
                i += 1
            if above > ABOVE:
                line.append((lines, -1, -1, False))
                continue
            end = c + _whole(node.attrs.get("colspan"), 1, 1, 1000)
            down = _whole(node.attrs.get("rowspan"), 1, 0, 65534) or len(rows)
            if down > 1:
                new.append((c, end, min(len(rows), r + down) - 1))
            line.append((lines, c, end, False))
            edges |= {c, end}
            c = end
        for x in new:
            if x[2] > r:
                insort(over, x)
                ends[x[2]].append(x)
        grid.append(line)
    number = {x: i for i, x in enumerate(sorted(edges))} | {-1: -1}
    return [[(lines, number[a], number[b], above) for lines, a, b, above in row] for row in grid]


def _table(node: Node, pre: bool, shown: bool, tables: int) -> list[str]:
    out: list[str] = []
    rows, strays = _rows(node)
    for kid in strays:
        out += _lines([kid], pre, shown, tables)
    cells: list[list[tuple[Node, list[str]]]] = []
    for row in rows:
        row_shown, own = visible(row, shown), []
        for kid in _members(row, ("td", "th")):
            if not isinstance(kid, Node) or kid.tag not in ("td", "th"):
                out += _lines([kid], pre, row_shown, tables)
            elif not hidden(kid):
                own.append((kid, _lines(kid.kids, pre, visible(kid, row_shown), tables) or [""]))
        cells.append(own)
    grid = _grid(cells)
    columns = max((b for row in grid for _, _, b, _ in row), default=0)
    widths = [0] * max(columns, 0)
    for row in grid:
        for lines, a, b, above in row:
            if b - a == 1 and not above:
                widths[a] = max(widths[a], *(min(COLUMN, width(x)) for x in lines))
    for row in grid:
        for lines, a, b, above in row:
            if b - a > 1 and not above:
                need = min(COLUMN, max(width(x) for x in lines)) - sum(widths[a:b]) - 3 * (b - a - 1)
                widths[b - 1] += max(need, 0)
    upto = [0, *accumulate(w + 3 for w in widths)]
    for row in grid:
        high, spare, texts = max((len(lines) for lines, *_ in row), default=0), ROOM, []
        for lines, a, b, above in row:
            room = upto[b] - upto[a] - 3 if b > a else 0
            if above:
                room = min(room, spare)
                spare -= room
                texts.append([" " * room] * high)
                continue
            if b - a > 1:
                most = max(width(x) for x in lines)
                room = min(room, most + spare)
                spare -= max(room - most, 0)
            texts.append([x + " " * (room - width(x)) for x in lines + [""] * (high - len(lines))])
        out += [" | ".join(parts).rstrip() for parts in zip(*texts)]
    return out


def extract(source: str | None) -> str:
    """The visible text of one page."""
    if not source:
        return ""
    builder = TreeBuilder()
    builder.read(source)
    if hidden(builder.root) or hidden(builder.body):
        return ""
    return "\n".join(_lines(builder.body.kids, False, visible(builder.body, visible(builder.root, True)), 0))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sources = part.column(2).cast(pa.binary()).to_pylist()
                texts = [extract(x and x.decode("utf-8", "replace")) for x in sources]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(base.table(spark, sf_dir, "pages"))


def words_of_markup(source: str) -> list[str]:
    """A plain second opinion for simple markup in tests: tags out, the rest
    in order."""
    source = re.sub(r"(?is)<(script|style|head|template)\b.*?</\1\s*>|<!--.*?-->|<![^>]*>", " ", source)
    return html.unescape(re.sub(r"(?s)<[^>]*>", " ", source)).split()
