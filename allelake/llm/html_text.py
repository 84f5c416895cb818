"""Layout-aware rendering of HTML to text.

A tree builder reads tags, supplies the implied ones (closing head, p, li, dt, dd, option and table parts, opening tr), and keeps
a flat list of nodes. A renderer walks the list with an explicit stack, so nesting may be of any depth: it leaves out what
isn't visible, keeps the spacing of blocks, numbers and indents lists, keeps preformatted text, and lays out tables with
aligned columns, by the same rules whatever a table's size.

Visible is what neither ``display: none`` nor ``visibility: hidden`` hides, in ``style`` attributes and in the rules of style
elements whose selectors name an element, classes or an id, without combinators; other rules and at-rules don't count.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from allelake.llm.common import BATCH_BYTES, mapped

#: Element names of the HTML standard by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes"}
ESCAPABLE_RAW = {"textarea", "title"}
HIDDEN = {"head", "script", "style", "title", "template", "noembed", "noframes", "iframe", "datalist", "object", "audio", "video", "canvas", "area", "param", "rp"}
#: Names within svg and math: what isn't shown, what holds HTML again, and HTML elements that end them.
FOREIGN = {"svg", "math"}
FOREIGN_HIDDEN = {"desc", "defs", "metadata", "symbol", "clippath", "mask", "pattern", "marker", "filter", "lineargradient", "radialgradient", "annotation", "annotation-xml", "mphantom"}
INTEGRATION = {"foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
BREAKOUT = {"b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var"}
#: Elements of svg and math that are drawn apart from each other.
APART = {"text", "mfrac", "mtr", "mtd"}
MARGIN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "blockquote", "pre", "table", "figure", "fieldset", "menu", "dir", "listing", "xmp", "hr"}
BLOCK = MARGIN | {"address", "article", "aside", "body", "center", "dd", "details", "dialog", "div", "dt", "figcaption", "footer", "form", "header", "hgroup", "html", "legend", "li", "main", "nav", "search", "section", "summary", "option", "optgroup", "caption", "tr", "td", "th", "tbody", "thead", "tfoot"}
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "caption", "tr", "td", "th", "tbody", "thead", "tfoot", "legend"}
LISTS = {"ul", "ol", "menu", "dir"}
CELLS = {"td", "th"}
SECTIONS = {"tbody", "thead", "tfoot"}
#: What may be in head; anything else closes it.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"}
#: What an opening tag closes, and the elements that stop the search for it.
IMPLIED = {
    "li": ({"li"}, LISTS | {"table", "td", "th"}), "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": (CELLS | {"caption"}, {"tr", "table"}), "th": (CELLS | {"caption"}, {"tr", "table"}), "tr": ({"tr", "caption"}, SECTIONS | {"table"}),
    "tbody": (SECTIONS | {"tr", "caption"}, {"table"}), "thead": (SECTIONS | {"tr", "caption"}, {"table"}), "tfoot": (SECTIONS | {"tr", "caption"}, {"table"}),
}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'](?=[^\"']*+>))*+)(?:>|\Z)", re.S)
#: Lower-casing the source would move places: some letters become two.
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW | ESCAPABLE_RAW}
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)(?:\}|\Z)")
_SELECTOR = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)", re.I)
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|\Z)", re.I)
#: A longer line of a cell runs over its column and doesn't widen it.
WIDE = 512

_UNQUOTED_END = re.compile(r"[^=\"']+=[^\"']*/")

OPEN, CLOSE, TEXT = 0, 1, 2


def attributes(source: str) -> dict[str, str]:
    """Attributes of a tag; of repeated names the first one counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return out


class Tree:
    """Nodes in document order as (kind, element or text, attributes), every opened element closed."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, str, dict[str, str] | None]] = []
        self.stack: list[str] = []
        self.is_open: Counter[str] = Counter()
        self.contexts: list[tuple[int, bool]] = []  # depth of open svg, math and elements with HTML in them; whether foreign

    @property
    def foreign(self) -> bool:
        """Whether the next element is one of svg or math."""
        return bool(self.contexts) and self.contexts[-1][1]

    def _pop(self) -> None:
        tag = self.stack.pop()
        self.is_open[tag] -= 1
        if self.contexts and self.contexts[-1][0] == len(self.stack):
            self.contexts.pop()
        self.nodes.append((CLOSE, tag, None))

    def _close_to(self, names: set[str], stops: set[str]) -> bool:
        """Close up to the nearest open element of ``names``, unless one of ``stops`` is nearer."""
        if not any(self.is_open[x] for x in names):
            return False
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth] in names:
                while len(self.stack) > depth:
                    self._pop()
                return True
            if self.stack[depth] in stops:
                return False
        return False

    def open(self, tag: str, attrs: dict[str, str], alone: bool) -> None:
        while self.foreign and tag in BREAKOUT:
            self._pop()
        if tag not in IN_HEAD:
            self._leave_head()
        if tag in CLOSES_P:
            self._close_to({"p"}, {"table", "td", "th", "caption", "button"})
        if tag in IMPLIED:
            names, stops = IMPLIED[tag]
            while self._close_to(names, stops):
                pass
            if tag in CELLS and self._nearest({"tr", "table"}) == "table":
                self.open("tr", {}, False)
        if tag[0] == "h" and tag[1:].isdigit() and self.stack and self.stack[-1] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._pop()
        self.nodes.append((OPEN, tag, attrs))
        if alone:
            self.nodes.append((CLOSE, tag, None))
        else:
            if tag in FOREIGN or self.foreign and tag in INTEGRATION:
                self.contexts.append((len(self.stack), tag in FOREIGN))
            self.stack.append(tag)
            self.is_open[tag] += 1

    def _nearest(self, names: set[str]) -> str | None:
        return next((x for x in reversed(self.stack) if x in names), None)

    def close(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        stops = {"table"} if tag in CELLS | SECTIONS | {"tr", "caption"} else set() if tag == "table" else CELLS | {"caption", "table"} if tag not in BLOCK else CELLS | {"table"}
        self._close_to({tag}, stops - {tag})

    def _leave_head(self) -> None:
        while self.is_open["head"] and not self.is_open["template"]:
            self._pop()

    def text(self, value: str) -> None:
        if value:
            if self.is_open["head"] and self.stack[-1] in ("head", "noscript") and value.strip(" \t\n\r\f"):
                self._leave_head()
            self.nodes.append((TEXT, value, None))

    def end(self) -> None:
        while self.stack:
            self._pop()


def _closes_itself(rest: str) -> bool:
    """Whether a tag ends with a slash that isn't part of an unquoted value."""
    return rest.endswith("/") and not _UNQUOTED_END.fullmatch(rest.rsplit(None, 1)[-1])


def build_tree(source: str) -> Tree:
    """Tree of an HTML text. Comments and declarations are dropped; script and style content is text of its element."""
    tree, at = Tree(), 0
    while True:
        m = _TOKEN.search(source, at)
        if not m:
            tree.text(html.unescape(source[at:]))
            break
        tree.text(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if tree.foreign and source.startswith("<![CDATA[", m.start()):
                end = source.find("]]>", m.start())
                tree.text(source[m.start() + 9 : end if end >= 0 else len(source)])
                at = end + 3 if end >= 0 else len(source)
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                tree.open("br", {}, True)
            elif tag not in VOID:
                tree.close(tag)
            continue
        foreign = tree.foreign and tag not in BREAKOUT
        alone = tag in VOID or (foreign or tag in FOREIGN) and _closes_itself(m[3])
        tree.open("img" if tag == "image" and not foreign else tag, attributes(m[3]) if m[3] else {}, alone)
        if foreign:
            continue
        if tag in RAW or tag in ESCAPABLE_RAW:
            m = _RAW_END[tag].search(source, at)
            end = m.start() if m else len(source)
            tree.text(source[at:end] if tag in RAW else html.unescape(source[at:end]))
            at = end
        elif tag == "plaintext":
            tree.text(source[at:])
            break
    tree.end()
    return tree


def _declared(source: str) -> dict[str, tuple[bool, str]]:
    """Values of display and visibility, and whether they are important; of several the last important one, or the last."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in _DECLARATION.findall(source):
        if important or not out.get(name.lower(), (False, ""))[0]:
            out[name.lower()] = (bool(important), value.lower())
    return out


def _without_at_rules(css: str) -> str:
    parts, at = [], 0
    while (begin := css.find("@", at)) >= 0:
        parts.append(css[at:begin])
        m = re.compile(r"[;{]").search(css, begin)
        if not m:
            return "".join(parts)
        at = m.end()
        if m[0] == "{":
            depth = 1
            for m in re.compile(r"[{}]").finditer(css, at):
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    at = m.end()
                    break
            else:
                return "".join(parts)
    return "".join([*parts, css[at:]])


class Rules:
    """Rules on display and visibility of a page's style elements, found by element, class and id."""

    def __init__(self, sheets: list[str]) -> None:
        self.by: dict[str, list[tuple[tuple[int, int, int, int], str, set[str], set[str], dict]]] = {}
        order = 0
        for sheet in sheets:
            for selectors, body in _RULE.findall(_without_at_rules(_COMMENT.sub(" ", sheet))):
                declared = _declared(body)
                if not declared:
                    continue
                for selector in selectors.split(","):
                    m = _SELECTOR.fullmatch(selector.strip())
                    if not m or not m[0]:
                        continue
                    order += 1
                    tag = "" if m[1] in (None, "*") else m[1].lower()
                    names = re.findall(r"[.#][\w-]+", m[2])
                    classes, ids = {x[1:] for x in names if x[0] == "."}, {x[1:] for x in names if x[0] == "#"}
                    self.by.setdefault(names[-1] if names else tag or "*", []).append(((len(ids), len(classes), bool(tag), order), tag, classes, ids, declared))

    def of(self, tag: str, attrs: dict[str, str]) -> dict[str, str]:
        """Values of display and visibility of an element."""
        found = []
        if self.by:
            classes, name = set(attrs.get("class", "").split()), attrs.get("id", "")
            for key in (tag, "*", f"#{name}", *(f".{c}" for c in classes)):
                found += [(rank, declared) for rank, t, c, i, declared in self.by.get(key, ()) if t in ("", tag) and c <= classes and i <= {name}]
        if "style" in attrs:
            found.append(((2**31, 0, 0, 0), _declared(attrs["style"])))
        ranked = sorted(((important, rank, name, value) for rank, declared in found for name, (important, value) in declared.items()))
        return {name: value for _, _, name, value in ranked}


def hidden(tag: str, attrs: dict[str, str], style: dict[str, str], foreign: bool = False) -> bool:
    """Whether the element and all in it is not shown; ``foreign`` within svg or math."""
    if foreign and (tag in FOREIGN_HIDDEN or attrs.get("display") == "none"):
        return True
    if tag in HIDDEN or tag == "dialog" and "open" not in attrs:
        return True
    return style["display"] == "none" if "display" in style else "hidden" in attrs


class Canvas:
    """Lines of text with collapsed white space, margins between blocks, and indented lists."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a space is due before the next word
        self.gap = 0  # empty lines due before the next line
        self.indent: list[str] = []
        self.mark = ""  # of the list item whose first line is to come

    def _begin(self) -> None:
        if not self.line:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            prefix = "".join(self.indent)
            if self.mark:
                prefix = prefix[: -len(self.mark)] + self.mark
                self.mark = ""
            self.line.append(prefix)
            self.space = False

    def write(self, text: str) -> None:
        words = _SPACES.split(text)
        if len(words) == 1:
            if not words[0]:
                return
        lead, tail = not words[0], not words[-1]
        body = " ".join(w for w in words if w)
        if lead and self.line:
            self.space = True
        if not body:
            return
        due = self.space
        self._begin()
        self.line.append(" " + body if due and self.space else body)
        self.space = tail

    def keep(self, text: str) -> None:
        """Preformatted text."""
        for i, part in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.newline()
            if part:
                self._begin()
                self.line.append(part)
                self.space = False

    def newline(self) -> None:
        """End the line, or make an empty one."""
        if not self.line:
            self._begin()
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.space = [], False

    def block(self, gap: int = 0) -> None:
        """Begin a new line, with ``gap`` empty lines before it at least."""
        if self.line:
            self.newline()
        self.gap = max(self.gap, gap)

    def add(self, lines: Iterable[str]) -> None:
        """Whole lines, laid out already."""
        for x in lines:
            self._begin()
            self.line.append(x)
            self.newline()

    def done(self) -> list[str]:
        if self.line:
            self.newline()
        return self.lines


def _number(value: str | None, least: int, most: int) -> int:
    m = re.match(r"\s*(\d{1,6})", value or "")
    return min(most, max(least, int(m[1]))) if m else least


class Table:
    """Rows of cells; a cell is (lines, columns, rows)."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def layout(self) -> Iterator[str]:
        """Lines with columns padded to equal widths and two spaces between them.

        Spans end where the grid ends: at the last row, and at as many columns as the longest row has cells. Text after a
        line that runs over its column follows it by two spaces. Blanks before a text (its own included) are at most
        ``WIDE + 2`` for each cell crossed that has such a line, so that spans, and cells that end beside long ones, can't
        make padding grow faster than the source. No rule looks at how many rows there are.
        """
        grid = self._grid()
        starts = self._starts(grid)
        for placed in grid:
            cells, i = placed if any(lines for _, _, lines in placed) else [], 0
            while cells:
                parts, at, room = [], 0, 0
                for c, _, lines in cells:
                    room += WIDE + 2
                    if lines and lines[i]:
                        own = len(lines[i]) - len(lines[i].lstrip(" "))
                        gap = max(2 * (at > 0), min(starts[c] - at, room - own))
                        parts.append(" " * gap + lines[i])
                        at += gap + len(lines[i])
                        room = 0
                yield "".join(parts).rstrip(" ")
                i += 1
                cells = [x for x in cells if len(x[2]) > i]

    def _grid(self) -> list[list[tuple[int, int, list[str]]]]:
        """Cells of each row as (column, columns, lines), beside what spans down from the rows above."""
        most, last = max(map(len, self.rows), default=0), len(self.rows)
        busy: dict[int, tuple[int, int]] = {}  # the columns from one to another are taken until a row
        grid = []
        for r, row in enumerate(self.rows):
            placed, c = [], 0
            for lines, wide, high in row:
                path, until = [], last
                while c in busy and busy[c][1] > r:
                    path.append(c)
                    until = min(until, busy[c][1])
                    c = busy[c][0]
                for x in path:
                    busy[x] = (c, until)  # those that come later go the whole way at once
                wide = min(wide, most)
                if high > 1:
                    for i in range(c, c + wide):
                        busy[i] = (c + wide, min(last, r + high))
                placed.append((c, wide, lines))
                c += wide
            grid.append(placed)
        return grid

    @staticmethod
    def _starts(grid: list[list[tuple[int, int, list[str]]]]) -> dict[int, int]:
        """Where each column that a cell begins in begins; a cell over several columns widens the last of them."""
        widths: dict[int, int] = {}
        spans, begins = [], set()
        for placed in grid:
            for c, wide, lines in placed:
                begins.add(c)
                size = max((len(x) for x in lines if len(x) <= WIDE), default=0)
                if wide == 1:
                    widths[c] = max(widths.get(c, 0), size)
                else:
                    spans.append((c + wide - 1, c, size))
        for end, _, _ in spans:
            widths.setdefault(end, 0)
        spans.sort()
        starts, at, s = {}, 0, 0
        for c in sorted(begins | widths.keys()):
            starts[c] = at
            at += widths.get(c, 0) + 2 * (widths.get(c, 0) > 0)
            while s < len(spans) and spans[s][0] == c:  # begins of those are known: they lie before
                at = max(at, starts[spans[s][1]] + spans[s][2] + 2 * (spans[s][2] > 0))
                s += 1
        return starts


def render(source: str | None) -> str:
    """All visible text of an HTML text, laid out; empty for null."""
    if not source:
        return ""
    tree = build_tree(source)
    sheets = [b for (k, a, _), (kind, b, _) in zip(tree.nodes, tree.nodes[1:], strict=False) if k == OPEN and a == "style" and kind == TEXT]
    rules, seen = Rules(sheets), True
    canvas, canvases, tables = Canvas(), [], []
    dark = 0  # depth within something hidden
    pre, lists, details, foreign = 0, [], [], 0
    opened: list[tuple] = []
    for kind, value, attrs in tree.nodes:
        if kind == TEXT:
            if not dark and seen and not (opened and opened[-1][0] == "details" and details[-1] == "closed"):
                if pre:
                    canvas.keep(value)
                else:
                    canvas.write(value)
            continue
        if kind == OPEN:
            if dark:
                dark += 1
                continue
            closed = bool(details) and details[-1] == "closed" and opened and opened[-1][0] == "details" and value != "summary"
            style = rules.of(value, attrs) if rules.by or "style" in attrs else {}
            if hidden(value, attrs, style, foreign > 0 or value == "svg") or closed:
                dark = 1
                continue
            visibility = style.get("visibility") or foreign and attrs.get("visibility") or "inherit"
            before, seen = seen, seen if visibility in ("inherit", "unset", "revert") else visibility not in ("hidden", "collapse")
            foreign += value in FOREIGN
            if foreign and (value in APART or opened[-1:] and opened[-1][0] == "mfrac"):
                canvas.write(" ")
            if value in BLOCK and value not in ("td", "th", "tr", *SECTIONS):
                nested = value in LISTS and bool(lists)
                canvas.block(1 if value in MARGIN and not nested else 0)
            state = None
            if value == "br":
                canvas.newline()
            elif value == "hr" and seen:
                canvas.add(["-" * 20])
                canvas.block(1)
            elif value in ("pre", "listing", "xmp", "textarea"):
                pre += 1
            elif value == "q" and seen:
                canvas.write('"')
            elif value in LISTS:
                lists.append([value, _number(attrs.get("start"), 1, 10**6) - 1])
            elif value == "li":
                if lists and lists[-1][0] == "ol":
                    lists[-1][1] = _number(attrs["value"], 0, 10**6) if "value" in attrs else lists[-1][1] + 1
                    state = f"{lists[-1][1]}. "
                else:
                    state = "- "
                state = state if seen else " " * len(state)
                canvas.indent.append(" " * len(state))
                canvas.mark = state
            elif value in ("dd", "blockquote"):
                canvas.indent.append("    ")
            elif value == "details":
                details.append("open" if "open" in attrs else "closed")
            elif value == "table":
                tables.append(Table())
            elif value == "tr" and tables:
                tables[-1].rows.append([])
            elif value in CELLS and tables:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                state = (_number(attrs.get("colspan"), 1, 1000), _number(attrs.get("rowspan"), 1, 65534))
                canvases.append((canvas, lists))
                canvas, lists = Canvas(), []
            elif value == "input" and attrs.get("type", "text").lower() in ("text", "button", "submit", "reset", "email", "search", "tel", "url", "number") and attrs.get("value") and seen:
                canvas.write(" " + attrs["value"] + " ")
            opened.append((value, state, before))
            continue
        if dark:
            dark -= 1
            continue
        tag, state, before = opened.pop()
        if foreign and tag in APART:
            canvas.write(" ")
        foreign -= tag in FOREIGN
        if tag in ("pre", "listing", "xmp", "textarea"):
            pre -= 1
        elif tag == "q" and seen:
            canvas.line.append('"') if canvas.line else canvas.write('"')
        elif tag in LISTS:
            lists.pop()
        elif tag == "li":
            if canvas.mark:  # an empty item
                canvas.newline()
            else:
                canvas.block()
            canvas.indent.pop()
        elif tag in ("dd", "blockquote"):
            canvas.block()
            canvas.indent.pop()
        elif tag == "details":
            details.pop()
        elif tag in CELLS and state:
            lines = canvas.done()
            canvas, lists = canvases.pop()
            tables[-1].rows[-1].append((lines, *state))
        elif tag == "table":
            canvas.block()
            canvas.add(tables.pop().layout())
        if tag in BLOCK and tag not in ("td", "th", "tr", *SECTIONS):
            canvas.block(1 if tag in MARGIN and not (tag in LISTS and lists) else 0)
        seen = before
    return "\n".join(canvas.done()).replace("\xa0", " ").strip("\n")


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, html): page_id, text, n_chars.

    A null or empty html gives an empty text; broken markup of any kind is read as browsers mostly do, and never fails.
    Rows with a null or repeated page_id stay as they are; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, texts, size = batch.slice(lo, 256), [], 0
                for i, source in enumerate(part.column("html").to_pylist(), 1):
                    texts.append(render(source))
                    size += len(texts[-1])
                    if size > BATCH_BYTES or i == part.num_rows:  # padding may make texts longer than their source
                        ids = part.column("page_id").slice(i - len(texts), len(texts))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "text", "n_chars"])
                        texts, size = [], 0

    return pages.select("page_id", "html").transform(mapped(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, n_chars long"))
