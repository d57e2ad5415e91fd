"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from shardflow.llm.common import on_batches, pick

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_GAP = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; it ends at their own end tag alone.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Never shown. noscript is shown only where scripts are off, fallbacks of media only where these can't play.
UNSEEN = frozenset("head script style title template noscript iframe object embed applet audio video canvas datalist noembed noframes param rp source track link meta base area annotation annotation-xml".split())
#: Parts of a drawing that aren't drawn where they stand.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter title style script".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul tr caption thead tbody tfoot optgroup option mtr".split())
#: Blocks with an empty line before and after.
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure menu dir hr fieldset".split())
#: Elements that an end tag or an implied end doesn't reach beyond.
FENCE = frozenset("table td th caption html template object body".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = BLOCK - frozenset("html body tr thead tbody tfoot caption legend option optgroup mtr".split())
_P_STOPS = FENCE | {"button", "li", "dd", "div"}
#: A start tag ends the open elements named, up to the elements that stop it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_PARTS = frozenset("table tbody thead tfoot tr".split())
#: HTML elements that end a drawing or a formula, unless they stand where HTML may stand in it.
_BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_INSETS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Lists nested deeper get their marks but are not moved further in, and tables nested deeper are set line by
#: line: a layout with no end of columns would grow with the square of a page.
INSETS, TABLES = 40, 8


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class _Open:
    """The open elements; where the innermost of some tags stands is known without a search."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.at[self.stack.pop().tag].pop()

    def innermost(self, tags: Iterable[str]) -> int:
        """0 for none: the root is never ended."""
        at = self.at
        return max([p[-1] for t in tags if (p := at.get(t))], default=0)

    def end_implied(self, names: set[str], stops: set[str]) -> None:
        """Ends the innermost of names unless a stop is nearer, and what of names stands directly around it."""
        low = self.innermost(names)
        if not low or low < self.innermost(stops) or low < self.innermost(("table", "template")):
            return
        while low > 1 and self.stack[low - 1].tag in names and self.stack[low - 1].tag not in stops:
            low -= 1
        self.cut(low)


def parse(html: str) -> tuple[Node, list[str]]:
    """The element tree, and the texts of its style sheets. Missing html, head and body tags are as if there; start
    tags end what can't hold them; end tags without a start are dropped (</p> and </br> make an empty element); what is
    open at the end ends there."""
    root = Node("html")
    sheets: list[str] = []
    up = _Open(root)
    stack, at, n = up.stack, 0, len(html)
    fresh = False  # a line break that follows <pre> doesn't count

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            part = html[at:lt]
            if fresh:
                part = part.removeprefix("\r").removeprefix("\n")
            stack[-1].children.append(unescape(part) if "&" in part else part)
        fresh = False
        if lt >= n:
            break
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            continue
        if m[1]:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name not in ("html", "body"):
                same = _HEADINGS if name in _HEADINGS else (name,)
                low = up.innermost(same)
                fences = FENCE - {"td", "th", "caption"} - {name} if name in _PARTS else FENCE - {name}
                if low and low > up.innermost(fences):
                    up.cut(low)
                elif name == "p":
                    stack[-1].children.append(Node("p"))
            continue
        attrs: dict[str, str] = {}
        if m[3] and not m[3].isspace():
            for k, a, b, c in _ATTR.findall(m[3]):
                attrs.setdefault(k.lower(), unescape(a or b or c or ""))
        if name in ("html", "body") and (name == "html" or up.at.get("body")):
            continue
        foreign = up.innermost(("svg", "math"))
        if foreign and foreign < up.innermost(_INSETS):
            foreign = 0
        if foreign and (name in _BREAKOUT or name == "font" and attrs.keys() & {"color", "face", "size"}):
            up.cut(foreign)
            foreign = 0
        if not foreign:
            if name in IMPLIED:
                up.end_implied(*IMPLIED[name])
            if stack[-1].tag == "head" and name not in ("title", "meta", "link", "base", "style", "script", "noscript", "template"):
                up.cut(len(stack) - 1)
            if name in _CLOSES_P and (low := up.innermost("p")) and low > up.innermost(_P_STOPS):
                up.cut(low)
            if name in _HEADINGS and stack[-1].tag in _HEADINGS:
                up.cut(len(stack) - 1)
            if name == "a":
                up.end_implied({"a"}, FENCE)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in VOID or foreign and m[3].endswith("/") or name == "form" and stack[-1].tag in _PARTS:
            continue
        if name in RAW and (not foreign or name in ("script", "style", "title")):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at) if name != "plaintext" else None
            inner = html[at : close.start() if close else n]
            if name in ("textarea", "title"):
                node.children.append(unescape(inner.removeprefix("\r").removeprefix("\n")))
            elif name in ("xmp", "plaintext"):
                node.children.append(inner)
            elif name == "style" and attrs.get("media", "").strip().lower() in ("", "all", "screen"):
                sheets.append(inner)
            at = close.end() if close else n
            continue
        up.push(node)
        fresh = name in ("pre", "listing")
    return root, sheets


# style

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DECLARED = re.compile(r"((?:[^;\"'()]|\"[^\"]*\"|'[^']*'|\([^)]*\)|[\"'()])*)(?:;|\Z)")
_SIMPLE = re.compile(r"(?:\*|[a-z][\w-]*)?(?:[.#][\w-]+)*", re.I)
#: Properties that are followed, and the values that are told apart.
_FOLLOWED = {"display", "visibility", "white-space", "content-visibility"}
Rule = dict[str, tuple[bool, str]]


def declarations(style: str) -> Rule:
    """Followed properties of a list of declarations: whether important, and the value."""
    out: Rule = {}
    for d in _DECLARED.findall(_COMMENT.sub(" ", style)) if "/*" in style or '"' in style or "(" in style or "'" in style else style.split(";"):
        name, colon, value = d.partition(":")
        name = name.strip().lower()
        if colon and name in _FOLLOWED:
            value = value.strip().lower()
            strong = value.endswith("important") and value[:-9].rstrip().endswith("!")
            if strong:
                value = value[:-9].rstrip()[:-1].rstrip()
            if value and (strong or not out.get(name, (False, ""))[0]):
                out[name] = (strong, value)
    return out


class Sheet:
    """Rules of style sheets whose selectors are a tag, classes and an id in any combination. Others (relations,
    attributes, states) and conditional rules but those for screens are left out."""

    def __init__(self, texts: list[str]):
        #: By what an element must have: selectors and, by property, (important, rank), value.
        self.rules: dict[str, dict[tuple[str, frozenset[str], str], dict[str, tuple[tuple, str]]]] = {}
        self.seen: dict[tuple[str, str, str], dict[str, tuple[tuple, str]]] = {}
        self.n = 0
        for t in reversed(dict.fromkeys(reversed(texts))):  # of equal sheets the last counts
            self._read(_COMMENT.sub(" ", t).replace("<!--", " ").replace("-->", " "))

    def _read(self, css: str) -> None:
        at = 0
        while (brace := css.find("{", at)) >= 0:
            head = css[at:brace]
            head = head.rsplit(";", 1)[-1].rsplit("}", 1)[-1].strip()
            depth, end = 1, brace + 1
            if head.startswith("@"):
                while end < len(css) and depth:
                    depth += (css[end] == "{") - (css[end] == "}")
                    end += 1
                if re.fullmatch(r"@media\s+(?:only\s+)?(?:screen|all)", head, re.I) or re.match(r"@(?:layer|supports)\b", head, re.I):
                    self._read(css[brace + 1 : end - 1])
            else:
                end = css.find("}", brace)
                end = len(css) if end < 0 else end + 1
                body = declarations(css[brace + 1 : end].rstrip("}"))
                if body:
                    for s in head.split(","):
                        self._add(s.strip(), body)
            at = end

    def _add(self, selector: str, body: Rule) -> None:
        if not selector or not _SIMPLE.fullmatch(selector):
            return
        first = re.match(r"[^.#]*", selector)[0].lower()
        classes, ids = frozenset(re.findall(r"\.([\w-]+)", selector)), re.findall(r"#([\w-]+)", selector)
        tag = "" if first == "*" else first
        if len(set(ids)) > 1:
            return
        one = ids[0] if ids else ""
        key = f"#{one}" if one else f".{min(classes)}" if classes else tag
        self.n += 1
        at = self.rules.setdefault(key, {}).setdefault((tag, classes, one), {})
        for p, (strong, v) in body.items():
            rank = (strong, (0, len(ids), len(classes), bool(tag), self.n))
            if p not in at or rank > at[p][0]:
                at[p] = (rank, v)

    def _for(self, tag: str, classes: str, one: str) -> dict[str, tuple[tuple, str]]:
        best: dict[str, tuple[tuple, str]] = {}
        have = set(classes.split())
        for k in {"", tag, f"#{one}", *(f".{c}" for c in have)}:
            for (t, needs, i), body in self.rules.get(k, {}).items():
                if (not t or t == tag) and needs <= have and (not i or i == one):
                    for p, x in body.items():
                        if p not in best or x[0] > best[p][0]:
                            best[p] = x
        return best

    def of(self, node: Node) -> Rule:
        """What rules and the element's own style say; what is important wins, then the own style, then the more special rule."""
        a = node.attrs
        own = declarations(a["style"]) if "style" in a else {}
        if not self.rules:
            return own
        key = (node.tag, a.get("class", ""), a.get("id", ""))
        if key not in self.seen:
            self.seen[key] = self._for(*key)
        out = {p: (strong, v) for p, ((strong, _), v) in self.seen[key].items()}
        return out | {p: x for p, x in own.items() if p not in out or x[0] or not out[p][0]}


class _Style:
    """What holds for an element's text: whether it shows, is preformatted, is drawn (in a drawing not all text is), and in how
    many tables it stands."""

    __slots__ = ("shown", "pre", "drawn", "tables")

    def __init__(self, shown: bool = True, pre: bool = False, drawn: bool = True, tables: int = 0):
        self.shown, self.pre, self.drawn, self.tables = shown, pre, drawn, tables


# text


class _Out:
    """Lines of text; spaces collapse, blocks begin lines, and wide gaps are one empty line. Insets (list items) put
    their mark before their first line and as many spaces before the others; gaps inside them close."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.insets: list[str] = []
        self.marks: list[str] = []  # of insets whose first line is still to come

    def text(self, s: str) -> None:
        s = _GAP.sub(" ", s)
        if s.startswith(" "):
            self.space = True
        core = s.strip(" ")
        if core:
            self.put((" " if self.space and self.line else "") + core)
            self.space = s.endswith(" ")

    def put(self, s: str) -> None:
        if not self.line:
            if self.gap:
                self.lines.append("")
            if self.insets:
                rest = len(self.insets) - len(self.marks)
                self.line.append("".join([" " * len(x) for x in self.insets[: min(rest, INSETS)]] + self.marks))
                self.marks = []
        self.gap = False
        self.line.append(s)

    def end(self, force: bool = False) -> None:
        if self.line or force:
            self.lines.append("".join(self.line).rstrip(" "))
            if not self.line:
                self.gap = False
        self.line, self.space = [], False

    def apart(self) -> None:
        self.end()
        self.gap = self.gap or bool(self.lines) and self.lines[-1] != "" and not self.insets

    def open(self, mark: str) -> None:
        self.end()
        self.insets.append(mark)
        self.marks.append(mark)

    def shut(self) -> None:
        self.end()
        self.insets.pop()
        del self.marks[len(self.insets) :]

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Renderer:
    def __init__(self, sheet: Sheet):
        self.sheet = sheet

    def style(self, node: Node, up: _Style) -> _Style | None:
        """None for an element without a box, which hides all below it."""
        tag, a = node.tag, node.attrs
        if tag in UNSEEN or not up.drawn and tag in UNDRAWN:
            return None
        rule = self.sheet.of(node) if a or self.sheet.rules else {}
        display = rule["display"][1] if "display" in rule else ""
        if display == "none" or rule.get("content-visibility", (0, ""))[1] == "hidden":
            return None
        if not display and ("hidden" in a and a["hidden"].lower() != "until-found" or tag == "dialog" and "open" not in a):
            return None
        shown, pre = up.shown, up.pre
        if "visibility" in rule:
            v = rule["visibility"][1]
            shown = v == "visible" or v == "initial" or shown and v not in ("hidden", "collapse")
        if tag in ("pre", "xmp", "textarea", "listing", "plaintext"):
            pre = True
        if "white-space" in rule:
            w = rule["white-space"][1]
            pre = w in ("pre", "pre-wrap", "break-spaces") or pre and w not in ("normal", "nowrap", "initial", "pre-line")
        drawn = up.drawn
        if tag == "svg":
            drawn = False
        elif tag in ("text", "foreignobject"):
            drawn = True
        if shown == up.shown and pre == up.pre and drawn == up.drawn:
            return up
        return _Style(shown, pre, drawn, up.tables)

    def cells(self, row: Node, up: _Style, others: list) -> list[tuple[Node, _Style]]:
        out = []
        for c in row.children:
            if isinstance(c, str):
                if c.strip():
                    others.append((c, up))
            elif s := self.style(c, up):
                (out if c.tag in ("td", "th") else others).append((c, s))
        return out

    def rows(self, table: Node, up: _Style, others: list) -> list[list[tuple[Node, _Style]]]:
        rows, loose = [], None
        for c in table.children:
            if isinstance(c, str):
                if c.strip():
                    others.append((c, up))
                continue
            s = self.style(c, up)
            if not s:
                continue
            if c.tag in ("td", "th"):
                if loose is None:
                    rows.append(loose := [])
                loose.append((c, s))
                continue
            loose = None
            if c.tag == "tr":
                rows.append(self.cells(c, s, others))
            elif c.tag in ("thead", "tbody", "tfoot"):
                rows += self.rows(c, s, others)
            else:
                others.append((c, s))
        return rows

    def table(self, table: Node, out: _Out, up: _Style) -> None:
        """Cells in columns as wide as their widest line, two spaces apart; colspan and rowspan keep places free. What a table
        can't hold comes before it."""
        others: list[tuple[Node | str, _Style]] = []
        inside = _Style(up.shown, up.pre, up.drawn, up.tables + 1)
        rows = self.rows(table, inside, others)
        for c, s in others:
            self.render(c, out, s, styled=True)
            out.end()
        if up.tables >= TABLES:
            for row in rows:
                for cell, s in row:
                    self.render(cell, out, s, styled=True)
            return
        grid: list[list[tuple[int, int, list[str]]]] = []
        taken: list[tuple[int, int, int]] = []  # columns from, to; the row up to which a cell above covers them
        for r, row in enumerate(rows):
            taken = sorted(t for t in taken if t[2] > r)
            cells, new, col, k = [], [], 0, 0
            for cell, s in row:
                while k < len(taken) and taken[k][0] <= col:
                    col = max(col, taken[k][1])
                    k += 1
                inner = _Out()
                for x in cell.children:
                    self.render(x, inner, s)
                wide, high = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
                cells.append((col, wide, inner.done()))
                if high > 1:
                    new.append((col, col + wide, r + high))
                col += wide
            taken += new
            grid.append(cells)
        width: dict[int, int] = {}
        for cells in grid:
            for col, wide, lines in cells:
                width.setdefault(col, 0)
                if wide == 1:
                    width[col] = max(width[col], *(len(x) for x in lines or [""]))
        place, start = {}, 0
        for c in sorted(width):
            place[c] = start
            start += width[c] + 2 if width[c] else 0
        for cells in grid:
            for k in range(max((len(x) for _, _, x in cells), default=0)):
                line: list[str] = []
                at = 0
                for col, _, lines in cells:
                    if k < len(lines) and lines[k]:
                        gap = place[col] - at if at <= place[col] else 2
                        line += [" " * gap, lines[k]]
                        at += gap + len(lines[k])
                if line:
                    out.put("".join(line))
                out.end(True)

    def render(self, node: Node | str, out: _Out, up: _Style, number: list[int] | None = None, depth: int = 0, styled: bool = False) -> None:
        """Adds what shows of an element, or of a piece of text; styled: `up` is the element's own style."""
        if isinstance(node, str):
            if not up.shown or not up.drawn:
                return
            if not up.pre:
                out.text(node)
                return
            for k, part in enumerate(node.split("\n")):
                if k:
                    out.end(True)
                if part := part.rstrip("\r"):
                    out.put(part)
            return
        s = up if styled else self.style(node, up)
        if not s:
            return
        tag = node.tag
        if tag == "br":
            out.end(True)
            return
        if tag in ("img", "input"):
            kind = node.attrs.get("type", "").lower() if tag == "input" else "image"
            label = node.attrs.get("alt" if kind == "image" else "value", "") if kind in ("image", "submit", "reset", "button") else ""
            if s.shown and s.drawn and label.strip():
                out.text(label)
            return
        if tag == "table":
            out.apart()
            self.table(node, out, s)
            out.apart()
            return
        block = tag in BLOCK
        nested = tag in ("ul", "ol") and depth
        if tag in APART and not nested:
            out.apart()
        elif block or tag in ("td", "th"):
            out.end()
        if tag in ("ul", "ol", "menu", "dir"):
            first = node.attrs.get("start", "1")
            number, depth = [int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1] if tag == "ol" else [], depth + 1
        elif tag == "li":
            mark = "- "
            if number:
                value = node.attrs.get("value", "")
                number[0] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number[0]
                mark = f"{number[0]}. "
                number[0] += 1
            out.open(mark)
            number = None
        elif tag == "dd":
            out.open("  ")
        elif tag == "q":
            if s.shown:
                out.put((" " if out.space and out.line else "") + '"')
                out.space = False
        elif tag in ("text", "mtd"):
            out.text(" ")
        some: Iterable = node.children
        if tag == "details" and "open" not in node.attrs:
            some = [c for c in some if isinstance(c, Node) and c.tag == "summary"][:1]
        for c in some:
            self.render(c, out, s, number, depth)
        if tag in ("li", "dd"):
            out.shut()
        elif tag == "q":
            if s.shown:
                out.put('"')
        elif tag in ("text", "mtd"):
            out.text(" ")
        if tag in APART and not nested:
            out.apart()
        elif block or tag in ("td", "th"):
            out.end()


def _span(node: Node, name: str, most: int) -> int:
    """As browsers read it: a whole number up to a bound that the standard gives."""
    s = node.attrs.get(name, "1").strip()
    return min(max(int(s), 1), most) if s.isascii() and s.isdigit() and len(s) < 10 else 1


def visible_text(html: str) -> str:
    """All visible text of a page."""
    root, sheets = parse(html)
    # Elements nest as deep as a page has them; calls between Python functions take heap, no stack.
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 4 * html.count("<") + 2000))
    try:
        out = _Out()
        Renderer(Sheet(sheets)).render(root, out, _Style())
        return "\n".join(out.done())
    finally:
        sys.setrecursionlimit(before)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text for every row: all text that a browser would show, none that it hides.

    Tags that HTML implies are supplied (paragraphs, list items, table parts, head and body). Left out are scripts,
    styles, templates, fallbacks of media, closed dialogs and what closed details hold below their summary, and elements
    hidden by attribute, by their own style or by a rule of a <style> sheet whose selector is made of a tag, classes
    and an id (display, visibility, content-visibility; a visible child of an invisible element shows), at any depth.
    Texts of drawings and formulas, labels of buttons and alternative texts of images are shown; aria-hidden hides
    nothing. Blocks begin lines, paragraphs stand apart, list items have marks or numbers, table cells are aligned in
    columns, preformatted text keeps its spaces. Beyond 40 nested lists and 8 nested tables the text goes on without more
    indent or columns. Whole pages are read. Null and empty pages give an empty text. Rows that repeat give equal rows;
    an empty table gives no rows; other columns are ignored.
    """
    base = pick(pages, page_id=id_col, html=html_col)
    kind = base.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [visible_text(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return on_batches(base, run, f"page_id {kind}, text string")
