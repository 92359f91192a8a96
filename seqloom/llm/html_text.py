"""HTML extraction by layout-aware rendering.

A scanner and tree builder make a tree with implied tags (a block start closes p; li, dt, dd, option, tr, td and th close their
like; void elements; unclosed ones close with their parent; stray end tags are dropped). For each tag the builder knows where its open
elements are on the stack, so closing needs no search and a page takes time in proportion to its length.

Visibility rules leave out head, scripts, styles, templates, noscript (as scripts count as on), contents that stand in for embedded
objects, hidden and display:none elements, closed details and dialogs, the options of a menu that aren't shown, and what svg and math hold beside
their text; visibility:hidden hides text until a descendant is visible. display and visibility come from style attributes and from
the rules of style elements whose selectors are made of a tag, classes and an id; other selectors and the contents of at-rules are not applied.

The renderer emits all visible text: white space collapses outside pre and textarea, blocks start lines, paragraphs, headings, lists and tables
have blank lines around them, list items have a bullet or number and indentation, and table cells are padded to columns, with
colspan and rowspan. Buttons made by input show their value.

Trees are walked with explicit stacks, so depth is no limit. Defined results: null or empty html gives an empty text; broken mark-up
is read as browsers do in outline (an unclosed tag at the end is dropped). Repeated rows are rendered each; an empty table gives no rows; very
long pages are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string as schema

from . import common

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes object audio video canvas desc metadata defs symbol annotation annotation-xml".split())
PUSHED = frozenset("submit button reset".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption tr thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset menu hr".split())
CLOSES_P = BLOCK - {"body", "html", "tr", "thead", "tbody", "tfoot", "caption", "legend"}
#: What a start tag closes, and the elements at which the search for it ends.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
SCOPES = frozenset({"table", "td", "th", "caption", "html", "template", "object", "button"})
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
SELECTOR = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)", re.I)
ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>]|$)", re.I | re.A) for tag in RAW}
#: Most columns and rows that a cell spans, by the HTML standard.
COLSPAN, ROWSPAN = 1000, 65534


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


def tag_end(s: str, at: int) -> int:
    """Place of the > that ends a tag; quoted attribute values may hold one. -1 if there is none."""
    gt = first = s.find(">", at)
    while gt != -1:
        quote = min((q for q in (s.find('"', at, gt), s.find("'", at, gt)) if q != -1), default=-1)
        if quote == -1:
            return gt
        close = s.find(s[quote], quote + 1)
        if close == -1:
            return first
        at = close + 1
        if at > gt:
            gt = s.find(">", at)
    return first


def attributes(s: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(s):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def declared(style: str) -> dict[str, tuple[str, bool]]:
    """Value of display and visibility, and whether it is important."""
    out: dict = {}
    for m in DECLARED.finditer(COMMENT.sub(" ", style)):
        if m[3] or not out.get(m[1].lower(), ("", False))[1]:
            out[m[1].lower()] = (m[2].lower(), bool(m[3]))
    return out


class Rules:
    """Rules of style elements, found by an id, class or tag of their selector."""

    def __init__(self, sheets: list[str]):
        self.by: dict[str, list] = {}
        n = 0
        for sheet in sheets:
            for selectors, style in blocks(COMMENT.sub(" ", sheet)):
                if not (values := declared(style)):
                    continue
                for selector in selectors.split(","):
                    m = SELECTOR.fullmatch(selector.strip())
                    if not m or not m[0]:
                        continue
                    tag, parts = (m[1] or "*").lower(), re.findall(r"[.#][\w-]+", m[2])
                    ids = sum(x[0] == "#" for x in parts)
                    n += 1
                    key = next((x for x in parts if x[0] == "#"), parts[0] if parts else tag)
                    self.by.setdefault(key, []).append((tag, frozenset(parts), (ids, len(parts) - ids, tag != "*", n), values))

    def of(self, node: Node) -> dict[str, str]:
        """display and visibility of an element, where anything says so."""
        own = declared(node.attrs["style"]) if "style" in node.attrs else {}
        if not self.by:
            return {k: v for k, (v, _) in own.items()}
        names = {f".{c}" for c in node.attrs.get("class", "").split()} | ({f"#{node.attrs['id']}"} if "id" in node.attrs else set())
        best = {k: ((important, 1), v) for k, (v, important) in own.items()}
        for key in (*names, node.tag, "*"):
            for tag, parts, rank, values in self.by.get(key, ()):
                if tag in ("*", node.tag) and parts <= names:
                    for k, (v, important) in values.items():
                        if k not in best or best[k][0] < (important, 0, rank):
                            best[k] = ((important, 0, rank), v)
        return {k: v for k, (_, v) in best.items()}


def blocks(sheet: str):
    """(selectors, declarations) of the rules outside at-rules."""
    depth, start, head = 0, 0, ""
    for m in re.finditer("[{};]", sheet):
        if m[0] == "{":
            if not depth:
                head = sheet[start : m.start()].strip()
                start = m.end()
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
            if not depth:
                if head and not head.startswith("@"):
                    yield head, sheet[start : m.start()]
                head, start = "", m.end()
        elif not depth:
            start = m.end()


def parse(s: str) -> tuple[Node, list[str]]:
    """The tree, whose text kids are strings, and the texts of style elements."""
    root = Node("html", {})
    stack, where, sheets = [root], {"html": [0]}, []

    def last(tags) -> int:
        """Place of the innermost open element of these tags, -1 if there is none."""
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    def close(at: int) -> None:
        while len(stack) > at:
            where[stack.pop().tag].pop()

    def close_implied(names, ends) -> None:
        # a row ends with its cells: look further up for what else closes
        while (at := last(names)) > max(last(ends), 0):
            close(at)

    at, n = 0, len(s)
    while at < n:
        lt = s.find("<", at)
        if lt == -1:
            stack[-1].kids.append(unescape(s[at:]))
            break
        if lt > at:
            stack[-1].kids.append(unescape(s[at:lt]))
        nxt = s[lt + 1 : lt + 2]
        if s.startswith("<!--", lt):
            end = s.find("-->", lt + 4)
            at = n if end == -1 else end + 3
            continue
        if nxt in ("!", "?"):
            end = s.find(">", lt)
            at = n if end == -1 else end + 1
            continue
        closing = nxt == "/"
        m = NAME.match(s, lt + 1 + closing)
        if not m:
            stack[-1].kids.append("<")
            at = lt + 1
            continue
        tag = m[0].lower()
        end = tag_end(s, m.end())
        if end == -1:
            break
        at = end + 1
        if closing:
            if tag != "html" and (own := last((tag,))) > 0:
                if tag in BLOCK or tag in ("td", "th") or own > last(("td", "th", "table")):
                    close(own)
            elif tag == "br":
                stack[-1].kids.append(Node("br", {}))
            continue
        attrs = attributes(s[m.end() : end]) if end - m.end() > 1 else {}
        if tag == "html":
            continue
        if tag in IMPLIED:
            close_implied(*IMPLIED[tag])
        if (tag == "body" or tag in BLOCK) and where.get("head"):
            close(where["head"][-1])
        if tag in CLOSES_P and where.get("p"):
            close_implied({"p"}, SCOPES)
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in ("pre", "textarea") and s.startswith("\n", at):
            at += 1
        if tag in RAW:
            end = ENDS[tag].search(s, at)
            text = s[at : end.start() if end else n]
            node.kids.append(unescape(text) if tag in ("textarea", "title") else text)
            if tag == "style":
                sheets.append(text)
            gt = s.find(">", end.end()) if end else -1
            at = n if gt == -1 else gt + 1
            continue
        where.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root, sheets


class Canvas:
    """Lines of text; gaps between blocks are made when text follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = self.space = False
        self.holes = 0  # blank lines of a pre that text follows
        self.mark: str | None = None  # bullet that the next text gets
        self.indent = ""

    def text(self, s: str) -> None:
        parts = SPACE.sub(" ", s)
        if parts.startswith(" "):
            self.space = self.space or bool(self.now)
        body = parts.strip(" ")
        if body:
            self._begin()
            self.now.append((" " if self.space else "") + body)
            self.space = parts.endswith(" ")

    def pre(self, s: str) -> None:
        for i, line in enumerate(s.split("\n")):
            if i:
                self.holes += not self.now
                self.line()
            if line.strip():
                self._begin()
                self.now.append(line)

    def whole(self, lines: list[str]) -> None:
        """Lines that are already laid out."""
        for line in lines:
            self.line()
            self._begin()
            self.now.append(line)
        self.line()

    def _begin(self) -> None:
        if not self.now:
            if self.lines:
                self.lines += [""] * (1 if self.blank else self.holes)
            self.blank, self.space, self.holes = False, False, 0
            if self.mark is not None:
                self.now.append(self.indent[: -len(self.mark)] + self.mark)
                self.mark = None
            else:
                self.now.append(self.indent)

    def line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def gap(self) -> None:
        self.line()
        self.blank = True

    def done(self) -> str:
        self.line()
        return "\n".join(self.lines)


def hidden(node: Node, style: dict[str, str]) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and not pushed(a)):
        return True
    return style["display"] == "none" if "display" in style else "hidden" in a


def pushed(attrs: dict) -> bool:
    """An input that is a button with a text."""
    return attrs.get("type", "").lower() in PUSHED and bool(attrs.get("value"))


def shown_options(select: Node) -> list:
    """What a menu shows: all options of a list, else the last selected one, else the first."""
    options: list[Node] = []
    waiting = [select]
    while waiting:
        node = waiting.pop()
        if node.tag == "option":
            options.append(node)
        else:
            waiting += [k for k in reversed(node.kids) if isinstance(k, Node)]
    size = select.attrs.get("size", "1")
    if "multiple" in select.attrs or (size.isdecimal() and int(size) > 1):
        return options
    return ([o for o in options if "selected" in o.attrs] or options[:1])[-1:]


def spans(attrs: dict, name: str, most: int) -> int:
    v = attrs.get(name, "")
    return min(most, max(1, int(v[:9]))) if v.isascii() and v.isdecimal() else 1


def grid(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Cells (text, columns, rows) padded to columns; a cell of several lines makes a row of several."""
    taken: dict[int, int] = {}  # the row up to which a cell above holds a column
    placed: list[list[tuple[int, int, list[str]]]] = []
    for r, row in enumerate(rows):
        at, out = 0, []
        for text, wide, high in row:
            while taken.get(at, 0) > r:
                at += 1
            out.append((at, wide, text.split("\n")))
            if high > 1:
                taken |= dict.fromkeys(range(at, at + wide), r + high)
            at += wide
        placed.append(out)
    columns = sorted({at for row in placed for at, _, _ in row})
    width = dict.fromkeys(columns, 0)
    several = [c for row in placed if len(row) > 1 for c in row]
    for at, wide, lines in sorted(several, key=lambda c: c[1]):
        inside = columns[bisect_left(columns, at) : bisect_left(columns, at + wide)]
        width[inside[-1]] = max(width[inside[-1]], max(map(len, lines)) - sum(width[c] + 2 for c in inside[:-1]))
    place, x = {}, 0
    for c in columns:
        place[c] = x
        x += width[c] + 2
    out = []
    for row in placed:
        if not any(lines != [""] for _, _, lines in row):
            continue
        for k in range(max(len(lines) for _, _, lines in row)):
            line = ""
            for at, _, lines in row:
                if k < len(lines) and lines[k]:
                    line = line.ljust(place[at]) + lines[k]
            out.append(line.rstrip())
    return out


def render(root: Node, rules: Rules) -> str:
    canvas, outer = Canvas(), []  # outer: canvases around the present cell
    tables: list[list[list[tuple[str, int, int]]]] = []
    lists: list[list] = []
    walk: list[tuple] = [("in", root, True)]
    pre = 0
    while walk:
        do, node, shown = walk.pop()
        if do == "in":
            if isinstance(node, str):
                if shown:
                    if pre:
                        canvas.pre(node)
                    else:
                        canvas.text(node)
                continue
            style = rules.of(node)
            if hidden(node, style):
                continue
            if "visibility" in style:
                shown = style["visibility"] not in ("hidden", "collapse")
            tag = node.tag
            if tag == "input":
                if shown:
                    canvas.text(f" {node.attrs['value']} ")
                continue
            if tag == "br":
                if canvas.now:
                    canvas.line()
                elif canvas.lines:
                    canvas.blank = True
                continue
            if tag == "hr":
                canvas.gap()
                if shown:
                    canvas.text("---")
                canvas.gap()
                continue
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                canvas.gap()
            elif tag in BLOCK:
                canvas.line()
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                canvas.mark, canvas.indent = mark, canvas.indent + " " * len(mark)
                walk.append(("unindent", node, len(mark)))
            elif tag in ("blockquote", "dd"):
                canvas.indent += "  "
                walk.append(("unindent", node, 2))
            elif tag in ("pre", "textarea"):
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                outer.append((canvas, pre, lists))
                canvas, pre, lists = Canvas(), 0, []
            walk.append(("out", node, shown))
            kids = node.kids
            if tag == "details" and "open" not in node.attrs:
                kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"]
            elif tag == "select":
                kids = [x for k in shown_options(node) for x in (" ", k)]
            walk += [("in", k, shown) for k in reversed(kids)]
        elif do == "unindent":
            canvas.indent = canvas.indent[: len(canvas.indent) - shown]
            canvas.mark = None
        else:
            tag = node.tag
            if tag in ("td", "th") and tables:
                cell = canvas.done()
                canvas, pre, lists = outer.pop()
                tables[-1][-1].append((cell, spans(node.attrs, "colspan", COLSPAN), spans(node.attrs, "rowspan", ROWSPAN)))
            elif tag == "table":
                canvas.whole(grid(tables.pop()))
            elif tag in ("ul", "ol", "menu"):
                lists.pop()
            elif tag in ("pre", "textarea"):
                pre -= 1
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                canvas.gap()
            elif tag in BLOCK:
                canvas.line()
    return canvas.done()


def extract(html: str | None) -> str:
    if not html:
        return ""
    root, sheets = parse(html)
    return render(root, Rules(sheets))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines of every page."""

    def make():
        def work(batch):
            out = [extract(s) for s in common.texts(batch, "html")]
            return {"page_id": batch.column("page_id"), "text": out, "n_chars": list(map(len, out)), "n_lines": [t.count("\n") + 1 if t else 0 for t in out]}

        return work

    return common.map_batches(pages.select("page_id", "html"), make, schema("page_id long, text string, n_chars long, n_lines long"))
