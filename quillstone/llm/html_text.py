"""Layout-aware rendering of HTML as text.

A tree builder adds the tags that HTML implies (it ends p, li, dt, dd, option,
tr, td and table sections where a following tag ends them, and unclosed
elements at the end of what holds them), visibility rules leave out what a
browser doesn't show, and the tree is rendered with block spacing, list
markers and tables whose columns are aligned, with cells that span rows or
columns in their place. Visibility comes from tags, attributes, inline styles,
and the rules of <style> elements whose selectors are a tag, classes and an id
(others, and rules inside of @media, aren't applied); a visible child of an
element with hidden visibility is shown. Form controls show their options and
text, one line for each.

Every open tag is found through its own stack, and inner lists and tables are
rendered before outer ones, so the time is linear in a page's tags however deep
they nest (text that stands in n lists or tables is moved n times).

Defined results: null and empty pages render as ''. Broken markup never fails:
a `<` that starts no tag is text, unknown closing tags are passed over. Very
long pages are rendered whole. Each row gives one row, repeated rows and null
ids included; an empty table gives an empty one. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import lean, pieces

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
HIDDEN = frozenset("head title script style template noscript iframe object svg math canvas audio video datalist".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
#: Raw elements whose text may hold character references.
ESCAPED = frozenset({"textarea", "title"})
#: Elements whose children are rendered by themselves.
PARTED = frozenset("table thead tbody tfoot tr ul ol menu".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption option optgroup textarea".split())
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
#: An open p ends where one of these starts.
ENDS_P = BLOCK - {"body", "html", "caption", "li", "dd", "dt", "legend", "summary", "option", "optgroup", "textarea"}
#: Tags that end an open element: tag -> (elements that it ends, elements at which the search stops)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Closing tags don't reach beyond these.
SCOPE = frozenset({"table", "td", "th", "caption", "html", "body", "template"})

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DECLARED = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.DOTALL)
_BRACE = re.compile(r"[{}]")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$")
_WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "lines", "pruned", "shown", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        #: whether it isn't rendered at all, whether its own text is visible, and its lines (of children of PARTED)
        self.pruned, self.shown, self.lines = False, True, None


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


class _Open:
    """The open elements, with the places of each tag's, so that the nearest is found at once."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def nearest(self, tags) -> int:
        """The place of the innermost open element with one of the tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def outermost(self, tags, above: int) -> int | None:
        """The place of the outermost one above a place."""
        found = []
        for t in tags:
            held = self.places.get(t, ())
            i = bisect.bisect_right(held, above)
            if i < len(held):
                found.append(held[i])
        return min(found, default=None)

    def end(self, position: int) -> None:
        while len(self.stack) > position:
            self.places[self.stack.pop().tag].pop()


def build(page: str) -> Node:
    """The page's tree, with the elements that its tags imply."""
    root = Node("html", {})
    opened = _Open(root)
    stack = opened.stack
    closers: dict[str, re.Pattern] = {}
    unclosed: set[str] = set()

    def open_(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID:
            opened.push(node)

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else n]
        if text:
            stack[-1].children.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "br":
                open_("br", {})
                continue
            place = opened.nearest((tag,))
            # closing tags of cells, rows and tables reach out of anything in them, others stop at SCOPE
            if place and (tag in SCOPE or tag in ("tr", "thead", "tbody", "tfoot") or place > opened.nearest(SCOPE)):
                opened.end(place)
            continue
        if tag in ("html", "body"):
            for k, v in _attributes(found[3] or "").items():
                root.attributes.setdefault(k, v)
            continue
        if tag in ENDS_P:
            place = opened.nearest(("p",))
            if place and place > opened.nearest((*SCOPE, "button")):
                opened.end(place)
        if tag in IMPLIED:
            ended, stop = IMPLIED[tag]
            cut = opened.outermost(ended, opened.nearest(stop))
            if cut is not None:
                opened.end(cut)
            if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                open_("tr", {})
        attributes = _attributes(found[3]) if found[3] and not found[3].isspace() else {}
        if tag in RAW:
            closer = closers.setdefault(tag, re.compile(f"</{re.escape(tag)}[^>]*(?:>|$)", re.IGNORECASE))
            close = None if tag in unclosed else closer.search(page, at)
            if close is None:
                unclosed.add(tag)
            node = Node(tag, attributes)
            raw = page[at : close.start() if close else n]
            node.children.append(html.unescape(raw) if tag in ESCAPED else raw)
            stack[-1].children.append(node)
            at = close.end() if close else n
        else:
            open_(tag, attributes)
    return root


def _declared(style: str) -> dict[str, str]:
    return {name.lower(): value.lower() for name, value in _DECLARED.findall(style)}


class _Rules:
    """display and visibility by the page's style elements, looked up by tag, class and id.

    Rules of equal selectors are one entry, which holds the weight and value of
    each property's last rule, and elements of equal tag, classes and id are
    looked up once.
    """

    def __init__(self):
        self.by: dict[str, dict[tuple, dict[str, tuple]]] = {}
        self.known: dict[tuple, dict[str, str]] = {}
        self.count = 0

    def add(self, sheet: str) -> None:
        sheet, start, held = _COMMENT.sub(" ", sheet), 0, []
        for brace in _BRACE.finditer(sheet):
            before, start = sheet[start : brace.start()], brace.end()
            if brace[0] == "{":
                held.append(before.rsplit(";", 1)[-1])
            elif held:
                selectors = held.pop()
                if not held and "@" not in selectors:
                    self._rule(selectors, _declared(before))

    def _rule(self, selectors: str, values: dict[str, str]) -> None:
        for selector in selectors.split(",") if values else ():
            parts = _SELECTOR.fullmatch(selector.strip())
            if not parts or not selector.strip():
                continue
            names = re.findall(r"[.#][\w-]+", parts[2])
            tag = (parts[1] or "*").lower()
            weight = (sum(x[0] == "#" for x in names), sum(x[0] == "." for x in names), tag != "*", self.count)
            self.count += 1
            key = (tag, tuple(sorted(set(names))))
            # an entry lies under the one of its names that has fewest
            at = next((n for n in names if key in self.by.get(n, ())), min(names, key=lambda n: len(self.by.get(n, ())), default=tag))
            self.by.setdefault(at, {}).setdefault(key, {}).update({name: (weight, value) for name, value in values.items()})

    def of(self, node: Node) -> dict[str, str]:
        names = {f".{c}" for c in node.attributes.get("class", "").split()}
        if "id" in node.attributes:
            names.add(f"#{node.attributes['id']}")
        key = (node.tag, *sorted(names))
        if key not in self.known:
            best: dict[str, tuple] = {}
            for name in (*names, node.tag, "*"):
                for (tag, needed), values in self.by.get(name, {}).items():
                    if tag in ("*", node.tag) and names.issuperset(needed):
                        for of, weighed in values.items():
                            if of not in best or weighed[0] > best[of][0]:
                                best[of] = weighed
            self.known[key] = {of: value for of, (_, value) in best.items()}
        return dict(self.known[key])


def _mark(root: Node) -> list[Node]:
    """Sets what is pruned and what is visible; the children of PARTED in the page's order."""
    rules, parted = _Rules(), []
    sheets = [root]
    while sheets:
        x = sheets.pop()
        if x.tag == "style":
            rules.add("".join(x.children))
        else:
            sheets.extend(c for c in reversed(x.children) if not isinstance(c, str))
    todo = [(root, True, False)]
    while todo:
        x, shown, apart = todo.pop()
        a = x.attributes
        style = rules.of(x) if rules.by else {}
        if "style" in a:
            style |= _declared(a["style"])
        display = style.get("display", "none" if "hidden" in a else "")
        x.pruned = x.tag in HIDDEN or x.tag == "input" or display == "none" or a.get("aria-hidden", "").lower() == "true" or (x.tag == "dialog" and "open" not in a and display == "")
        if x.pruned and x is not root:
            continue
        visibility = style.get("visibility", "inherit")
        x.shown = shown if visibility not in ("visible", "hidden", "collapse") else visibility == "visible"
        if apart:
            parted.append(x)
        todo.extend((c, x.shown, x.tag in PARTED) for c in reversed(x.children) if not isinstance(c, str))
    return parted


class _Lines:
    """Lines of text, with white space collapsed, and empty lines where blocks ask for them."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap = False

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *others = text.split("\n")
            self.line.append(first)
            for x in others:
                self.break_(force=True)
                self.line.append(x)
            return
        self.line.append(_WHITE.sub(" ", text))

    def break_(self, force: bool = False, space: bool = False, keep: bool = False) -> None:
        line = "".join(self.line)
        if not keep:
            line = re.sub(" {2,}", " ", line).strip(" ") if not force else line.rstrip(" ")
        self.line = []
        if line.strip(" ") or (force and self.done and not self.gap):
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.done.append(line)
        self.gap = self.gap or (space and bool(self.done))

    def finish(self) -> list[str]:
        self.break_()
        while self.done and not self.done[-1].strip():
            self.done.pop()
        return self.done


def _span(cell: Node, name: str, most: int) -> int:
    """A cell's colspan or rowspan, up to what HTML allows."""
    value = cell.attributes.get(name, "1").strip()
    return min(max(int(value[:6]), 1), most) if value.isdecimal() and value.isascii() else 1


def _table(node: Node) -> list[str]:
    rows: list[list[str]] = []
    captions: list[str] = []
    taken: dict[int, int] = {}  # column -> rows for which a cell above still stands there

    def bare(text: str, shown: bool) -> list[str]:
        return [_WHITE.sub(" ", text).strip()] if shown and text.strip() else []

    def row_of(x: Node) -> None:
        row: dict[int, str] = {}
        spans: list[tuple[int, int]] = []
        at = 0
        for cell in x.children:
            text = isinstance(cell, str)
            if text and not bare(cell, x.shown) or not text and cell.pruned:
                continue
            while taken.get(at):
                at += 1
            row[at] = bare(cell, x.shown)[0] if text else " ".join(y for y in (z.strip() for z in cell.lines) if y)
            width, height = (1, 1) if text else (_span(cell, "colspan", 1000), _span(cell, "rowspan", 65534))
            if height > 1:
                spans += [(c, height) for c in range(at, at + width)]
            at += width
        for c in [c for c, n in taken.items() if n <= 1]:
            del taken[c]
        for c in taken:
            taken[c] -= 1
        taken.update((c, n - 1) for c, n in spans)
        if any(row.values()):
            rows.append([row.get(i, "") for i in range(at)])

    sections = [iter(node.children)]
    while sections:
        child = next(sections[-1], None)
        if child is None:
            sections.pop()
            if sections:
                taken.clear()  # cells don't reach out of their section
        elif isinstance(child, str):
            captions += bare(child, node.shown)
        elif child.pruned or child.tag in ("col", "colgroup"):
            continue
        elif child.tag == "tr":
            row_of(child)
        elif child.tag in ("thead", "tbody", "tfoot"):
            sections.append(iter(child.children))
        else:
            captions.extend(child.lines)
    widths: list[int] = []
    for row in rows:
        widths += [0] * (len(row) - len(widths))
        for i, cell in enumerate(row[:-1]):
            widths[i] = max(widths[i], len(cell))
    return captions + ["  ".join([*(c.ljust(w) for c, w in zip(row[:-1], widths, strict=False)), row[-1]]).rstrip() for row in rows]


def _list(node: Node) -> list[str]:
    lines: list[str] = []
    number = int(node.attributes["start"]) if re.fullmatch("-?[0-9]{1,9}", node.attributes.get("start", "")) else 1
    for child in node.children:
        if isinstance(child, str):
            lines += [_WHITE.sub(" ", child).strip()] if node.shown and child.strip() else []
        elif not child.pruned:
            mark = ""
            if child.tag == "li":
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
            own = [y for y in child.lines if y.strip()]
            lines += [(mark if i == 0 else " " * len(mark)) + y for i, y in enumerate(own)]
    return lines


def _render(node: Node) -> list[str]:
    """The lines of a node's visible text; the children of PARTED in it have theirs."""
    out = _Lines()
    # an own stack: a page's nesting may be deeper than Python's
    todo: list[tuple] = [("in", node, False, True)]
    while todo:
        what, x, keep, shown = todo.pop()
        if what == "end":
            out.break_(space=x in SPACED, keep=keep)
            continue
        if what == "text" or isinstance(x, str):
            if shown:
                out.text(x, keep)
            continue
        if x is not node and x.pruned:
            continue
        tag, shown = x.tag, x.shown
        if tag == "br":
            out.break_(force=True)
        elif tag == "img":
            if shown and x.attributes.get("alt"):
                out.text(x.attributes["alt"], False)
        elif tag != "wbr":
            block = tag in BLOCK and x is not node
            if block:
                out.break_(space=tag in SPACED, keep=keep)
            if tag == "hr":
                continue
            if tag == "table" or (tag in ("ul", "ol", "menu") and block):
                lines = _table(x) if tag == "table" else _list(x)
                if lines or (tag == "table" and block):
                    if out.gap and out.done:
                        out.done.append("")
                    out.gap = False
                    out.done.extend(lines)
                    out.gap = bool(out.done)
                continue
            keep = keep or tag in ("pre", "textarea")
            if block:
                todo.append(("end", tag, keep, shown))
            if tag in ("td", "th") and x is not node:  # a cell outside of a table
                out.text(" ", False)
                todo.append(("text", " ", False, True))
            todo.extend(("in", child, keep, shown) for child in reversed(x.children))
    return out.finish()


def render(root: Node) -> list[str]:
    """The lines of a page's visible text."""
    for x in reversed(_mark(root)):
        # rows and sections are parts of their table, wherever they stand right
        x.lines = [] if x.tag in ("tr", "thead", "tbody", "tfoot") else _whole(x)
    return _render(root)


def _whole(x: Node) -> list[str]:
    """The lines of a child of PARTED, which may itself be a list or a table."""
    return _table(x) if x.tag == "table" else _list(x) if x.tag in ("ul", "ol", "menu") else _render(x)


def text_of(page: str | None) -> str:
    return "\n".join(render(build(page))) if page else ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id and the visible text of each page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for at, part in pieces(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(map(text_of, part.to_pylist()), pa.string())], ["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string")
