"""A page as a tree of blocks: elements that break lines, with the text blocks between them as leaves.

Follows the HTML standard where it shapes blocks: implied ends of p, li, dt, dd, option, cells and rows, void and raw
text elements, comments, character references, attributes in either quotes or none. Formatting elements only tell how
much of a leaf is linked. Elements nested deeper than ``DEEPEST`` count as children of the deepest one, as browsers
do, so that work stays in proportion to the length of a page.
"""

from __future__ import annotations

import html
import re

DEEPEST = 512
#: Element classes, fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split()) | {"hr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends, if it is open, and what shields an open one from that.
ENDS = {
    "li": (("li",), frozenset("ul ol menu dir table".split())),
    "dt": (("dt", "dd"), frozenset("dl table".split())),
    "dd": (("dt", "dd"), frozenset("dl table".split())),
    "option": (("option",), frozenset("select datalist optgroup".split())),
    "td": (("td", "th"), frozenset("table tr".split())),
    "th": (("td", "th"), frozenset("table tr".split())),
    "tr": (("tr",), frozenset("table tbody thead tfoot".split())),
    "tbody": (("tbody", "thead", "tfoot"), frozenset(["table"])),
    "thead": (("tbody", "thead", "tfoot"), frozenset(["table"])),
    "tfoot": (("tbody", "thead", "tfoot"), frozenset(["table"])),
}
P_SCOPE = frozenset("button table td th caption object marquee applet template html".split())
#: What a reader never sees as text.
UNSEEN = frozenset("noscript template select datalist button svg math object audio video canvas map".split())

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
_NAME_END = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
#: A comment may also close at once, as in ``<!-->``.
_COMMENT_END = re.compile(r"-->|--!>|(?<=<!--)-?>")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Tree:
    """Nodes in page order: ``parent`` (-1 at the root), ``depth``, ``tag`` ('' for a leaf), ``tokens`` of class, id and
    role, ``mark`` (value of data-main, or None), and for leaves ``text`` with ``linked``, its code points in links."""

    def __init__(self):
        self.parent, self.depth, self.tag, self.tokens, self.mark, self.text, self.linked = [-1], [0], ["html"], [()], [None], [None], [0]

    def add(self, parent: int, tag: str, tokens=(), mark=None, text=None, linked=0) -> int:
        for held, x in ((self.parent, parent), (self.depth, self.depth[parent] + 1), (self.tag, tag), (self.tokens, tokens), (self.mark, mark), (self.text, text), (self.linked, linked)):
            held.append(x)
        return len(self.parent) - 1


def _tag_end(page: str, at: int) -> int:
    """Place after the ``>`` that ends a tag whose name ended at ``at``; -1 if the page ends first."""
    while True:
        m = _NAME_END.search(page, at)
        if m is None:
            return -1
        at = m.end()
        if m[0] == ">":
            return at
        before = m.start() - 1
        while page[before].isspace():
            before -= 1
        if page[before] == "=":  # only then does the quote hold a value
            at = page.find(m[0], at) + 1
            if not at:
                return -1


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def parse(page: str) -> Tree:
    tree, pieces, linked = Tree(), [], 0
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # name, node of the block, unseen
    count: dict[str, int] = {}
    links = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tree.add(stack[-1][1], "", text=text, linked=min(linked, len(text)))
            pieces.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][2]:
            if "&" in raw:
                raw = html.unescape(raw)
            pieces.append(raw)
            if links:
                linked += len(raw)

    def pop(to: int) -> None:
        """Close everything above and at place ``to`` of the stack."""
        nonlocal links
        if any(name in BLOCK for name, _, _ in stack[to:]):
            flush()
        for name, _, _ in stack[to:]:
            count[name] -= 1
        del stack[to:]
        links = count.get("a", 0)

    def close(names: tuple[str, ...], shields: frozenset[str]) -> bool:
        if any(count.get(n) for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    pop(i)
                    return True
                if stack[i][0] in shields:
                    return False
        return False

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        ending, name = m[1], (m[2] or "").lower()
        if not name:
            if page.startswith("<!--", m.start()):
                end = _COMMENT_END.search(page, m.start() + 4)
                at = end.end() if end else len(page)
            else:
                end = page.find(">", m.end())
                at = end + 1 if end >= 0 else len(page)
            continue
        at = _tag_end(page, m.end())
        if at < 0:
            break
        if ending:
            if name == "br":
                text(" ")
            elif name == "p" and not close(("p",), P_SCOPE):
                flush()
            elif name in HEADINGS:
                close(tuple(HEADINGS), P_SCOPE)
            elif name in BLOCK and name not in ("html", "body", "p"):
                close((name,), frozenset(["table"]) if name not in ("table", "form") else frozenset())
            elif name not in BLOCK:
                close((name,), BLOCK)
            continue
        if name in CLOSES_P:
            close(("p",), P_SCOPE)
        if name in HEADINGS and stack[-1][0] in HEADINGS:
            pop(len(stack) - 1)
        if name in ENDS:
            close(*ENDS[name])
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                text("\n")
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            if end is None:
                break
            at = _tag_end(page, end.end())
            if at < 0:
                break
            continue
        if name in ("html", "head"):
            continue
        if name == "body" and count.get("body"):
            continue
        raw = page[m.end() : at - 1]
        attrs = _attributes(raw) if "=" in raw or "hidden" in raw else {}
        unseen = stack[-1][2] or name in UNSEEN or "hidden" in attrs or bool(_HIDDEN.search(attrs.get("style", "")))
        node = stack[-1][1]
        if name in BLOCK:
            flush()
            if len(stack) <= DEEPEST:
                tokens = tuple({t.lower() for k in ("class", "id", "role") for t in _TOKEN.findall(attrs.get(k, ""))})
                node = tree.add(node, name, tokens, attrs.get("data-main"))
        if len(stack) <= DEEPEST:
            stack.append((name, node, unseen))
            count[name] = count.get(name, 0) + 1
            links = count.get("a", 0)
    flush()
    return tree
