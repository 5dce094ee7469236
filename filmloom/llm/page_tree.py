"""Block tree of a web page: what the main-text model labels."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Fixed values of the markup language.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WHOLE = frozenset("html head body".split())  # the page itself, named or not
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style textarea title iframe noembed noframes noscript template svg math object canvas audio video select datalist button".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: A start tag ends an open element of these, up to the element that bounds the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
LANDMARKS = frozenset("article main nav aside header footer form section".split())
MOST_DEEP = 512  # tags of elements below are passed over, their text is kept

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(hidden)(?=[\s/]|$)""", re.S)
_NAMES = re.compile("[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}


@dataclass
class Page:
    """Nodes in page order, parents first: block elements, and runs of text with ``text`` set. Node 0 is the page."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    names: list[list[str]] = field(default_factory=lambda: [[]])
    marks: list[str | None] = field(default_factory=lambda: [None])
    texts: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])  # characters of a run inside links

    def add(self, tag: str, parent: int, names: list[str], mark: str | None = None, text: str | None = None, linked: int = 0) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.names.append(names)
        self.marks.append(mark)
        self.texts.append(text)
        self.linked.append(linked)
        return len(self.tags) - 1


def _attributes(source: str) -> tuple[list[str], str | None]:
    """Words of class, id and role, and the training mark."""
    if not source or source == "/":
        return [], None
    names, mark = [], None
    for name, a, b, c, hidden in _ATTRIBUTE.findall(source):
        name, value = name.lower(), a or b or c
        if hidden or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            names.append("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            names += [w.lower() for w in _NAMES.findall(value)]
        elif name == "data-mark":
            mark = value
    return list(dict.fromkeys(names)), mark


def parse(source: str) -> Page:
    """The block tree. Inline elements belong to the text around them; scripts, styles, comments and controls give no text.

    Unclosed and wrongly nested tags are mended as browsers do in the common cases. A run of text ends where a block
    element begins or ends; its character references are decoded, white space becomes one space, ends are trimmed,
    and a run without anything else is none.
    """
    page = Page()
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements; inline ones carry their block's node
    run: list[str] = []
    held: Counter[str] = Counter()  # open elements by tag
    links = linked = at = silent = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                page.add("#text", stack[-1][1], [], None, text, min(linked, len(text)))
            run.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal links, silent
        for tag, _ in stack[i:]:
            held[tag] -= 1
            links -= tag == "a"
            silent -= tag in SILENT
        if any(tag not in INLINE for tag, _ in stack[i:]):
            flush()
        del stack[i:]

    def innermost(wanted, bounds=frozenset()) -> int:
        for i in range(len(stack) - 1 if any(held[w] for w in wanted) else 0, 0, -1):
            if stack[i][0] in wanted:
                return i
            if stack[i][0] in bounds:
                return 0
        return 0

    for token in _TOKEN.finditer(source):
        if token.start() < at:  # inside a script or the like
            continue
        if token.start() > at and not silent:
            text = source[at:token.start()]
            run.append(text)
            linked += len(text) if links else 0
        at = token.end()
        end, tag, attributes = token.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in WHOLE:
            flush()
            continue
        if end:
            if tag in VOID:
                continue
            i = innermost({tag}, frozenset() if tag not in INLINE else LANDMARKS | {"div", "td", "th", "table"})
            if i:
                close(i)
            elif tag == "p":  # stands for an empty paragraph
                flush()
            continue
        if tag == "br":
            run.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            found = _RAW_END[tag].search(source, at)
            at = found.start() if found else len(source)
            continue
        if tag in CLOSES_P and (i := innermost({"p"}, {"table", "td", "th", "button"})):
            close(i)
        if tag in ENDS:
            while i := innermost(*ENDS[tag]):
                close(i)
        if tag == "a" and links and (i := innermost({"a"}, {"table", "td", "th"})):
            close(i)
        if tag not in INLINE:
            flush()
        if len(stack) > MOST_DEEP and tag not in SILENT:
            continue
        held[tag] += 1
        if tag in INLINE or tag in SILENT:
            stack.append((tag, stack[-1][1]))
            links += tag == "a"
            silent += tag in SILENT
            continue
        names, mark = _attributes(attributes)
        stack.append((tag, page.add(tag, stack[-1][1], names, mark)))
    if at < len(source) and not silent:
        run.append(source[at:])
    close(1)
    flush()
    return page
