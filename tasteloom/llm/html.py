"""A forgiving reader of HTML: token streams and element trees of pages as they are found."""

from __future__ import annotations

import re
from html import unescape

# Element names with a meaning of their own (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
    option p pre section select summary table tbody td tfoot th thead tr ul""".split())
CLOSES = {  # an open element of these names ends where an element of the key begins
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table td th article section main aside nav div form body blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(?=/?[a-zA-Z])[^<]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("name", "mark", "children")

    def __init__(self, name: str, mark: str):
        self.name, self.mark, self.children = name, mark, []


def tokens(html: str):
    """(kind, name or text, attributes) with kind "open", "close", "text" or "raw" (the inside of an
    element whose text is no markup). Comments and declarations are left out."""
    at = 0
    while at < len(html):
        found = _TOKEN.search(html, at)
        if not found:
            yield "text", html[at:], ""
            return
        if found.start() > at:
            yield "text", html[at:found.start()], ""
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            yield "close", name, ""
            continue
        yield "open", name, found[3]
        if name in RAW and not found[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(html, at)
            yield "raw", html[at:end.start() if end else len(html)], ""
            yield "close", name, ""
            at = end.end() if end else len(html)


def mark(attributes: str) -> str:
    """Class, id and role words of an element in lower case."""
    return " ".join(sorted({word for _, value in _NAMES.findall(attributes)
                            for word in unescape(value.strip("\"'")).lower().split()})) if attributes else ""


def parse(html: str) -> Element:
    """The tree of a page. Inline elements are transparent: only block structure and text remain.
    Missing end tags are supplied, unexpected ones ignored."""
    root = Element("#root", "")
    stack, hidden = [root], None
    for kind, value, attributes in tokens(html):
        if kind == "raw":
            continue
        if kind == "text" or (kind, value) == ("open", "br"):
            last, text = stack[-1].children, value if kind == "text" else " "
            if last and isinstance(last[-1], str):
                last[-1] += text
            else:
                last.append(text)
        elif kind == "open":
            if value not in BLOCK or value in RAW:
                continue
            if value not in ("html", "body", "head"):
                _close(stack, CLOSES.get(value, {"p"}), value)
            elif any(e.name == value for e in stack):
                continue
            element = Element(value, mark(attributes))
            stack[-1].children.append(element)
            if value not in VOID and not (attributes.endswith("/") and value != "p"):
                stack.append(element)
        elif value in BLOCK:
            if value in ("html", "body"):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == value:
                    del stack[depth:]
                    break
                if stack[depth].name in ("td", "th") and value not in ("tr", "table", "tbody", "thead", "tfoot"):
                    break
    return root


def _close(stack: list, names, opening: str) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        name = stack[depth].name
        if name in names:
            del stack[depth:]
            _close(stack, names, opening)
            return
        if name in SCOPES:
            return


def plain(text: str) -> str:
    """Character references decoded, runs of white space turned into a space, trimmed."""
    return _SPACE.sub(" ", unescape(text) if "&" in text else text).strip()
