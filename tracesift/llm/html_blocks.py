"""HTML pages as sequences of leaf blocks: a block's text and the path of elements around it."""

from __future__ import annotations

import re
from html import unescape

#: Elements that end the block before them and begin another.
BREAKING = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose content is no markup; none of it is text of the page.
RAW = frozenset("script style title textarea iframe xmp noembed noframes template noscript svg math object video audio canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the key ends where one of these begins, unless one of ``_SCOPE`` is between.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"},
}
_SCOPE = frozenset("table ul ol dl select body html td th article aside section nav div main".split())
_ENDS_P = BREAKING - frozenset("br body button caption head html legend optgroup option select tbody td textarea tfoot th thead title tr".split())
_MARKUP = re.compile(r"<!--(?:>|->|[\s\S]*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)")
_PLACE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
MAX_DEPTH = 512  # deeper elements count as part of the one at this depth

Path = tuple[str, ...]


def _element(name: str, attributes: str) -> str:
    """An element of a path: its name, then the parts of its class, id and role, all in lower case."""
    if not attributes or not attributes.strip(" /\n\t"):
        return name
    parts = [name]
    for m in _PLACE.finditer(attributes):
        value = m.group(2) or m.group(3) or m.group(4) or (m.group(1) if m.group(1).lower() == "hidden" else "")
        parts += [t.lower() for t in _TOKEN.findall(value)]
    return " ".join(parts)


class _Raw:
    """Finds the end of a raw element; what has no end runs to the end of the page."""

    cache: dict[str, re.Pattern] = {}

    @classmethod
    def end(cls, name: str, html: str, at: int) -> int:
        rx = cls.cache.get(name) or cls.cache.setdefault(name, re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE))
        m = rx.search(html, at)
        return m.end() if m else len(html)


def leaf_blocks(html: str) -> list[tuple[Path, str, int]]:
    """(path, text, characters inside links) of every block that has text, in page order.

    Character references are decoded, white space inside a block becomes one space. Inline elements do not
    cut a block; comments, scripts, styles and other raw elements have no text.
    """
    blocks: list[tuple[Path, str, int]] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked: list[str] = []
    path: Path = ()

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append((path, text, min(len(text), len(" ".join("".join(linked).split())))))
            held.clear()
            linked.clear()

    def close(depth: int) -> None:
        """Ends every open element from this depth on."""
        if any(n in BREAKING for n, _ in stack[depth:]):
            flush()
        del stack[depth:]

    def say(piece: str) -> None:
        nonlocal path
        if not held:
            path = tuple(e for _, e in stack)
        piece = unescape(piece) if "&" in piece else piece
        held.append(piece)
        if any(n == "a" for n, _ in stack):
            linked.append(piece)

    at, end = 0, len(html)
    while at < end:
        m = _MARKUP.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at and (held or not html[at : m.start()].isspace()):
            say(html[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if m.group(1):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if stack[depth][0] in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            else:
                if name in BREAKING:
                    flush()
            continue
        if name in RAW:
            if not m.group(3).rstrip().endswith("/"):
                at = _Raw.end(name, html, at)
            if name in BREAKING:
                flush()
            continue
        if name in BREAKING:
            flush()
        if name in VOID:
            continue
        if name in _ENDS_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in BREAKING:
                    break
        ends = _CLOSES.get(name)
        if ends:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    close(depth)
                    ends = ends if name in ("tr", "tbody", "thead", "tfoot") else ()
                elif stack[depth][0] in _SCOPE and stack[depth][0] not in ("td", "th"):
                    break
        if len(stack) < MAX_DEPTH:
            stack.append((name, _element(name, m.group(3))))
    flush()
    return blocks
