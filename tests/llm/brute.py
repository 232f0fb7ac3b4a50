"""Plain versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def _holds(kind: str, match: str) -> bool:
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else d * 2 - 9 if d > 4 else d * 2 for k, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, rx) in enumerate(BASE) for m in rx.finditer(text or "") if _holds(kind, m.group())]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def digest_of_spans(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def repeated_bytes(texts: list[str | None], length: int) -> list[list[bool]]:
    """Per text, whether each byte lies in a ``length``-byte string that starts in two places or more."""
    raw, starts = [(t or "").encode() for t in texts], {}
    for b in raw:
        for i in range(len(b) - length + 1):
            starts[b[i : i + length]] = starts.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        covered = [False] * len(b)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                covered[i : i + length] = [True] * length
        out.append(covered)
    return out


def components(nodes: list, linked) -> dict:
    """Smallest reachable node of each, by comparing all pairs."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def plain_words(text: str | None) -> list[str]:
    """Lower-cased words between ASCII characters that are no letters or digits."""
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())


def in_order(a: list[str], b: list[str]) -> int:
    """How many words of ``a`` are in ``b`` in the same order."""
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        above = row
    return above[-1]


def holds_item(item: list[str], words: list[str], step: int = 64) -> bool:
    """Whether some passage has a part of the item, by comparing each with each.

    80% of the part in order, or 60% with four of its last five words, or 40% with all five; parts under 8 words stand together.
    """
    n = max(1, -(-len(item) // step))
    for j in range(n):
        part = item[len(item) * j // n : len(item) * (j + 1) // n]
        for at in range(0, len(words), step):
            passage = words[at : at + 2 * step]
            if 0 < len(part) < 8:
                if any(passage[i : i + len(part)] == part for i in range(len(passage))):
                    return True
            elif part:
                share, answer = in_order(part, passage) / len(part), in_order(part[-5:], passage)
                if share >= 0.8 or (share >= 0.6 and answer >= 4) or (share >= 0.4 and answer == 5):
                    return True
    return False
