"""Main text of web pages: a bidirectional LSTM labels every leaf block with the whole page in view.

1. A page becomes the sequence of its leaf blocks (``html_blocks``). A block's input is its tag path
   (element names and the parts of their class, id and role, hashed), its words (hashed) and four numbers:
   length, share of linked text, sentence end, digits.
2. Two LSTMs in numpy read the sequence forwards and backwards; a block's label comes from both states, so
   it depends on everything before and after it.
3. The labeller is fitted here on a bounded sample of ``TRAIN_PAGES`` distinct pages (the first
   ``TRAIN_CHARS`` characters of each), labelled by their own markup where that is clear (``labels_by_markup``),
   and on ``DRAWN_PAGES`` block sequences that put texts of these pages into other page layouts, so that layouts
   with menus, notices, forms and reader comments are known even where the sample has none.
   Its weights, some 4 MB whatever the corpus, go to the tasks.
4. Every page is parsed and labelled whole, in one map over the table; nothing shuffles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Path, leaf_blocks

TRAIN_PAGES = 256
TRAIN_CHARS = 100_000
DRAWN_PAGES = 768
TRAIN_BLOCKS = 96  # blocks of a training sequence
STEPS = 400
BATCH = 24
HIDDEN = 16
PATH_BINS, WORD_BINS, NUMBERS = 8192, 48, 4
_GROUP = 1 << 14  # blocks labelled at a time, when a page has fewer

#: Words in class, id or role of an element that holds no main text.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "comment comments commentlist reply replies respond discussion disqus sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related "
    "recommended footer masthead topbar toolbar skip search form copyright legal disclaimer hidden".split()
)
_MAIN = frozenset(("article", "main"))
_NO_MAIN = frozenset("nav footer aside form button select menu dialog label fieldset legend option search".split())


def labels_by_markup(blocks: Sequence[tuple[Path, str, int]]) -> np.ndarray | None:
    """Which blocks are main text, where a page says so: inside ``article`` or ``main`` and in no element that is
    boilerplate by its name or class. None for a page with neither element."""
    inside, plain = [], []
    for path, _, _ in blocks:
        parts = [e.split(" ") for e in path]
        names = [p[0] for p in parts]
        here = any(n in _MAIN for n in names) or any("main" in p[1:] for p in parts)
        first = next((i for i, n in enumerate(names) if n in _MAIN), len(names))
        bad = any(n in _NO_MAIN for n in names) or any(t in BOILERPLATE for p in parts for t in p[1:]) or "header" in names[:first]
        inside.append(here)
        plain.append(here and not bad)
    return np.array(plain, np.float32) if any(inside) else None


# ---- block inputs -----------------------------------------------------------------------------------
def path_bins(path: Path) -> list[int]:
    """Bins of a path: every element name, every part of a class, id or role, and the innermost name."""
    found = set()
    for element in path:
        name, *parts = element.split(" ")
        found.add("t:" + name)
        found.update("c:" + p for p in parts)
    if path:
        found.add("l:" + path[-1].split(" ")[0])
    return sorted({zlib.crc32(f.encode()) % PATH_BINS for f in found})


class _WordBins(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        b = self[word] = zlib.crc32(word.encode()) % WORD_BINS
        return b


_words = _WordBins()
_NO_DIGITS = str.maketrans("", "", "0123456789")


def block_numbers(text: str, linked: int) -> np.ndarray:
    """Relative word frequencies by bin, then log length, linked share, sentence end, share of digits."""
    words = text.split(" ")
    out = np.empty(WORD_BINS + NUMBERS, np.float32)
    out[:WORD_BINS] = np.bincount(np.fromiter(map(_words.__getitem__, words), np.int64, len(words)), minlength=WORD_BINS)
    out[:WORD_BINS] /= len(words)
    out[WORD_BINS:] = np.log1p(len(text)) / 6, linked / len(text), text[-1] in ".!?…。", 1 - len(text.translate(_NO_DIGITS)) / len(text)
    return out


class Page:
    """A block sequence as numbers: the place of each block's path in ``paths``, and the dense inputs."""

    def __init__(self, blocks: Sequence[tuple[Path, str, int]], paths: dict[Path, int]) -> None:
        self.paths = np.array([paths.setdefault(p, len(paths)) for p, _, _ in blocks], np.int64)
        self.dense = np.stack([block_numbers(t, n) for _, t, n in blocks]) if blocks else np.zeros((0, WORD_BINS + NUMBERS), np.float32)


def _multi_hot(paths: Sequence[Path]) -> np.ndarray:
    out = np.zeros((len(paths), PATH_BINS), np.float32)
    for i, p in enumerate(paths):
        out[i, path_bins(p)] = 1
    return out


# ---- the network ------------------------------------------------------------------------------------
def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Random weights; those of path bins start at zero, so that a bin never seen in training adds nothing."""
    w: dict[str, np.ndarray] = {"out": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), "out_b": np.zeros(1, np.float32)}
    for d in "fb":
        w[d + "path"] = np.zeros((PATH_BINS, 4 * HIDDEN), np.float32)
        w[d + "dense"] = rng.normal(0, 0.2, (WORD_BINS + NUMBERS, 4 * HIDDEN)).astype(np.float32)
        w[d + "state"] = rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w[d + "bias"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # forget gates start open
    return w


def _scan(inputs: np.ndarray, state: np.ndarray, active: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
    """One LSTM over (time, page, gates) inputs; ``active[t]`` pages, the longest first, still have a block at time t."""
    steps, pages, _ = inputs.shape
    out = np.zeros((steps, pages, HIDDEN), np.float32)
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps):
        n = pages if active is None else int(active[t])
        a = inputs[t, :n] + h[:n] @ state
        gates = _sigmoid(a[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
        before = c[:n]
        c = f * before + i * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((i, f, o, g, before, tc, h[:n]))
        h = o * tc
        out[t, :n] = h
    return out


def _scan_back(keep: list, d_out: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of the state weights."""
    steps, pages, _ = d_out.shape
    d_in, d_state = np.zeros((steps, pages, 4 * HIDDEN), np.float32), np.zeros_like(state)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, tc, h = keep[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        d = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        d_in[t] = d
        d_state += h.T @ d
        dh, dc = d @ state.T, dc * f
    return d_in, d_state


def _padded(pages: Sequence[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(paths, dense, mask, place of each page's block when read backwards), time first."""
    sizes = np.array([len(p.paths) for p in pages])
    steps = int(sizes.max())
    paths = np.zeros((steps, len(pages)), np.int64)
    dense = np.zeros((steps, len(pages), WORD_BINS + NUMBERS), np.float32)
    for k, p in enumerate(pages):
        paths[: sizes[k], k], dense[: sizes[k], k] = p.paths, p.dense
    t = np.arange(steps)[:, None]
    return paths, dense, t < sizes, np.where(t < sizes, sizes - 1 - t, t)


def _turned(x: np.ndarray, back: np.ndarray) -> np.ndarray:
    return x[back, np.arange(x.shape[1])]


def _gradients(w: dict[str, np.ndarray], pages: Sequence[Page], labels: Sequence[np.ndarray], hot: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    paths, dense, mask, back = _padded(pages)
    y = np.zeros(mask.shape, np.float32)
    for k, x in enumerate(labels):
        y[: len(x), k] = x
    used, where = np.unique(paths, return_inverse=True)
    where = where.reshape(paths.shape)
    bins = hot[used]
    states, kept = {}, {}
    for d in "fb":
        inputs = (bins @ w[d + "path"])[where] + dense @ w[d + "dense"] + w[d + "bias"]
        kept[d] = []
        h = _scan(_turned(inputs, back) if d == "b" else inputs, w[d + "state"], keep=kept[d])
        states[d] = _turned(h, back) if d == "b" else h
    both = np.concatenate([states["f"], states["b"]], axis=2)
    p = _sigmoid(both @ w["out"] + w["out_b"])
    loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / mask.sum())
    d_logit = (mask * (p - y) / mask.sum()).astype(np.float32)
    grads = {"out": np.einsum("tb,tbh->h", d_logit, both), "out_b": d_logit.sum(keepdims=True).reshape(1)}
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        d_h = d_logit[:, :, None] * w["out"][part]
        d_in, grads[d + "state"] = _scan_back(kept[d], _turned(d_h, back) if d == "b" else d_h, w[d + "state"])
        d_in = _turned(d_in, back) if d == "b" else d_in
        flat = d_in.reshape(-1, 4 * HIDDEN)
        by_path = np.zeros((len(used), 4 * HIDDEN), np.float32)
        np.add.at(by_path, where.ravel(), flat)
        grads[d + "path"], grads[d + "bias"] = bins.T @ by_path, flat.sum(0)
        grads[d + "dense"] = dense.reshape(-1, dense.shape[2]).T @ flat
    return loss, grads


def fit_labeller(pages: Sequence[tuple[Sequence[tuple[Path, str, int]], np.ndarray]], seed: int = 0, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights fitted on labelled block sequences by Adam on the mean log loss of a batch's blocks."""
    rng, paths = np.random.default_rng(seed), {}
    data = [(Page(b[:TRAIN_BLOCKS], paths), y[:TRAIN_BLOCKS]) for b, y in pages if len(b)]
    w = new_weights(rng)
    if not data:
        return w
    hot = _multi_hot(list(paths))
    seen = np.flatnonzero(hot.any(axis=0))
    hot, whole = hot[:, seen], {d + "path": w[d + "path"] for d in "fb"}
    w |= {k: x[seen] for k, x in whole.items()}
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    for step in range(1, steps + 1):
        picked = rng.integers(0, len(data), BATCH)
        _, grads = _gradients(w, [data[i][0] for i in picked], [data[i][1] for i in picked], hot)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            if k.endswith("dense"):
                w[k][:WORD_BINS] *= 1 - 0.5 * rate  # words say little about layout
    for k, x in whole.items():
        x[seen] = w[k]
    return w | whole


class Labeller:
    """Applies fitted weights to any number of pages."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w, self.paths, self.gates = weights, {}, {}

    def _path_gates(self, d: str) -> np.ndarray:
        known = self.gates.get(d)
        have = 0 if known is None else len(known)
        if have < len(self.paths):
            new = [np.sum(self.w[d + "path"][path_bins(p)], axis=0, dtype=np.float32) for p in list(self.paths)[have:]]
            self.gates[d] = np.concatenate([known, np.stack(new)]) if have else np.stack(new)
        return self.gates[d]

    def scores(self, pages: Sequence[Sequence[tuple[Path, str, int]]]) -> list[np.ndarray]:
        """Probability of main text for every block."""
        if len(self.paths) > 1 << 16:
            self.paths, self.gates = {}, {}
        coded = [Page(b, self.paths) for b in pages]
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: -len(pages[k]))
        at = 0
        while at < len(order):
            longest = len(pages[order[at]])
            group = order[at : at + max(1, _GROUP // longest)]
            at += len(group)
            paths, dense, mask, back = _padded([coded[k] for k in group])
            active, logit = mask.sum(1), np.zeros(mask.shape, np.float32) + self.w["out_b"]
            for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
                inputs = self._path_gates(d)[paths] + dense @ self.w[d + "dense"] + self.w[d + "bias"]
                h = _scan(_turned(inputs, back) if d == "b" else inputs, self.w[d + "state"], active)
                logit += (_turned(h, back) if d == "b" else h) @ self.w["out"][part]
            p = _sigmoid(logit)
            for j, k in enumerate(group):
                out[k] = p[: len(pages[k]), j]
        return out

    def main_texts(self, htmls: Sequence[str]) -> list[tuple[str, int, int]]:
        """(main text, blocks, blocks kept) of each page."""
        pages = [leaf_blocks(h) for h in htmls]
        out = []
        for blocks, p in zip(pages, self.scores(pages)):
            kept = [b[1] for b, x in zip(blocks, p) if x > 0.5]
            out.append((" ".join(kept), len(blocks), len(kept)))
        return out


# ---- training pages ---------------------------------------------------------------------------------
_HOLDERS = [
    ("article",), ("main",), ("main", "article"), ("div content",), ("div main content",), ("div post", "div post content"), ("section article body",), ("div entry content",),
    ("article", "section"), ("article post", "div entry"), ("div story",), ("main content",), ("table", "tr", "td"), ("div ?",), ("div article", "div text"), ("div",), (),
]
_WRAPPERS = [(), (), ("div wrapper",), ("div container",), ("div page",), ("div ?",), ("div", "div"), ("div layout", "div row")]
_LINKS = [
    ("nav", "ul", "li", "a"), ("nav", "a"), ("div menu", "ul", "li", "a"), ("header", "nav", "ul", "li", "a"), ("ul navigation", "li", "a"), ("ol breadcrumb", "li", "a"),
    ("div breadcrumbs", "a"), ("nav pagination", "a"), ("div share", "ul", "li", "a"), ("div social", "a"), ("div related", "ul", "li", "a"), ("aside", "ul", "li", "a"),
    ("div sidebar", "ul", "li", "a"), ("footer", "ul", "li", "a"), ("section related articles", "ul", "li", "a"), ("menu", "li", "a"), ("aside sidebar", "nav", "ul", "li", "a"),
]
_NOTES = [
    ("div ad",), ("div ads", "p"), ("div advert",), ("div advertisement", "p"), ("div sponsored", "p"), ("aside", "p"), ("aside ad",), ("section ad", "p"), ("div banner",), ("div promo", "p"), ("div cookie notice", "p"),
    ("div cookie banner",), ("div cookie consent", "p"), ("div cookies", "p"), ("div notice",), ("div notice", "p"), ("div alert",), ("div gdpr", "p"), ("section notice", "p"), ("p notice",), ("div popup", "p"),
    ("div newsletter", "p"), ("form", "p"), ("form", "label"), ("form newsletter", "label"), ("form search", "button"), ("form", "select", "option"), ("form", "fieldset", "legend"), ("form", "div"), ("div subscribe", "form", "p"),
    ("button",), ("form login", "label"), ("aside sidebar", "h3"), ("aside sidebar", "p"), ("div sidebar", "p"), ("div sidebar widget", "h3"), ("header", "p"), ("header", "h1"), ("header", "div logo"),
    ("header site header", "a"), ("div masthead",), ("div topbar", "p"), ("div modal", "p"), ("dialog", "p"), ("div disclaimer", "p"), ("aside notice", "p"), ("header", "h2"), ("aside", "h2"), ("aside", "div"),
]
_TALK = [
    ("section comments", "div comment", "p"), ("div comments", "div comment", "p"), ("div comments", "p"), ("section comments", "article comment", "p"), ("ol commentlist", "li comment", "p"), ("ul comments", "li"),
    ("div comment list", "div comment body", "p"), ("section comments", "div comment"), ("div comments area", "div reply", "p"), ("div discussion", "p"), ("aside comments", "p"), ("section comments", "p"), ("div comment",), ("div comments", "ul", "li"),
    ("div comment", "p"), ("section discussion", "article", "p"), ("div reader comments", "p"), ("div user comments", "blockquote"), ("div disqus thread", "p"), ("section reader comments", "div", "p"),
]
_ENDS = [("footer",), ("footer", "p"), ("div footer",), ("footer", "div"), ("footer site footer", "small"), ("div copyright",), ("footer", "p copyright"), ("div legal", "p")]
_KINDS = [("p",), ("p",), ("p",), ("p",), ("p", "b"), ("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("blockquote",), ("pre",), ("figure", "figcaption"), ("table", "tr", "td"), ("dl", "dd"), ("div",), ("section", "p"), ("div", "p"), ("div ?", "p")]
_FILLER = "it was said that most of them went home early and others stayed until the end of the day. some words more, and a few for good measure.".split()


def drawn_pages(texts: Sequence[str], n: int, seed: int = 0) -> list[tuple[list[tuple[Path, str, int]], np.ndarray]]:
    """Block sequences of many layouts, with texts (and pieces of texts) put into them at random; ``?`` is any class."""
    rng = np.random.default_rng(seed)
    pool = [t for t in texts if t] or [" ".join(_FILLER)]

    def pick(items):
        return items[int(rng.integers(len(items)))]

    def named(elements: Path) -> Path:
        return tuple(e.replace("?", "x" + str(int(rng.integers(1 << 30)))) for e in elements)

    def piece(most: int) -> str:
        words = pick(pool)[:4000].split(" ")
        at = int(rng.integers(len(words)))
        return " ".join(words[at : at + 1 + int(rng.integers(most))]) or words[0] or "and"

    def said() -> str:
        return piece(8) if rng.random() < 0.35 else piece(80) if rng.random() < 0.6 else pick(pool)[:2000].strip() or "and"

    out = []
    for _ in range(n):
        blocks: list[tuple[Path, str, int]] = []
        labels: list[int] = []
        base = ("html", "body", *named(pick(_WRAPPERS)))

        def add(path: Path, text: str, main: int, linked: bool = False) -> None:
            blocks.append((path, text, len(text) if linked else 0))
            labels.append(main)

        def links(at: Path) -> None:
            where = at + pick(_LINKS)
            for _ in range(int(rng.integers(1, 8))):
                add(where, piece(3), 0, True)

        def notes(at: Path) -> None:
            where = at + pick(_NOTES)
            for _ in range(int(rng.integers(1, 3))):
                add(where, said(), 0, rng.random() < 0.1)

        def talk(at: Path) -> None:
            where = pick(_TALK)
            if rng.random() < 0.6:
                add((*at, where[0], pick(["h2", "h3", "p"])), piece(4), 0)
            for _ in range(int(rng.integers(1, 7))):
                if rng.random() < 0.3:
                    add((*at, *where[:-1], pick(["span author", "div author", "cite", "h4"])), piece(3), 0)
                add((*at, *where), said(), 0)

        for _ in range(int(rng.integers(0, 4))):
            (links if rng.random() < 0.5 else notes)(base)
        holder = (*base, *named(pick(_HOLDERS)))
        if rng.random() < 0.8:
            add((*holder, *pick([("h1",), ("header", "h1"), ("h2",), ("h1 title",)] if set(holder) & _MAIN else [("h1",), ("h2",), ("h1 title",)])), piece(14), 1)
        for _ in range(int(rng.integers(1, 16))):
            where = (*holder, *named(pick(_KINDS)))
            for _ in range(int(rng.integers(1, 5))):
                add(where, said(), 1, rng.random() < 0.03)
            if rng.random() < 0.1:
                pick([links, notes])(holder)
        if rng.random() < 0.15:
            talk(holder)
        for _ in range(int(rng.integers(0, 4))):
            pick([links, notes, talk])(base)
        if rng.random() < 0.8:
            where = base + pick(_ENDS)
            for _ in range(int(rng.integers(1, 3))):
                add(where, said(), 0)
        out.append((blocks, np.array(labels, np.float32)))
    return out


def sample_pages(pages: DataFrame, html_col: str = "html", n: int = TRAIN_PAGES) -> list[str]:
    """The first ``TRAIN_CHARS`` characters of ``n`` distinct pages, picked by a hash of the page (n rows to the driver)."""
    keyed = pages.select(F.xxhash64(pages[html_col].cast("string")).alias("h"), pages[html_col].cast("string").alias("html")).filter("html IS NOT NULL")
    first = [r["h"] for r in keyed.select("h").distinct().orderBy(F.xxhash64("h", F.lit("sample")), "h").limit(n).collect()]
    if not first:
        return []
    some = keyed.filter(F.col("h").isin(first)).select("h", F.substring("html", 1, TRAIN_CHARS).alias("html")).groupBy("h").agg(F.min("html").alias("html"))
    return [r["html"] for r in sorted(some.collect(), key=lambda r: r["h"])]


def fit_on_pages(htmls: Sequence[str], seed: int = 0) -> dict[str, np.ndarray]:
    """The labeller for pages like these: on those with clear markup, and on their texts in other layouts."""
    parsed = [leaf_blocks(h) for h in htmls]
    marked = [(b, y) for b in parsed if (y := labels_by_markup(b[:TRAIN_BLOCKS])) is not None]
    texts = [t for b in parsed for _, t, _ in b[:TRAIN_BLOCKS]]
    return fit_labeller(marked + drawn_pages(texts, DRAWN_PAGES, seed), seed)


# ---- the operator -----------------------------------------------------------------------------------
def _extract_batches(batches: Iterator[pa.RecordBatch], weights: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    labeller = Labeller(weights)
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            found = labeller.main_texts(part.column(0).to_pylist())
            text, blocks, kept = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(blocks, pa.int64()), pa.array(kept, pa.int64())],
                names=[*part.schema.names[1:], "text", "n_chars", "n_blocks", "n_kept"],
            )


def extract_main_text(pages: DataFrame, weights: dict[str, np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), n_blocks, n_kept.

    Null and empty pages give an empty text; pages of any length are read whole; repeated rows stay repeated,
    with equal results; null ids and urls stay null; other columns are ignored; an empty table gives an
    empty result.
    """
    rows = pages.select(F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"), pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(partial(_extract_batches, weights=weights), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long, n_kept long")
