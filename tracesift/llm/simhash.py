"""SimHash near-dedup with BK-trees.

1. Fingerprints: one Arrow pass over the texts; everything after it moves 8-byte fingerprints.
2. Shards: two fingerprints that differ in at most ``radius`` bits agree on at least one of
   ``radius + 1`` bit bands, so each fingerprint joins one shard per band. A shard above
   ``SHARD_LIMIT`` is split again by bands of its remaining bits, with the same guarantee; after
   three splits a shard cannot hold more than 2**20 fingerprints. No pair within the radius is lost.
3. Each task builds the BK-tree of a shard (children keyed by the integer Hamming distance to the
   parent), and every fingerprint of the shard follows only the edges within the radius. What comes
   out is a spanning forest of the shard's links, so dense groups give linear output.
4. Components: alternating large-star and small-star rounds as joins, stored after each round.

The trees go to the tasks that query them by a shuffle on the shard key: all trees together grow
with the corpus, so they are not broadcast from the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import store, text_or_empty

SHARD_LIMIT = 4096
SPLITS = 3
_SLICE = 1 << 20
_SPACES = (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")


# ---- fingerprints ---------------------------------------------------------------------------------
def _word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in pieces of about a megabyte, cut at white space."""
    at = 0
    while len(raw) - at > _SLICE:
        cut = max(raw.rfind(s, at + 1, at + _SLICE) for s in _SPACES)
        if cut < 0:  # one word longer than a piece
            cut = min((k for k in (raw.find(s, at + _SLICE) for s in _SPACES) if k >= 0), default=len(raw))
        yield raw[at:cut].split()
        at = cut
    yield raw[at:].split()


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles (repeats count); no word gives 0, too few words one shingle."""
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    counts, n, carry = np.zeros(64, np.int64), 0, []
    for words in _word_lists(text.encode().lower()):  # bytes.lower() and bytes.split() know ASCII only
        words = carry + words
        grams = zip(*(words[i:] for i in range(shingle)))
        h = np.fromiter(map(digest, map(b" ".join, grams)), np.uint64)
        for part in np.array_split(h, len(h) // 65_536 + 1) if len(h) else ():
            counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
        carry = words[1 - shingle :] if shingle > 1 else []
    if n == 0:
        return digest(b" ".join(carry)) if carry else 0
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, with_digest: bool = False) -> DataFrame:
    text = text_or_empty(docs, text_col)
    more = [F.unhex(F.sha2(text, 256)).alias("digest")] if with_digest else []
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), *more)
    return narrow.mapInArrow(partial(_fingerprint_batches, shingle=shingle, seed=seed), "doc_id long, fp long" + ", digest binary" * with_digest)


# ---- shards ---------------------------------------------------------------------------------------
def _bands(mask: int, parts: int) -> list[int]:
    """The set bits of ``mask`` in ``parts`` consecutive runs of about equal length."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in run.tolist()) for run in np.array_split(np.array(bits, dtype=int), parts)]


def band_masks(radius: int) -> list[list[list[int]]]:
    """By split: for each path so far, the masks of bits on which a shard's members agree."""
    full, levels, paths = (1 << 64) - 1, [], [0]
    for _ in range(SPLITS):
        levels.append([[agreed | m for m in _bands(full & ~agreed, radius + 1)] for agreed in paths])
        paths = [m for group in levels[-1] for m in group]
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _members(rows: DataFrame, level: int, groups: list[list[int]]) -> DataFrame:
    """Rows (fp, path) to rows (fp, path, shard): one for each band below the path."""
    width = len(groups[0])
    made = [
        F.when(F.col("path") == p, F.array(*[F.struct(F.lit(p * width + j).alias("path"), F.xxhash64(F.lit(level), F.lit(p * width + j), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("shard")) for j, m in enumerate(masks)]))
        for p, masks in enumerate(groups)
    ]
    return rows.select("fp", F.explode(F.coalesce(*made)).alias("x")).select("fp", "x.path", "x.shard")


# ---- BK-trees -------------------------------------------------------------------------------------
class BKTree:
    """Values under a metric tree: a child's key is its Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions of the values at most ``radius`` away, following only edges that can lead there."""
        todo = [0] if self.values else []
        while todo:
            k = todo.pop()
            d = (self.values[k] ^ value).bit_count()
            if d <= radius:
                yield k
            kids = self.children[k]
            if len(kids) > 2 * radius + 1:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
            else:
                todo += [c for e, c in kids.items() if abs(e - d) <= radius]

    def add(self, value: int) -> None:
        k = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != k:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), k)


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (distance <= radius) among distinct values."""
    tree, root, links = BKTree(), list(range(len(values))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, v in enumerate(values):
        for k in tree.within(v, radius):
            a, b = find(i), find(k)
            if a != b:
                root[a] = b
                links.append((v, values[k]))
        tree.add(v)
    return links


def _link_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard; a shard cut by the end of a batch waits for the next one."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def runs(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        ends = np.r_[starts[1:], len(shard)]
        several = ends - starts > 1
        links = [x for s, e in zip(starts[several].tolist(), ends[several].tolist()) for x in shard_links(fp[s:e].tolist(), radius)]
        pair = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])

    for b in batches:
        shard = np.r_[held[0], b.column(0).to_numpy(zero_copy_only=False)]
        fp = np.r_[held[1], b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if not len(shard):
            continue
        last = int(np.searchsorted(shard, shard[-1], "left"))
        held = (shard[last:], fp[last:])
        if last:
            yield runs(shard[:last], fp[:last])
    if len(held[0]):
        yield runs(*held)


def links(distinct: DataFrame, radius: int = 2, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) that connect the same distinct fingerprints (column fp) as all pairs within ``radius``."""
    rows, out = distinct.select("fp", F.lit(0).alias("path")), []
    for level, groups in enumerate(band_masks(radius)):
        members = _members(rows, level, groups)
        if level < SPLITS - 1:
            large = store(members.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > shard_limit).select("shard"), "large-shards")
            split = not large.isEmpty()
        else:
            split = False
        small = members.join(large, "shard", "left_anti") if split else members
        dealt = small.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp")
        out.append(dealt.mapInArrow(partial(_link_batches, radius=radius), "a long, b long"))
        if not split:
            break
        rows = members.join(large, "shard", "left_semi").select("fp", "path")
    made = out[0]
    for more in out[1:]:
        made = made.unionByName(more)
    return made


# ---- components -----------------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge (a, b): root is the smallest node of its component."""
    star = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        star = store(small.select("e.a", "e.b").filter("a <> b").distinct(), "star")
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == now or now[0] == 0:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _classes(fps: DataFrame, radius: int, shard_limit: int) -> DataFrame:
    """(fp, root) for each distinct fingerprint: root is the same for all of a component."""
    distinct = store(fps.select("fp").distinct(), "classes")
    roots = components(links(distinct, radius, shard_limit)).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null text counts as empty; texts without words have fingerprint 0 and are linked like any other.
    Equal fingerprints are one class: only distinct fingerprints are compared, so groups of copies of
    any size cost one comparison. Repeated rows stay repeated. Null ids take part but name no
    component (component_id is null where no id is known). Very long texts are read whole, in pieces. Other
    columns are ignored. An empty table gives an empty result.
    """
    fps = store(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    named = _classes(fps, radius, shard_limit).join(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    comps = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(comps, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """The rows of ``docs`` (all columns) that stand for their component: its smallest id.

    A null id is larger than any other; between equal ids the text with the smaller digest stays; rows
    that repeat an id and its text are one document.
    """
    digest = F.unhex(F.sha2(text_or_empty(docs, text_col), 256))
    fps = store(fingerprints(docs, id_col, text_col, shingle, seed, with_digest=True), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    named = fps.select("fp", "doc_id", "digest", rank.alias("rank")).join(_classes(fps, radius, shard_limit), "fp")
    first = named.groupBy("root").agg(F.min("rank").alias("first"))
    gone = named.join(first, "root").filter("rank <> first").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    return docs.join(gone, (digest == F.col("__digest")) & docs[id_col].eqNullSafe(F.col("__id")), "left_anti")
