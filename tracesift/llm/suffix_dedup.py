"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if some string of ``LENGTH`` bytes that covers it starts in two places or more of the
corpus. Such strings are found in four steps:

1. Every string of ``LENGTH`` bytes belongs to the least hash of its ``GRAM``-byte substrings (its
   minimizer), so equal strings belong to one minimizer. Neighbouring strings with one minimizer
   form a run. The minimizers of all runs are counted.
2. A fixed-size bit filter of the repeated minimizers goes to the tasks, and runs that pass are cut out
   with their bytes. A false hit costs a run's bytes and changes nothing; at the filter's bound
   (``MAX_BITS``) more runs are sent on and the result stays the same.
3. Equal runs are pre-aggregated. Shards of whole minimizer groups build a suffix array and its BWT.
   From the intervals of eight-byte strings, breadth-first backward extension derives the common
   prefixes between suffix-array neighbours by increasing value and stops at ``LENGTH``; neighbours
   without a value by then share ``LENGTH`` bytes or more.
4. The repeated starts go back to the texts as spans.

A minimizer with more than ``MAX_GROUP`` different runs does not go to one task: its strings are
counted one by one under their own digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import row_slices, store, text_or_empty, utf8_buffers

LENGTH, GRAM = 200, 64
SHARD_BYTES, MAX_GROUP = 1 << 18, 16_384  # small shards stay in a core's cache
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28  # of the broadcast filter: 32 MB at most
SEED = 8  # bytes that the first sort compares
_BLOCK = 1 << 15  # with the window's length below 2**16
_LIMIT = 1 << 22
_END = 0xFF  # ends a run in a shard; no byte of UTF-8
_MIX = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from each position on, by doubling."""
    h, step, power = _MIX[raw], 1, _BASE
    while step < gram:
        h = h[:-step] * np.uint64(power) + h[step:]
        power = power * power % (1 << 64)
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def window_runs(offs: np.ndarray, raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one minimizer: (row, first start in the row, number of starts, minimizer).

    The minimizer is the leftmost least hash of the window's grams, so it depends on the window's bytes
    alone; a run ends where its place changes, so a text that repeats itself has several runs of one hash.
    """
    rows, starts, sizes, keys = [], [], [], []
    low = np.uint64(0xFFFF)  # the hash's low bits give way to the place in the block
    for at in range(0, max(0, len(raw) - length + 1), _BLOCK):
        part = raw[at : at + _BLOCK + length - 1]
        h = gram_hashes(part, gram)
        least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        pos = np.arange(at, at + len(least))
        row = np.searchsorted(offs, pos, "right") - 1
        ok = pos + length <= offs[row + 1]
        cut = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])])
        n = np.diff(np.r_[cut, len(least)])
        good = ok[cut]
        cut, n = cut[good], n[good]
        rows.append(row[cut])
        starts.append(pos[cut] - offs[row[cut]])
        sizes.append(n)
        keys.append(h[(least[cut] & low).astype(np.int64)])
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return cat(rows, np.int64), cat(starts, np.int64), cat(sizes, np.int64), cat(keys, np.uint64)


# ---- the transform --------------------------------------------------------------------------------
def suffix_order(text: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next ``depth`` bytes or more, and the first ``SEED`` bytes of each as a number.

    ``text`` has at least ``SEED`` zero bytes after its ``n`` bytes. Each round doubles the compared
    length for the positions that are still tied.
    """
    key = np.zeros(n, np.uint64)
    for k in range(SEED):
        key = (key << np.uint64(8)) | text[k : n + k]
    order = np.argsort(key)
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    group = np.flatnonzero(first)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(group, np.diff(np.r_[group, n]))
    tied, span = np.flatnonzero(~(first & np.r_[first[1:], True])), SEED
    while span < depth and len(tied):
        at = order[tied]
        both = (rank[at] << 32) | (rank[np.minimum(at + span, n)] + 1)
        by = np.argsort(both)
        at, both = at[by], both[by]
        order[tied] = at
        first = np.r_[True, both[1:] != both[:-1]]
        group = np.flatnonzero(first)
        rank[at] = np.repeat(tied[group], np.diff(np.r_[group, len(at)]))
        tied, span = tied[~(first & np.r_[first[1:], True])], span * 2
    return order, key


def short_prefix_borders(text: np.ndarray, n: int, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place in it whether it shares fewer than ``length`` bytes with the one before.

    ``room`` is the number of bytes before the next end mark. Intervals of strings of ``value`` bytes
    whose right border is new extend backward by each byte that precedes them; right borders that are
    new then have the common prefix ``value``. Strings with an end mark are left out.
    """
    order, key = suffix_order(text, n, length)
    before = np.where(order > 0, text[order - 1], 0).astype(np.uint8)
    back = np.empty(n, np.int32)
    back[np.argsort(before, kind="stable")] = np.arange(-1, n - 1, dtype=np.int32)  # no byte stands before position 0
    lead = np.r_[text[order], np.uint8(0)]
    border = np.zeros(n + 1, bool)
    border[1:n] = key[1:] != key[:-1]
    border[0] = border[n] = True
    left = np.flatnonzero(border[:n])
    right = np.r_[left[1:], n]
    inner = right < n
    at = np.minimum(right, n - 1)
    fresh = inner & (key[at] >> np.uint64(8) == key[right - 1] >> np.uint64(8)) & (room[order[left]] >= SEED)
    left, right = left[fresh], right[fresh]
    tag, used = np.full(n + 2, -1, np.int32), 0
    for _value in range(SEED, length):
        if not len(left):
            break
        width = right - left
        ends = np.cumsum(width)
        member = np.repeat(np.arange(used, used + len(left), dtype=np.int32), width)
        inside = np.arange(int(ends[-1])) + np.repeat(left - (ends - width), width)
        byte = before[inside]
        ok = (byte != 0) & (byte != _END)
        to, member = back[inside[ok]], member[ok]
        tag[to + 1] = member  # shifted by one, so that place -1 exists
        opens = (tag[to] != member) | (lead[to - 1] != lead[to])
        closes = (tag[to + 2] != member) | (lead[to + 1] != lead[to])
        lo, hi = np.sort(to[opens]), np.sort(to[closes]) + 1
        used += len(left)
        new = ~border[hi]
        left, right = lo[new].astype(np.int64), hi[new].astype(np.int64)
        border[right] = True
    return order, border


def repeated_starts(texts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each of the different texts, the starts whose ``length`` bytes occur twice or more (a text counts ``counts`` times)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.frombuffer(b"".join(t + b"\xff" for t in texts) + bytes(SEED + 1), np.uint8)
    n = len(text) - SEED - 1
    first = np.cumsum(sizes + 1) - sizes - 1
    which = np.repeat(np.arange(len(texts)), sizes + 1)
    room = (first + sizes)[which] - np.arange(n)
    order, border = short_prefix_borders(text, n, room, length)
    whole = room[order] >= length
    group = np.flatnonzero(border[:n])
    times = np.add.reduceat(np.where(whole, counts[which[order]], 0), group)
    found = order[np.repeat(times > 1, np.diff(np.r_[group, n])) & whole]
    found.sort()
    by_text = np.searchsorted(found, first)
    return [found[a:b] - f for a, b, f in zip(by_text.tolist(), [*by_text[1:].tolist(), len(found)], first.tolist())]


def as_spans(starts: np.ndarray, length: int) -> np.ndarray:
    """Sorted starts to rows (first byte, end) of merged strings."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + length], axis=1)


# ---- Spark ----------------------------------------------------------------------------------------
def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    offs, raw = utf8_buffers(batch.column(column))
    for lo, hi in row_slices(np.diff(offs), _LIMIT):
        yield lo, hi, offs[lo : hi + 1] - offs[lo], raw[offs[lo] : offs[hi]]


def _minimizer_batches(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, offs, raw in _slices(b, 0):
            yield pa.RecordBatch.from_arrays([pa.array(window_runs(offs, raw, length, gram)[3].view(np.int64))], names=["h"])


def _run_batches(batches: Iterator[pa.RecordBatch], length: int, gram: int, filter_bits) -> Iterator[pa.RecordBatch]:
    bits = filter_bits.value
    mask = np.uint64(len(bits) * 8 - 1)
    for b in batches:
        for lo, _, offs, raw in _slices(b, 1):
            row, start, size, h = window_runs(offs, raw, length, gram)
            slot = h & mask
            hit = bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1
            row, start, size, h = row[hit], start[hit], size[hit], h[hit]
            data, at = raw.tobytes(), (offs[row] + start).tolist()
            runs = [data[a : a + k + length - 1] for a, k in zip(at, size.tolist())]
            text = b.column(0).take(pa.array(row + lo))
            yield pa.RecordBatch.from_arrays([text, pa.array(start, pa.int64()), pa.array(h.view(np.int64)), pa.array(runs, pa.binary())], names=["text_key", "start", "h", "run"])


def _shard_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, n, run) sorted by h, to (run_key, spans) of the runs that hold a repeated string."""
    texts: list[bytes] = []
    keys: list[bytes] = []
    counts: list[int] = []
    held, last = 0, None

    def made() -> pa.RecordBatch:
        spans = [as_spans(s, length) for s in repeated_starts(texts, np.array(counts, np.int64), length)]
        some = [i for i, s in enumerate(spans) if len(s)]
        lists = pa.array([[{"a": a, "b": b} for a, b in spans[i].tolist()] for i in some], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.binary()), lists], names=["run_key", "spans"])

    for b in batches:
        for h, n, key, run in zip(*(c.to_pylist() for c in b.columns)):
            if h != last and held >= SHARD_BYTES:
                yield made()
                texts, keys, counts, held = [], [], [], 0
            last = h
            texts.append(run)
            keys.append(key)
            counts.append(n)
            held += len(run)
    if texts:
        yield made()


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, spans = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
        removed, runs, kept = [], [], []
        for text, some in zip(texts, spans):
            raw, at, parts, gone, n = text.encode(), 0, [], 0, 0
            for s, e in sorted((x["a"], x["b"]) for x in some or ()):
                if s > at or n == 0:  # a new maximal run
                    parts.append(raw[at:s])
                    n += 1
                    at = s
                if e > at:
                    gone += e - at
                    at = e
            parts.append(raw[at:])
            removed.append(gone)
            runs.append(n)
            kept.append(b"".join(parts))
        n_bytes = [len(k) + r for k, r in zip(kept, removed)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _repeated_filter(repeated: DataFrame) -> np.ndarray:
    """One bit per slot of the repeated minimizers; its size follows their count up to ``MAX_BITS``."""
    n, bits = repeated.count(), MIN_BITS
    while bits < 16 * n and bits < MAX_BITS:
        bits *= 2
    slot = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1
    maps = repeated.select(slot.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.toLocalIterator():  # at most MAX_BITS / 8 bytes in all
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["map"], np.uint8)[: len(out) - at]
    return out


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """(text_key, spans): per different text with repeats, spans (a, b) of bytes; they may overlap."""
    spark = docs.sparkSession
    texts = docs.select(text_or_empty(docs, text_col).alias("text"))
    found = texts.mapInArrow(partial(_minimizer_batches, length=length, gram=gram), "h long")
    repeated = store(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "minimizers")
    sent = spark.sparkContext.broadcast(_repeated_filter(repeated))
    cut = texts.select(_digest(F.col("text")).alias("text_key"), "text").mapInArrow(partial(_run_batches, length=length, gram=gram, filter_bits=sent), "text_key binary, start long, h long, run binary")
    runs = store(cut, "runs", compression="zstd")

    # only minimizers with many runs can have many different ones; few have, so Spark can send the stored list to the runs
    busy, split = store(repeated.filter(F.col("n") > max_group).select("h"), "busy"), False
    if not busy.isEmpty():
        sizes = runs.join(busy, "h", "left_semi").groupBy("h", "run").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("n"))
        large = store(sizes.filter(F.col("n") > max_group).select("h"), "large-groups")
        split = not large.isEmpty()
    normal = runs.join(large, "h", "left_anti") if split else runs

    different = normal.groupBy("h", "run").agg(F.count("*").alias("n")).select("h", "n", _digest(F.col("run")).alias("run_key"), "run")
    dealt = different.repartition("h").sortWithinPartitions("h")
    marks = store(dealt.mapInArrow(partial(_shard_batches, length=length), "run_key binary, spans array<struct<a:bigint,b:bigint>>"), "marks")
    places = normal.select("text_key", "start", _digest(F.col("run")).alias("run_key")).distinct()
    shifted = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    spans = places.join(marks, "run_key").select("text_key", F.explode(shifted).alias("span"))
    if split:
        each = runs.join(large, "h", "left_semi").select("text_key", "start", "run", F.explode(F.sequence(F.lit(0), F.length("run") - length)).alias("k"))
        each = each.select("text_key", (F.col("start") + F.col("k")).alias("a"), _digest(F.substring("run", F.col("k") + 1, F.lit(length))).alias("string"))
        twice = each.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
        more = each.join(twice, "string", "left_semi").select("text_key", F.struct("a", (F.col("a") + length).alias("b")).alias("span"))
        spans = spans.unionByName(more)
    return spans.groupBy("text_key").agg(F.collect_set("span").alias("spans"))  # of one text's own bytes


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes).

    Null text counts as empty; texts under ``length`` bytes lose nothing. Repeated rows are copies like any
    other: their texts lose all bytes if long enough. Texts are read whole, in blocks. Null ids stay
    null; other columns are ignored; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, text_col, length, gram, max_group)
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text")).withColumn("text_key", _digest(F.col("text")))
    joined = keyed.join(spans, "text_key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
