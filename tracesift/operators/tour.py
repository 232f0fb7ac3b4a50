"""Trace trees of any depth and size (C3): small traces whole in a task, large ones by an Euler tour, ranked by pointer jumping.

Traces of up to ``WALK_SPANS`` spans move once, to the task that orders them, an Arrow batch of whole traces at a time. Larger
ones, which no task should hold, go through the tour, in logarithmically many rounds: every span is two events of a depth-first walk, its entry and its exit. The event before each is known from its
neighbours alone: the entry of a first child comes after its parent's entry, any other entry after the
exit of the sibling before it; an exit comes after the exit of the last child, or after the span's own entry. A round replaces
each event's pointer by that of the event it points to and adds up what lies between: after r rounds a pointer spans 2^r
events. When all have arrived at their root, the number of entries up to a span's is its pre-order position, and
entries less exits is its depth. Rows stay narrow (no paths), each is the target of one pointer at most, so a trace
of any size or shape is spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .indexing import dense_index


WALK_SPANS = 4096  # spans of a trace that is ordered in one task
_ORDERED = "trace_id long, span_id long, root_span_id long, depth int, position long"


def _nodes(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, parent) of each span once, below its smallest parent; parent 0 is a root's."""
    found = spans.filter("trace_id IS NOT NULL AND span_id IS NOT NULL").groupBy("trace_id", "span_id")
    return stored(found.agg(F.min(F.coalesce("parent_span_id", F.lit(0))).alias("parent")), "tree-nodes")


def _order_whole(trace: np.ndarray, span: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index, root's index, depth, position) of the spans below a root, of whole traces sorted by trace and span."""
    n = len(span)
    code = np.cumsum(np.r_[0, trace[1:] != trace[:-1]]) if n else trace
    ids, at = np.unique(span, return_inverse=True)
    keys = code * len(ids) + at  # ascending
    there = np.minimum(np.searchsorted(ids, parent), max(len(ids) - 1, 0))
    wanted = code * len(ids) + there
    up = np.minimum(np.searchsorted(keys, wanted), max(n - 1, 0))
    known = (ids[there] == parent) & (keys[up] == wanted)
    top = parent == 0
    up = np.where(top, np.arange(n), np.where(known, up, n))  # a root leads to itself, a missing parent to n
    above, far, depth = np.r_[up, n], np.r_[up, n], np.r_[(~top).astype(np.int64), 0]
    for _ in range(int(np.bincount(code).max(initial=0)).bit_length() + 1):  # 2**rounds steps up; circles go on
        depth, far = depth + depth[far] * (far != above[far]), far[far]
    at_root = np.r_[top, False][far]
    index = np.flatnonzero(at_root)
    level = index[np.argsort(depth[index], kind="stable")]
    ends = np.cumsum(np.bincount(depth[level])) if len(level) else np.zeros(1, np.int64)
    size = np.ones(n + 1, np.int64)
    for d in range(len(ends) - 1, 0, -1):
        low = level[ends[d - 1] : ends[d]]
        np.add.at(size, above[low], size[low])
    kids = index[~top[index]]
    kids = kids[np.argsort(above[kids], kind="stable")]  # siblings side by side, by span id
    before = np.cumsum(size[kids]) - size[kids]
    first = np.r_[True, above[kids][1:] != above[kids][:-1]] if len(kids) else np.zeros(0, bool)
    place = np.zeros(n + 1, np.int64)
    if len(kids):
        place[kids] = 1 + before - before[np.maximum.accumulate(np.where(first, np.arange(len(kids)), 0))]
    for d in range(1, len(ends)):
        low = level[ends[d - 1] : ends[d]]
        place[low] += place[above[low]]
    return index, far[index], depth[index], place[index]


def _walk(batches: Iterator) -> Iterator:
    """The order of the traces of a partition sorted by trace and span, as Arrow batches."""
    import pyarrow as pa

    def ordered(t, s, p):
        index, root, depth, place = _order_whole(t, s, p)
        return pa.RecordBatch.from_arrays([pa.array(t[index]), pa.array(s[index]), pa.array(s[root]), pa.array(depth.astype(np.int32)), pa.array(place)],
                                          names=["trace_id", "span_id", "root_span_id", "depth", "position"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        if not batch.num_rows:
            continue
        held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
        cut = int(np.searchsorted(held[0], held[0][-1]))  # the last trace may go on in the next batch
        if cut:
            yield ordered(*[h[:cut] for h in held])
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield ordered(*held)


def _events(nodes: DataFrame) -> DataFrame:
    """(trace_id, v, k, pv, pk, entries, depth, root, lost) for each event; k is 0 for an entry and 1 for an exit."""
    kids = nodes.filter("parent <> 0")
    numbered = stored(dense_index(kids, ["trace_id", "parent", "span_id"], "n")[0], "tree-kids")
    before = numbered.select("trace_id", "parent", (F.col("n") + 1).alias("n"), F.col("span_id").alias("sibling"))
    placed = numbered.join(before, ["trace_id", "parent", "n"], "left").select("trace_id", "span_id", "parent", "sibling")
    placed = placed.unionByName(nodes.filter("parent = 0").withColumn("sibling", F.lit(None).cast("long")))
    last = kids.groupBy("trace_id", F.col("parent").alias("span_id")).agg(F.max("span_id").alias("child"))
    whole = placed.join(last, ["trace_id", "span_id"], "left")
    event = lambda k, pv, pk, entries, depth, root: F.struct(
        F.lit(k).alias("k"), pv.alias("pv"), pk.alias("pk"), F.lit(entries).alias("entries"), F.lit(depth).alias("depth"), root.alias("root")
    )
    v, top = F.col("span_id"), F.col("parent") == 0
    entry = event(0, F.when(~top, F.coalesce("sibling", "parent")), F.when(F.col("sibling").isNull(), 0).otherwise(1), 1, 1, F.when(top, v))
    leave = event(1, F.coalesce("child", v), F.when(F.col("child").isNull(), 0).otherwise(1), 0, -1, F.lit(None).cast("long"))
    rows = whole.select("trace_id", v.alias("v"), F.explode(F.array(entry, leave)).alias("e")).select("trace_id", "v", "e.*", F.lit(False).alias("lost"))
    return rows.select("trace_id", "v", "k", "pv", "pk", F.col("entries").cast("long").alias("entries"), F.col("depth").cast("long").alias("depth"), "root", "lost")


def trace_order(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, root_span_id, depth, position) of every span reachable from a root, whatever the depth.

    ``position`` counts from 0 in depth-first pre-order under the root, children in span-id order. Spans whose chain of
    parents ends at a missing span or runs in a circle belong to no root and are left out, as in ``trace_tree``.
    A span with several parents counts below the smallest. Traces of up to ``WALK_SPANS`` spans move once; for larger ones it takes
    one join and one written table of narrow rows a round, and about log2 of twice the largest trace rounds.
    """
    nodes = _nodes(spans)
    large = stored(nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WALK_SPANS), "tree-large")
    largest = large.agg(F.max("n")).first()[0]
    small = nodes if largest is None else nodes.join(large, "trace_id", "left_anti")
    walked = small.repartition("trace_id").sortWithinPartitions("trace_id", "span_id").mapInArrow(_walk, _ORDERED)
    return walked if largest is None else walked.unionByName(_jumped(nodes.join(large, "trace_id", "left_semi"), largest))


def _jumped(nodes: DataFrame, largest: int) -> DataFrame:
    """The order of traces of up to ``largest`` spans by the tour."""
    now = stored(_events(stored(nodes, "tree-nodes")), "tour")
    for _ in range(math.ceil(math.log2(2 * largest + 2)) + 1):
        if now.filter("pv IS NOT NULL").isEmpty():
            break
        there = now.select("trace_id", F.col("v").alias("pv"), F.col("k").alias("pk"), F.col("pv").alias("to_v"), F.col("pk").alias("to_k"),
                           F.col("entries").alias("more"), F.col("depth").alias("deeper"), F.col("root").alias("at"), F.col("lost").alias("gone"), F.lit(True).alias("met"))
        moved = now.filter("pv IS NOT NULL").join(there, ["trace_id", "pv", "pk"], "left").select(
            "trace_id", "v", "k", F.col("to_v").alias("pv"), F.col("to_k").alias("pk"), (F.col("entries") + F.coalesce("more", F.lit(0))).alias("entries"),
            (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth"), F.col("at").alias("root"), (F.col("met").isNull() | F.coalesce("gone", F.lit(False))).alias("lost"),
        )
        now = stored(now.filter("pv IS NULL").unionByName(moved), "tour")
    return now.filter("k = 0 AND pv IS NULL AND NOT lost AND root IS NOT NULL").select(
        "trace_id", F.col("v").alias("span_id"), F.col("root").alias("root_span_id"), (F.col("depth") - 1).cast("int").alias("depth"), (F.col("entries") - 1).alias("position")
    )
