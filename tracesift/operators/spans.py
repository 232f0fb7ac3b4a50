"""Batch trace assembly over a span DataFrame (B*, C1-C5, D1-D3, D12-D13, E1-E3, F*, G1).

Every function takes and returns a lazy DataFrame. Per-trace work is a hash
aggregate keyed by trace_id (partial aggregation before the shuffle), so a hot
trace costs one aggregate row per map task, never one task holding the trace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EXCLUDED_SERVICE, REQUEST_TAG, ROOT_OPERATION, SERVICE_OPERATIONS, SPANS_PER_TRACE

# ----------------------------------------------------------------------------- predicates


def is_root(col: str = "parent_span_id") -> Column:
    """Root span <=> no parent."""
    return F.col(col) == 0


def is_valid_trace(col: str = "trace_id") -> Column:
    """Trace id 0 is invalid."""
    return F.col(col) != 0


def is_service_span(match: str = "suffix", col: str = "operation_name", word: str = "service") -> Column:
    """Server-span predicate.

    ``suffix``  : the anchored regex ``.*service`` (whole name must match).
    ``contains``: substring test.
    """
    if match == "suffix":
        return F.col(col).rlike("^(?:.*" + word + ")$")
    if match == "contains":
        return F.col(col).contains(word)
    raise ValueError(f"unknown match {match!r}")


def not_excluded_service(col: str = "service_name", excluded: str = EXCLUDED_SERVICE) -> Column:
    """Case-insensitive exclusion of the tracing system's own service."""
    return F.lower(F.col(col)) != excluded.lower()


def filter_term(df: DataFrame, col: str, value) -> DataFrame:
    """Exact term filter (pushed to the scan when ``col`` is a stored column)."""
    return df.filter(F.col(col) == F.lit(value))


def root_spans(spans: DataFrame, operation: str | None = ROOT_OPERATION) -> DataFrame:
    """Root spans, optionally of one root operation."""
    cond = is_root()
    if operation is not None:
        cond = cond & (F.col("operation_name") == operation)
    return spans.filter(cond)


def request_tags(spans: DataFrame, tag: str = REQUEST_TAG) -> DataFrame:
    """One row per matching tag: (trace_id, span_id, duration, request)."""
    return spans.select(
        "trace_id", "span_id", "duration", F.explode(F.filter("tags", lambda t: t["key"] == tag)).alias("t")
    ).select("trace_id", "span_id", "duration", F.col("t.value").alias(tag))


# ----------------------------------------------------------------------------- dedup / counts


def dedup_spans(spans: DataFrame, order_cols: Sequence[str] = ("arrival_seq",), keep: Sequence[str] | None = None) -> DataFrame:
    """D3: last-wins per (trace_id, span_id): keep the row with the greatest ``order_cols``.

    Ties on ``order_cols`` are broken by the remaining scalar columns so the result
    is deterministic. One aggregate with ``max_by`` (sort-based, since its buffer is a
    struct): partial aggregation collapses duplicates map-side before the shuffle. With ``keep`` only those
    columns of the kept rows are returned, and the others are neither computed nor moved.
    """
    cols = [c for c in spans.columns if keep is None or c in keep]
    tie = [c for c in ("start_time", "duration", "operation_name", "service_name", "parent_span_id") if c not in order_cols]
    order = F.struct(*[F.col(c) for c in list(order_cols) + tie])
    payload = F.struct(*[F.col(c) for c in cols if c not in ("trace_id", "span_id")])
    return (
        spans.groupBy("trace_id", "span_id")
        .agg(F.max_by(payload, order).alias("s"))
        .select("trace_id", "span_id", "s.*")
        .select(*cols)
    )


def spans_per_trace(spans: DataFrame, distinct: bool = False) -> DataFrame:
    """Spans per trace (arrivals, or distinct span ids)."""
    n = F.count_distinct("span_id") if distinct else F.count(F.lit(1))
    return spans.groupBy("trace_id").agg(n.alias("n_spans"))


def complete_traces(spans: DataFrame, expected: int = SPANS_PER_TRACE, strict: bool = False) -> DataFrame:
    """Traces whose distinct span count reaches ``expected`` (``== expected`` when strict)."""
    counts = spans_per_trace(spans, distinct=True)
    cond = F.col("n_spans") == expected if strict else F.col("n_spans") >= expected
    return counts.filter(cond)


def complete_trace_count(spans: DataFrame, expected: int = SPANS_PER_TRACE) -> DataFrame:
    """Number of traces with exactly ``expected`` span arrivals."""
    return spans_per_trace(spans).agg(F.count_if(F.col("n_spans") == expected).alias("n_complete"))


# ----------------------------------------------------------------------------- pivot / joins


def trace_durations(
    spans: DataFrame,
    operations: Sequence[str] = SERVICE_OPERATIONS,
    match: str = "suffix",
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per trace, one duration column per operation (max over duplicates).

    Conditional aggregation over a fixed operation list (what ``pivot(values=...)``
    compiles to), so the output schema never depends on the data.
    """
    names = list(names or [f"SpanD{i + 1}" for i in range(len(operations))])
    svc = spans.filter(is_service_span(match) & F.col("operation_name").isin(list(operations)))
    aggs = [
        F.max(F.when(F.col("operation_name") == op, F.col("duration"))).alias(name)
        for op, name in zip(operations, names)
    ]
    return svc.groupBy("trace_id").agg(*aggs)


def span_edges(spans: DataFrame) -> DataFrame:
    """Parent-child edges within a trace (self join on the parent id)."""
    p = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("operation_name").alias("parent_operation"))
    c = spans.select("trace_id", "parent_span_id", "span_id", F.col("operation_name").alias("child_operation"))
    return c.join(p, ["trace_id", "parent_span_id"], "inner")


def children_by_parent(spans: DataFrame) -> DataFrame:
    """One row per child: (trace_id, parent_span_id, position, span_id), children in span-id order from 0.

    One distributed sort numbers all children densely; a child's position is its number less the
    parent's least. A parent of any size is spread over tasks and never gathered in a list.
    """
    from .indexing import dense_index

    kids = spans.filter(~is_root()).select("trace_id", "parent_span_id", "span_id")
    numbered, _ = dense_index(kids, ["trace_id", "parent_span_id", "span_id"], "_n")
    first = numbered.groupBy("trace_id", "parent_span_id").agg(F.min("_n").alias("_first"))
    return numbered.join(first, ["trace_id", "parent_span_id"]).select(
        "trace_id", "parent_span_id", (F.col("_n") - F.col("_first")).alias("position"), "span_id"
    )


def trace_tree(spans: DataFrame) -> DataFrame:
    """Every span reachable from a root, with depth and a pre-order path.

    Level-by-level frontier joins on (trace_id, parent_span_id), down to the first empty level, whatever
    the depth. ``path`` is the list of span ids from the root, so sorting by (trace_id, path) gives
    depth-first pre-order with children in span-id order. An edge back to a span of its own path is
    a cycle: it is not followed, and the number of such edges is reported with a warning. The narrow
    spans, the edge table and every level are written once as tables in the cluster's shared checkpoint
    folder: each is computed once and held by no task, lineage stays one join deep, and a lost executor
    costs a re-read.
    """
    import warnings

    from ..session import stored

    spans = stored(spans.select("trace_id", "parent_span_id", "span_id"), "tree-spans")  # read by both filters
    edges = stored(spans.filter(~is_root()).distinct(), "tree-edges")
    level = stored(
        spans.filter(is_root())
        .select("trace_id", "span_id", F.lit(0).alias("depth"), F.array("span_id").alias("path"))
        .distinct(),
        "tree-level",
    )
    levels, cyclic, d = [level], 0, 0
    while True:
        d += 1
        nxt = stored(
            level.select("trace_id", F.col("span_id").alias("parent_span_id"), "path")
            .join(edges, ["trace_id", "parent_span_id"])
            .select("trace_id", "span_id", F.lit(d).alias("depth"), F.concat("path", F.array("span_id")).alias("path"),
                    F.array_contains("path", F.col("span_id")).alias("_cycle")),
            "tree-level",
        )
        kinds = {r["_cycle"]: r["n"] for r in nxt.groupBy("_cycle").agg(F.count(F.lit(1)).alias("n")).collect()}
        cyclic += kinds.get(True, 0)
        if not kinds.get(False):
            break
        level = nxt.filter(~F.col("_cycle")).drop("_cycle")
        levels.append(level)
    if cyclic:
        warnings.warn(f"{cyclic} edges lead back to a span of their own path and were not followed", stacklevel=2)
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def pending_spans(spans: DataFrame, processed: DataFrame) -> DataFrame:
    """Spans whose trace has not been processed yet (anti join on trace_id)."""
    return spans.join(processed.select("trace_id").distinct(), "trace_id", "left_anti")


def keep_traces(spans: DataFrame, flagged: DataFrame) -> DataFrame:
    """C4: spans of flagged traces (semi join on trace_id)."""
    return spans.join(flagged.select("trace_id"), "trace_id", "left_semi")


# ----------------------------------------------------------------------------- windows / order


def row_index(df: DataFrame, order_cols: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Dense 0-based index in ``order_cols`` order.

    A range-partitioned sort, then partition offsets added to
    ``monotonically_increasing_id`` (``operators.indexing``): no window over a
    single partition and no Python row path.
    """
    from .indexing import dense_index

    return dense_index(df, order_cols, name)[0]


def flush_groups(df: DataFrame, order_cols: Sequence[str], size: int = 5000, name: str = "flush_group") -> DataFrame:
    """Consecutive groups of ``size`` rows in ``order_cols`` order."""
    idx = row_index(df, order_cols, "_ri")
    return idx.withColumn(name, F.floor(F.col("_ri") / size).cast("long")).drop("_ri")


def process_runs(
    spans: DataFrame,
    order_col: str = "span_id",
    partition_col: str = "trace_id",
    process_cols: Sequence[str] = ("service_name", "process_tags"),
) -> DataFrame:
    """Gaps-and-islands: consecutive spans (by ``order_col``) with an equal process form one run.

    Returns the spans with ``run_id`` (0-based within the trace). Skew-safe: see
    ``operators.runs`` (range partitioning splits a hot trace; no per-trace window).
    """
    from .runs import process_runs as _runs

    return _runs(spans, order_col, partition_col, process_cols)


def process_runs_window(
    spans: DataFrame,
    order_col: str = "span_id",
    partition_col: str = "trace_id",
    process_cols: Sequence[str] = ("service_name", "process_tags"),
) -> DataFrame:
    """E2 as a window per trace: the plain formulation (one task sorts a whole trace); kept for tests."""
    w = Window.partitionBy(partition_col).orderBy(order_col)
    proc = F.struct(*[F.col(c) for c in process_cols])
    changed = F.when(F.lag(proc).over(w).isNull() | (F.lag(proc).over(w) != proc), 1).otherwise(0)
    marked = spans.withColumn("_chg", changed)
    return marked.withColumn(
        "run_id", (F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).cast("long")
    ).drop("_chg")


def page(df: DataFrame, order_cols: Sequence[str], offset: int, size: int = 50) -> DataFrame:
    """one page of a sorted scan."""
    return df.orderBy(*order_cols).offset(offset).limit(size)


def union_all(*dfs: DataFrame) -> DataFrame:
    """G1: bag union by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
