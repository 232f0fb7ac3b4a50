"""Streaming span agent (A7, I1-I8): assemble traces from a span stream, score them, keep anomalous ones.

Pipeline:  readStream -> event-time watermark -> dropDuplicatesWithinWatermark
           -> per-trace aggregate over a session window (JVM state), emitted with its
              ``complete`` flag when the watermark passes the session's end (Q20);
              or, to emit at the ``expected``-th distinct span at once, per-trace
              Python state (applyInPandasWithState)
           -> foreachBatch: features -> model -> flagged trace ids (decisions)
Spans themselves are staged by a second query; a batch job forwards the staged
spans of flagged traces (semi join), so no per-trace span list is ever held in
state. State per trace is a fixed-size record (counts, root requests, durations).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..schema import FLUSH_TRACES, REQUEST_TAG, SERVICE_OPERATIONS, SPAN_SCHEMA, SPANS_PER_TRACE
from ..session import shared_dir

EVENT_TS = "event_ts"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
REQUESTS = "requests"


def span_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = SPAN_SCHEMA,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Span files (parquet/json) arriving in a folder, read as a stream with a fixed schema."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def with_event_time(stream: DataFrame, watermark: str = "10 minutes", ts_col: str = "start_time") -> DataFrame:
    return stream.withColumn(EVENT_TS, F.col(ts_col).cast("timestamp")).withWatermark(EVENT_TS, watermark)


def started(writer: DataStreamWriter, spark: SparkSession, partitions: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream (``availableNow`` by default) that keeps its state in ``partitions`` partitions.

    Every operator with state loads and commits each partition of its state in every micro-batch, full or empty, so their number
    has to follow what a micro-batch holds, while the session's shuffle partitions (the default) follow the largest table.
    A stream that is started again keeps the number in its checkpoint.
    """
    before = spark.conf.get(SHUFFLE_PARTITIONS)
    if partitions:
        spark.conf.set(SHUFFLE_PARTITIONS, str(partitions))
    try:
        return writer.trigger(**(trigger or {"availableNow": True})).start()  # takes a copy of the session's settings
    finally:
        spark.conf.set(SHUFFLE_PARTITIONS, before)


def dedup_stream(stream: DataFrame) -> DataFrame:
    """Drop repeated (trace_id, span_id) arrivals within the watermark (first arrival wins)."""
    return stream.dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def _span_facts(stream: DataFrame, operations: Sequence[str]) -> DataFrame:
    """Per span: the few values the trace state needs (narrow rows into the state operator)."""
    # every request tag of the span, as a JSON array of texts
    req = F.to_json(F.transform(F.filter("tags", lambda t: t["key"] == REQUEST_TAG), lambda t: t["value"]))
    is_root = F.col("parent_span_id") == 0
    cols = [
        "trace_id",
        EVENT_TS,
        is_root.alias("is_root"),
        F.when(is_root, F.col("duration")).alias("root_d"),
        F.when(is_root, req).alias(REQUESTS),
    ]
    svc = F.col("operation_name").rlike("^(?:.*service)$")
    for i, op in enumerate(operations):
        cols.append(F.when(svc & (F.col("operation_name") == op), F.col("duration")).alias(f"d{i + 1}"))
    return stream.select(*cols)


def assembled_schema(operations: Sequence[str] = SERVICE_OPERATIONS) -> T.StructType:
    fields = [
        T.StructField("trace_id", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("complete", T.BooleanType()),
        T.StructField("TraceD", T.LongType()),
    ]
    fields += [T.StructField(f"SpanD{i + 1}", T.LongType()) for i in range(len(operations))]
    fields += [T.StructField(REQUESTS, T.StringType()), T.StructField("last_event_ms", T.LongType())]
    return T.StructType(fields)


EMITTED = -1  # span count in the state of a trace that has been emitted


def assemble_traces(stream: DataFrame, expected: int = SPANS_PER_TRACE, operations: Sequence[str] = SERVICE_OPERATIONS,
                    timeout_ms: int = 10 * 60 * 1000) -> DataFrame:
    """I1 + I3 + I4: emit a trace once, as soon as ``expected`` distinct spans have arrived, or with
    ``complete=false`` when the watermark passes its last event + ``timeout_ms``.

    An emitted trace leaves a mark in the state until its timeout, so spans that come later do not
    start it again. Expects a deduplicated stream carrying the event-time watermark column.
    """
    nops = len(operations)
    num_cols = ["root_d"] + [f"d{i + 1}" for i in range(nops)]
    out_schema = assembled_schema(operations)
    state_schema = T.StructType(
        [T.StructField("n", T.LongType()), T.StructField("root_d", T.LongType())]
        + [T.StructField(f"d{i + 1}", T.LongType()) for i in range(nops)]
        + [T.StructField("request", T.StringType()), T.StructField("last_ms", T.LongType())]
    )

    def _max(a, b):
        if a is None:
            return b
        if b is None:
            return a
        return max(a, b)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        trace_id = int(key[0])
        if state.hasTimedOut:
            n, root_d, *rest = state.get
            ds, request, last_ms = rest[:nops], rest[nops], rest[nops + 1]
            state.remove()
            if n == EMITTED:
                return
            yield pd.DataFrame.from_records([(trace_id, n, False, root_d, *ds, request, last_ms)], columns=out_schema.names)
            return
        if state.exists:
            n, root_d, *rest = state.get
            ds, request, last_ms = list(rest[:nops]), rest[nops], rest[nops + 1]
        else:
            n, root_d, ds, request, last_ms = 0, None, [None] * nops, None, 0
        for pdf in batches:
            # numpy per column: per-group pandas calls are the cost of this operator.
            if n != EMITTED:
                n += len(pdf)
            for i, c in enumerate(num_cols):
                v = np.fmax.reduce(pdf[c].to_numpy(dtype=np.float64, na_value=np.nan))
                if v == v:  # not NaN
                    if i == 0:
                        root_d = _max(root_d, int(v))
                    else:
                        ds[i - 1] = _max(ds[i - 1], int(v))
            if request is None:
                for x in pdf[REQUESTS].to_numpy():
                    if isinstance(x, str):
                        request = x
                        break
            last_ms = max(last_ms, int(pdf[EVENT_TS].to_numpy().max().astype("datetime64[ms]").astype("int64")))
        if n >= expected:
            yield pd.DataFrame.from_records([(trace_id, n, True, root_d, *ds, request, last_ms)], columns=out_schema.names)
            n, root_d, ds, request = EMITTED, None, [None] * nops, None
        state.update((n, root_d, *ds, request, last_ms))
        state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + timeout_ms)

    facts = _span_facts(stream, operations)
    return facts.groupBy("trace_id").applyInPandasWithState(
        step, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout
    )


def session_assembly(stream: DataFrame, gap: str = "5 minutes", operations: Sequence[str] = SERVICE_OPERATIONS,
                     expected: int = SPANS_PER_TRACE) -> DataFrame:
    """I1 + I4: one row per trace session (spans closer than ``gap``), complete or not, emitted when the
    watermark passes the session's end. JVM state of bounded aggregates only, no span lists."""
    facts = _span_facts(stream, operations)
    aggs = [
        F.count(F.lit(1)).alias("n_spans"),
        F.max("root_d").alias("TraceD"),
        *[F.max(f"d{i + 1}").alias(f"SpanD{i + 1}") for i in range(len(operations))],
        F.max(REQUESTS).alias(REQUESTS),
    ]
    out = facts.groupBy("trace_id", F.session_window(EVENT_TS, gap).alias("session")).agg(*aggs)
    return out.withColumn("complete", F.col("n_spans") >= expected)


def stage_spans(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, partitions: int | None = None) -> StreamingQuery:
    """A13 (stream): write deduplicated spans to a staging table for later forwarding."""
    w = stream.drop(EVENT_TS).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return started(w.outputMode("append"), stream.sparkSession, partitions, trigger)


def start_tail_sampler(assembled: DataFrame, score: Callable[[DataFrame], DataFrame], decisions_path: str,
                       checkpoint: str, trigger: dict | None = None, flush_size: int = FLUSH_TRACES,
                       partitions: int | None = None) -> StreamingQuery:
    """I2 + I6 + I7: score each micro-batch of assembled traces and write the decisions.

    ``score`` maps assembled traces to rows with ``trace_id`` and ``anomalous``.
    Within a micro-batch the traces are cut into flush groups of ``flush_size``
    in trace-id order (E3), so any per-group id list stays bounded; micro-batch
    size itself is set on the source (``maxFilesPerTrigger``). A micro-batch
    writes its own folder (``epoch=<id>``, overwritten on replay), so a replayed
    batch does not duplicate decisions (Q22: a scoring error fails the batch and
    Spark replays it).
    """
    from ..operators.spans import flush_groups

    def on_batch(batch: DataFrame, epoch: int) -> None:
        # flush groups read the scored batch more than once: keep it for this batch only
        scored = score(batch).select("trace_id", F.col("anomalous").cast("boolean").alias("anomalous")).persist()
        try:
            grouped = flush_groups(scored, ["trace_id"], flush_size)
            grouped.write.mode("overwrite").parquet(f"{decisions_path.rstrip('/')}/epoch={epoch}")
        finally:
            scored.unpersist()

    w = assembled.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return started(w, assembled.sparkSession, partitions, trigger)


def forward_flagged_spans(spark: SparkSession, staged_path: str, decisions_path: str, mode: str = "anomalous") -> DataFrame:
    """I7/I8 (forwarding side): staged spans of flagged traces (semi join), or all in pass-through mode."""
    spans = spark.read.schema(SPAN_SCHEMA).parquet(staged_path)
    if mode == "passthrough":
        return spans
    flagged = spark.read.parquet(decisions_path).filter("anomalous").select("trace_id")
    return spans.join(flagged, "trace_id", "left_semi")


def run_to_table(df_stream: DataFrame, spark: SparkSession, name: str, output_mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Drive a stream to completion with ``availableNow`` into a parquet folder and read it back."""
    out = shared_dir(spark, f"{name}-out")
    ck = shared_dir(spark, f"{name}-ck")
    w = df_stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode(output_mode)
    started(w, spark, partitions).awaitTermination()
    return spark.read.parquet(out)
