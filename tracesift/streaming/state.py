"""Stateful span operators: emission at the last expected span, last arrival wins, late spans, flush
groups over micro-batches, model-scored decisions and forwarding inside the stream (I1-I7, C5).

* ``emit_complete``: one state record and an event-time timer per group of traces; their spans, fewer than ``expected`` each, are in the
  record, so a micro-batch reads and writes the state once a group; a trace leaves as soon as its ``expected``-th distinct span is there.
* ``last_arrivals``, ``flagged_traces``, ``forward_flagged``: aggregates and joins with watermarks, JVM state only.
* ``split_late``, ``start_flush_groups``, ``start_model_sampler``: micro-batch sinks. What a micro-batch has to know of earlier ones (the largest
  event time, the number of traces so far, the model version) is a row in a small journal table, one folder
  a micro-batch; a replayed micro-batch reads only earlier rows and overwrites its own, so its output is the same.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..schema import FLUSH_TRACES, REQUEST_TAG, SERVICE_OPERATIONS, SPANS_PER_TRACE
from .agent import EVENT_TS, REQUESTS, assembled_schema, dedup_stream, session_assembly, started, with_event_time

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---- journal: what a micro-batch tells later ones ------------------------------------------------------
def _write_journal(spark: SparkSession, path: str, epoch: int, schema: str, *values) -> None:
    spark.createDataFrame([(epoch, *values)], f"epoch long, {schema}").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={epoch}")


def _earlier(spark: SparkSession, path: str, epoch: int, schema: str) -> DataFrame:
    """Journal rows of the micro-batches before ``epoch`` (none when nothing was written yet)."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], f"epoch long, {schema}")
    return spark.read.schema(f"epoch long, {schema}").parquet(path).filter(F.col("epoch") < epoch).select("epoch", *[f.name for f in T._parse_datatype_string(schema).fields])


def _put(df: DataFrame, path: str, epoch: int) -> None:
    """One micro-batch's rows, in a folder of its own that a replay overwrites."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")


# ---- I1: emission at the last expected span ------------------------------------------------------------
def emitted_schema(operations: Sequence[str] = SERVICE_OPERATIONS) -> T.StructType:
    return T.StructType([*assembled_schema(operations).fields, T.StructField("watermark_ms", T.LongType())])


class CompleteTraces(StatefulProcessor):
    """State of a group of traces: per trace its spans by id (last arrival wins), how many they are, its last event and when
    it is due; one timer a group, for the trace due first.

    A key is one trace, or with ``grouped`` a group of traces, whose rows are texts of ``SPAN_FACTS``: every call from Python to
    the state store costs far more than a span, and a group's traces share them. Spans of a micro-batch beyond ``MOST`` wait in a
    map state, so that a trace of any size takes little memory.
    """

    MOST = 4096

    def __init__(self, expected: int, operations: Sequence[str], timeout_ms: int, grouped: bool = False) -> None:
        self.expected, self.slots, self.timeout = expected, {op: i for i, op in enumerate(operations)}, timeout_ms
        self.row, self.grouped = Row(*emitted_schema(operations).names), grouped

    def init(self, handle) -> None:
        self.handle, self.most = handle, max(self.MOST, self.expected)
        span = "arrival_seq long, is_root boolean, slot int, duration long, requests string"
        self.spans = handle.getMapState("spans", "trace_id long, span_id long", span)
        self.traces = handle.getValueState("traces", "timer_ms long, traces string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (timer, traces), now, moved = self._known(), timerValues.getCurrentWatermarkInMs(), set()
        for r in rows:
            trace_id, span_id, seq, is_root, operation, duration, requests, event_ms = self._facts(key, r)
            if trace_id not in traces:
                traces[trace_id] = [0, 0, 0, False, {}]
            trace = traces[trace_id]
            trace[1] = max(trace[1], event_ms)
            if trace[3]:
                continue
            spans = trace[4]
            before = spans.get(span_id)
            if before is None and trace_id in moved and self.spans.containsKey((trace_id, span_id)):
                before = self.spans.getValue((trace_id, span_id))
            trace[0] += before is None
            if before is None or (seq or 0) >= (before[0] or 0):
                spans[span_id] = (seq, is_root, self.slots.get(operation, -1), duration, requests)
            if len(spans) > self.most:
                self._move(trace_id, spans)
                moved.add(trace_id)
        for trace_id in moved:
            self._move(trace_id, traces[trace_id][4])
        for trace_id, trace in traces.items():
            n, last, due, emitted, spans = trace
            if not emitted and n >= self.expected:
                held = (v for (t, _), v in self.spans.iterator() if t == trace_id) if trace_id in moved else spans.values()
                yield self._row(trace_id, n, True, last, now, held)
                trace[3], trace[4] = True, {}
            trace[2] = due or max(last, now) + self.timeout
        if moved:  # these have more spans than any trace that waits
            self.spans.clear()
        self._keep(timer, traces)

    def _facts(self, key, r: Row) -> tuple:
        if self.grouped:
            return tuple(json.loads(r.facts).values())
        return key[0], r.span_id, r.arrival_seq, r.is_root, r.operation_name, r.duration, r.requests, r.event_ms

    def _known(self) -> tuple[int, dict]:
        timer, held = self.traces.get() if self.traces.exists() else (0, "[]")
        return timer, {t: [n, last, due, emitted, {s: tuple(rest) for s, *rest in spans}] for t, n, last, due, emitted, spans in json.loads(held)}

    def _keep(self, timer: int, traces: dict) -> None:
        """Writes the state; the timer, once for the group, is moved when a trace is due before it or when it has fired (0)."""
        due = min(t[2] for t in traces.values())
        if not timer or due < timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.traces.update((timer, json.dumps([(t, *rest, [(s, *v) for s, v in spans.items()]) for t, (*rest, spans) in traces.items()])))

    def _move(self, trace_id: int, spans: dict) -> None:
        for span, values in spans.items():
            self.spans.updateValue((trace_id, span), values)
        spans.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (_, traces), now, open_ = self._known(), timerValues.getCurrentWatermarkInMs(), {}
        for trace_id, trace in traces.items():
            n, last, due, emitted, spans = trace
            if due <= now and last + self.timeout > now:  # later spans have put it off
                trace[2] = due = last + self.timeout
            if due > now:
                open_[trace_id] = trace
            elif not emitted:
                yield self._row(trace_id, n, False, last, now, spans.values())
        if open_:
            self._keep(0, open_)
        else:
            self.traces.clear()

    def _row(self, trace_id: int, n: int, complete: bool, last: int, now: int, spans) -> Row:
        root, durations, requests = None, [None] * len(self.slots), None
        for _, is_root, slot, duration, asked in spans:
            if is_root:
                root = duration if root is None else root if duration is None else max(root, duration)
                requests = max(requests, asked) if requests and asked else requests or asked
            elif slot >= 0 and duration is not None:
                durations[slot] = duration if durations[slot] is None else max(durations[slot], duration)
        return self.row(trace_id, n, complete, root, *durations, requests, last, now)

    def close(self) -> None:
        pass


#: What a span tells its trace, in the order in which ``CompleteTraces`` reads it.
SPAN_FACTS = ("trace_id", "span_id", "arrival_seq", "is_root", "operation_name", "duration", REQUESTS, "event_ms")


def emit_complete(stream: DataFrame, expected: int = SPANS_PER_TRACE, operations: Sequence[str] = SERVICE_OPERATIONS, timeout: str = "10 minutes", groups: int = 1 << 12) -> DataFrame:
    """I1 + I3 + I4: a trace once, in the micro-batch that brings its ``expected``-th distinct span; or, with
    ``complete = false``, when the watermark has passed its last event by ``timeout``.

    ``n_spans`` counts distinct spans, repeated arrivals included only once, the last one's values taken. Spans that come
    after the emission extend the time for which the trace is remembered and start nothing. ``watermark_ms`` is the
    watermark at the emission. The input needs the event-time column of ``with_event_time`` and no dedup.
    Traces share ``groups`` state records by their hash; a task holds one group's open traces, so a stream with very many open
    traces wants more groups. State lives in RocksDB, which this sets for the session's later queries.
    """
    spark = stream.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    asked = F.to_json(F.transform(F.filter("tags", lambda t: t["key"] == REQUEST_TAG), lambda t: t["value"]))
    root = F.col("parent_span_id") == 0
    found = {"is_root": root, REQUESTS: F.when(root, asked), "event_ms": F.expr(f"unix_millis({EVENT_TS})")}
    facts = F.to_json(F.struct(*[found.get(c, F.col(c)).alias(c) for c in SPAN_FACTS]), {"ignoreNullFields": "false"})  # one text: Python reads a row column by column
    rows = stream.select(F.pmod(F.xxhash64("trace_id"), F.lit(groups)).alias("group"), EVENT_TS, facts.alias("facts"))
    (timeout_ms,) = spark.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {timeout})")).first()
    traces = CompleteTraces(expected, operations, timeout_ms, grouped=True)
    return rows.groupBy("group").transformWithState(traces, emitted_schema(operations), "append", "eventtime")


# ---- I5: last arrival wins ---------------------------------------------------------------------------
def last_arrivals(stream: DataFrame, gap: str = "5 minutes", order_cols: Sequence[str] = ("arrival_seq",)) -> DataFrame:
    """The last arrival of every (trace_id, span_id), all columns, when the watermark has passed the span by ``gap``.

    The order is that of ``operators.spans.dedup_spans``. State is one row a span, overwritten by a later arrival.
    """
    tie = [c for c in ("start_time", "duration", "operation_name", "service_name", "parent_span_id") if c not in order_cols]
    cols = [c for c in stream.columns if c not in ("trace_id", "span_id", EVENT_TS)]
    best = F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in [*order_cols, *tie]]))
    out = stream.groupBy("trace_id", "span_id", F.session_window(EVENT_TS, gap).alias("session")).agg(best.alias("s"))
    return out.select("trace_id", "span_id", "s.*")


# ---- I4: late spans ----------------------------------------------------------------------------------
def split_late(stream: DataFrame, on_time_path: str, late_path: str, checkpoint: str, delay: str = "10 minutes", ts_col: str = "start_time", trigger: dict | None = None, partitions: int | None = None) -> StreamingQuery:
    """I4: spans behind the watermark go to ``late_path``, all others to ``on_time_path``; none is dropped.

    The watermark of a micro-batch is the largest event time of the micro-batches before it less ``delay``, as
    Spark's own; it is kept in a journal beside the checkpoint. ``stream`` has no watermark of its own. A span without
    event time is on time.
    """
    journal = f"{checkpoint.rstrip('/')}-watermarks"

    def on_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = F.unix_micros(F.col(ts_col).cast("timestamp"))
        before = _earlier(spark, journal, epoch, "max_us long").agg(F.max("max_us")).first()[0]
        mark = F.expr(f"unix_micros(timestamp_micros({before}L) - interval {delay})") if before is not None else F.lit(None).cast("long")
        late = F.coalesce(at < mark, F.lit(False))
        _put(batch.filter(~late), on_time_path, epoch)
        _put(batch.filter(late), late_path, epoch)
        _write_journal(spark, journal, epoch, "max_us long", batch.agg(F.max(at)).first()[0])

    return started(stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint), stream.sparkSession, partitions, trigger)


# ---- I2: flush groups over micro-batches ---------------------------------------------------------------
def start_flush_groups(traces: DataFrame, path: str, checkpoint: str, order_cols: Sequence[str], size: int = FLUSH_TRACES, trigger: dict | None = None, partitions: int | None = None) -> StreamingQuery:
    """Number the traces of a stream over all micro-batches and cut them into groups of exactly ``size``.

    A micro-batch numbers its traces in ``order_cols`` order (a distributed sort) after those of the micro-batches before
    it, whose count is in the journal; a restart or a replay gives the same group ids. If micro-batches follow one
    another in ``order_cols`` order, as traces that a watermark closes do by their end, groups do not depend on
    how the stream was cut.
    """
    from ..operators.indexing import dense_index

    journal = f"{checkpoint.rstrip('/')}-counts"

    def on_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _earlier(spark, journal, epoch, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        traces = batch.persist()  # a sort reads its input twice, and with it the state
        try:
            numbered, n = dense_index(traces, order_cols, "_at")
            place = F.col("_at") + F.lit(int(before))
            _put(numbered.select(*batch.columns, F.floor(place / size).cast("long").alias("flush_group"), place.alias("place")), path, epoch)
        finally:
            traces.unpersist()
        _write_journal(spark, journal, epoch, "n long", n)

    return started(traces.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint), traces.sparkSession, partitions, trigger)


def full_groups(groups: DataFrame, size: int = FLUSH_TRACES) -> DataFrame:
    """The flush groups (and their traces) that have all their ``size`` traces, ready to be scored."""
    ready = groups.groupBy("flush_group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == size).select("flush_group")
    return groups.join(ready, "flush_group", "left_semi")


# ---- I6: features and model ---------------------------------------------------------------------------
def assembled_features(assembled: DataFrame, operations: Sequence[str] = SERVICE_OPERATIONS, keep: Sequence[str] = ()) -> DataFrame:
    """H6 from assembled traces (batch or stream): one feature row per request of a trace, missing durations as 0.

    A trace without a request has no feature row.
    """
    from ..operators.features import payload_features

    spans = [f"SpanD{i + 1}" for i in range(len(operations))]
    rows = assembled.select(
        F.col("trace_id").alias("Id"), *keep, F.explode(F.from_json(REQUESTS, "array<string>")).alias("request"),
        F.col("TraceD").cast("long").alias("TraceD"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in spans],
    )
    return payload_features(rows, "request", keep=("Id", *keep, "TraceD", *spans))


def publish_detector(spark: SparkSession, registry: str, version: int, path: str) -> None:
    """Makes a saved detector the one that samplers use from their next micro-batch on."""
    spark.createDataFrame([(version, path)], "version long, path string").coalesce(1).write.mode("append").parquet(registry)


def latest_detector(spark: SparkSession, registry: str) -> tuple[int, str] | None:
    """(version, path) last published, or None when nothing is trained yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(registry)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return tuple(spark.read.parquet(registry).select("version", "path").orderBy(F.col("version").desc(), "path").first() or ()) or None


def start_model_sampler(assembled: DataFrame, registry: str, decisions_path: str, checkpoint: str, load: Callable | None = None, trigger: dict | None = None, partitions: int | None = None) -> StreamingQuery:
    """Each micro-batch of assembled traces is scored by the detector published last; decisions go to ``decisions_path``.

    Decisions are (trace_id, anomalous, model_version), one row per trace; a trace is anomalous if one of its requests
    is. Without a published detector, and for a trace without a request, nothing is anomalous (version NULL in the first
    case). The version that a micro-batch uses is in the journal, so a replay scores with the same one. A detector is
    loaded once per version. ``load`` is (spark, path) -> model whose ``transform`` adds ``anomaly``.
    """
    from ..operators.cluster import feature_vector, load_detector
    from ..schema import FEATURE_COLUMNS

    journal, loaded = f"{checkpoint.rstrip('/')}-versions", {}
    load = load or load_detector

    def on_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        used = _earlier(spark, journal, epoch + 1, "version long, path string").filter(F.col("epoch") == epoch).first()
        if used is None:
            version, path = latest_detector(spark, registry) or (None, None)
            _write_journal(spark, journal, epoch, "version long, path string", version, path)
        else:
            version, path = used["version"], used["path"]
        traces = batch.filter("trace_id <> 0").persist()
        try:
            if path is None:
                odd = F.lit(False)
                decided = traces.select("trace_id", odd.alias("anomalous"), F.lit(None).cast("long").alias("model_version"))
            else:
                if path not in loaded:
                    loaded[path] = load(spark, path)
                model = loaded[path]
                rows = assembled_features(traces)
                flagged = model.transform(rows.withColumn(model.vec_col, feature_vector(FEATURE_COLUMNS))).groupBy("Id").agg(F.max("anomaly").alias("a"))
                joined = traces.select("trace_id").join(flagged, F.col("trace_id") == F.col("Id"), "left")
                decided = joined.select("trace_id", (F.coalesce("a", F.lit(0)) > 0).alias("anomalous"), F.lit(version).cast("long").alias("model_version"))
            _put(decided, decisions_path, epoch)
        finally:
            traces.unpersist()

    return started(assembled.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint), assembled.sparkSession, partitions, trigger)


# ---- I7 + C5: forwarding inside the stream ---------------------------------------------------------------
DECIDED = "decided_at"


def flagged_traces(assembled: DataFrame, flag: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(trace_id, decided_at) of the assembled traces that ``flag`` keeps, still a stream with a watermark.

    ``flag`` filters rows with built-in expressions; ``decided_at`` is the end of the trace's session.
    """
    return flag(assembled).select(F.col("trace_id").alias("_flagged"), F.window_time("session").alias(DECIDED))


def forward_flagged(spans: DataFrame, flagged: DataFrame, longest: str = "1 hour") -> DataFrame:
    """I7 + C5: the spans of flagged traces, by a stream-stream semi join of spans and decisions.

    A span waits in the state until its trace is decided, at most ``longest`` after the span's event time; then the
    watermark evicts it, forwarded or not. Both streams carry watermarks; no span is staged in a table.
    """
    met = F.expr(f"trace_id = _flagged AND {EVENT_TS} <= {DECIDED} AND {EVENT_TS} >= {DECIDED} - interval {longest}")
    return spans.join(flagged, met, "left_semi").drop(EVENT_TS)


def tail_sample_stream(source: Callable[[], DataFrame], flag: Callable[[DataFrame], DataFrame], watermark: str = "10 minutes", gap: str = "5 minutes", longest: str = "1 hour") -> DataFrame:
    """I7 as one streaming plan: dedup, assembly, decision and forwarding. ``source`` opens the span stream (read twice)."""
    spans = dedup_stream(with_event_time(source(), watermark))
    assembled = session_assembly(dedup_stream(with_event_time(source(), watermark)), gap=gap)
    return forward_flagged(spans, flagged_traces(assembled, flag), longest)
