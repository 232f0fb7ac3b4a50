"""Stateful stream operators over several micro-batches: completion, last arrival, late spans, flush groups, models, forwarding."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracesift.operators import cluster as cl
from tracesift.schema import FEATURE_COLUMNS, SPAN_SCHEMA
from tracesift.streaming import agent, state

T0 = dt.datetime(2024, 1, 1)


def _span(trace, n, second, op=None, duration=5, seq=None, request=None):
    tags = [("request", "string", request)] if request else []
    return (trace, trace * 100 + n, 0 if n == 0 else trace * 100, op or ("park-spot" if n == 0 else "x-service"), "svc", None, T0 + dt.timedelta(seconds=second), duration, tags, n if seq is None else seq)


END = [_span(0, 0, 90_000)]


def _add(spark, path, *files):
    for rows in files:
        spark.createDataFrame(rows, SPAN_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path, per_trigger=1):
    return agent.span_stream(spark, path, max_files_per_trigger=per_trigger)


def _timed(spark, path, per_trigger=1):
    return agent.with_event_time(_stream(spark, path, per_trigger), "1 minute")


def test_complete_traces_leave_at_once_and_once(spark, tmp_path):
    src = str(tmp_path / "in")
    first = [_span(1, n, n) for n in range(5)] + [_span(1, 2, 2, seq=50)] + [_span(2, 0, 3), _span(3, 0, 4, request="{}")]
    then = [_span(1, n, n) for n in range(5, 12)] + [_span(3, 1, 5, "Payment-service", 7, seq=1), _span(3, 1, 5, "Payment-service", 9, seq=3), _span(3, 1, 5, "Payment-service", 8, seq=2)]
    again = [_span(1, 12, 20), _span(1, 0, 0)]
    _add(spark, src, first, then, again, END)
    rows = agent.run_to_table(state.emit_complete(_timed(spark, src), 8, timeout="1 minute"), spark, "emit").filter("trace_id <> 0").collect()
    got = {r["trace_id"]: r for r in rows}
    assert len(rows) == 3
    assert got[1]["complete"] and got[1]["n_spans"] == 12 and got[1]["watermark_ms"] < got[1]["last_event_ms"] + 60_000  # 5 spans, then 7 more in one batch
    assert not got[2]["complete"] and got[2]["n_spans"] == 1 and got[2]["watermark_ms"] >= got[2]["last_event_ms"] + 60_000
    assert got[3]["n_spans"] == 2 and got[3]["SpanD1"] == 9 and got[3]["requests"] == '["{}"]'


def test_last_arrival_wins(spark, tmp_path):
    src = str(tmp_path / "in")
    _add(spark, src, [_span(1, 1, 1, duration=3, seq=7), _span(1, 2, 2)], [_span(1, 1, 1, duration=4, seq=9), _span(1, 1, 1, duration=5, seq=8)], END)
    rows = agent.run_to_table(state.last_arrivals(_timed(spark, src), "30 seconds"), spark, "last").filter("trace_id <> 0").collect()
    assert sorted((r["span_id"], r["duration"], r["arrival_seq"]) for r in rows) == [(101, 4, 9), (102, 5, 2)]


def test_late_spans_are_kept_apart(spark, tmp_path):
    src, kept, late, ck = (str(tmp_path / n) for n in ("in", "kept", "late", "ck"))
    _add(spark, src, [_span(1, 0, 0), _span(1, 1, 500)], [_span(2, 0, 100), _span(2, 1, 450), _span(2, 2, 900)])
    state.split_late(_stream(spark, src), kept, late, ck, "1 minute").awaitTermination()
    _add(spark, src, [_span(3, 0, 800), _span(3, 1, 850)])  # after a restart, the watermark is known still
    state.split_late(_stream(spark, src), kept, late, ck, "1 minute").awaitTermination()
    ids = lambda p: sorted(r[0] for r in spark.read.schema(SPAN_SCHEMA).parquet(p).select("span_id").collect())
    assert ids(late) == [200, 300] and ids(kept) == [100, 101, 201, 202, 301]


@pytest.mark.parametrize("per_trigger", [1, 5])
def test_flush_groups_run_over_micro_batches(spark, tmp_path, per_trigger):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    files = [[_span(100 * f + t, 0, 600 * f + 7 * t) for t in range(1, 8)] for f in range(5)]

    def run():
        # behind a dedup, since a filter on trace_id would otherwise be pushed below the watermark, which END moves
        closed = agent.session_assembly(agent.dedup_stream(_timed(spark, src, per_trigger)), "30 seconds", expected=1).filter("trace_id <> 0")
        narrow = closed.select("trace_id", F.col("session.end").alias("ended"))
        state.start_flush_groups(narrow, out, ck, ["ended", "trace_id"], 10).awaitTermination()

    _add(spark, src, *files[:3])
    run()
    _add(spark, src, *files[3:], END)
    run()
    rows = spark.read.schema("trace_id long, flush_group long, place long").parquet(out)
    want = [t for f in range(5) for t in range(100 * f + 1, 100 * f + 8)]
    assert [(r["trace_id"], r["flush_group"], r["place"]) for r in rows.orderBy("place").collect()] == [(t, i // 10, i) for i, t in enumerate(want)]
    assert Counter(r["flush_group"] for r in state.full_groups(rows, 10).collect()) == {0: 10, 1: 10, 2: 10}


def _detector(limit):
    return cl.ClusterDetectorModel([[0.0] * len(FEATURE_COLUMNS)], [limit], "vec")


def test_sampler_follows_the_published_model(spark, tmp_path):
    src, registry, out, ck = (str(tmp_path / n) for n in ("in", "reg", "out", "ck"))

    def run():
        state.start_model_sampler(agent.session_assembly(_timed(spark, src), "30 seconds"), registry, out, ck).awaitTermination()

    def rows():
        return {r["trace_id"]: (r["anomalous"], r["model_version"]) for r in spark.read.schema("trace_id long, anomalous boolean, model_version long").parquet(out).collect()}

    _add(spark, src, [_span(1, 0, 0, duration=50, request="{}")], [_span(9, 0, 600)], [_span(9, 1, 1200)])
    run()
    assert rows()[1] == (False, None)  # nothing trained yet
    cl.save_detector(_detector(20.0), spark, str(tmp_path / "m1"))
    state.publish_detector(spark, registry, 1, str(tmp_path / "m1"))
    _add(spark, src, [_span(2, 0, 1300, duration=50, request="{}"), _span(3, 0, 1300, duration=1, request="{}"), _span(4, 0, 1300, duration=50)], [_span(9, 2, 1900)], [_span(9, 3, 2500)])
    run()
    assert rows()[2] == (True, 1) and rows()[3] == (False, 1) and rows()[4] == (False, 1)
    cl.save_detector(_detector(100.0), spark, str(tmp_path / "m2"))
    state.publish_detector(spark, registry, 2, str(tmp_path / "m2"))
    _add(spark, src, [_span(5, 0, 2600, duration=50, request="{}")], END, [_span(0, 1, 90_001)])
    run()
    assert rows()[5] == (False, 2) and rows()[2] == (True, 1)


def test_forwarding_inside_the_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    _add(spark, src, [_span(1, 0, 0, request="{}"), _span(2, 0, 1)], [_span(1, 1, 5), _span(1, 1, 5), _span(2, 1, 6)], [_span(1, 2, 9), _span(3, 0, 300, request="{}")], END, [_span(0, 1, 90_100)])
    kept = state.tail_sample_stream(lambda: _stream(spark, src), lambda a: a.filter(F.col(agent.REQUESTS).isNotNull() & (F.col(agent.REQUESTS) != "[]")), "1 minute", "30 seconds")
    got = agent.run_to_table(kept, spark, "forward")
    assert sorted(r["span_id"] for r in got.filter("trace_id <> 0").collect()) == [100, 101, 102, 300]
    assert set(got.columns) == set(SPAN_SCHEMA.names)


class _Cells:
    """A state variable of one trace in memory, which counts its writes."""

    def __init__(self):
        self.kept, self.writes = {}, 0

    def exists(self):
        return () in self.kept

    def get(self):
        return self.kept[()]

    def update(self, value):
        self.updateValue((), value)

    def containsKey(self, key):
        return key in self.kept

    def getValue(self, key):
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.kept[key] = value
        self.writes += 1

    def iterator(self):
        return iter(list(self.kept.items()))

    def clear(self):
        self.kept.clear()


class _Handle(_Cells):
    def __init__(self):
        self.value, self.map, self.timers = _Cells(), _Cells(), []

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return self.value

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 0


@pytest.mark.parametrize("most", [8, 4096])
def test_a_micro_batch_writes_the_state_of_a_trace_once(most):
    from pyspark.sql import Row

    def span(n, seq=0, duration=5):
        return Row(span_id=n, event_ms=n, arrival_seq=seq, is_root=n == 0, operation_name="Payment-service", duration=duration, requests=None)

    handle, traces = _Handle(), state.CompleteTraces(8, ("Payment-service",), 1000)
    traces.MOST = most
    traces.init(handle)
    assert list(traces.handleInputRows((1,), iter([span(n) for n in range(5)] + [span(4, 3, 9), span(4, 2, 70)]), handle)) == []
    assert (handle.value.writes, handle.map.writes, len(handle.timers)) == (1, 0, 1)
    (row,) = traces.handleInputRows((1,), iter([span(4, 1, 80), *(span(n) for n in range(3, 30)), span(20, 9, 6)]), handle)
    assert (row.n_spans, row.complete, row.TraceD, row.SpanD1, row.last_event_ms) == (30, True, 5, 9, 29)
    assert handle.value.writes == 2 and (handle.map.writes == 0) == (most == 4096) and not handle.map.kept
    assert list(traces.handleInputRows((1,), iter([span(40)]), handle)) == []
