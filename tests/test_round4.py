"""Forms for large inputs: state of streams, groups of traces, traces ordered in a task, payloads taken apart once, K-means in blocks."""

import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.test_scale_forms import _walk
from tests.test_stream_state import END, _add, _Handle, _span, _stream, _timed
from tracesift.functions import vector
from tracesift.functions.json import json_members
from tracesift.operators import augment, tour
from tracesift.operators import cluster as cl
from tracesift.operators.features import payload_features
from tracesift.plans import catalog
from tracesift.plans.registry import QUERIES
from tracesift.streaming import agent, state


def _tables(spark, path, n=200):
    spark.range(n).selectExpr(
        "id AS o_orderkey", "id % 5 AS o_custkey", "100.5D + id AS o_totalprice", "timestamp_ntz'2020-01-01 00:00:00' AS o_orderdate", "'HIGH' AS o_orderpriority"
    ).write.parquet(f"{path}/orders.parquet")
    spark.range(5).selectExpr("id AS c_custkey", "'AUTO' AS c_mktsegment").write.parquet(f"{path}/customer.parquet")
    spark.range(4 * n).selectExpr(
        f"id % {n} AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", f"cast(id div {n} + 1 as int) AS l_linenumber", "5D AS l_quantity", "timestamp_ntz'2020-01-01 00:00:00' AS l_shipdate"
    ).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_state_has_a_number_of_partitions_of_its_own(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    _add(spark, src, [_span(1, 0, 0), _span(1, 0, 0)], END)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    agent.stage_spans(agent.dedup_stream(_timed(spark, src)), out, ck, partitions=3).awaitTermination()
    assert sorted(p for p in os.listdir(f"{ck}/state/0") if p.isdigit()) == ["0", "1", "2"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.read.parquet(out).filter("trace_id = 1").count() == 1


class _Stop(Exception):
    pass


@pytest.mark.parametrize("name", ["stream_forward", "stream_emit_complete", "stream_flush", "stream_tail_sample", "stream_model_sample", "stream_score"])
def test_state_of_the_stream_queries_does_not_follow_shuffle_partitions(spark, tmp_path, monkeypatch, name):
    from tracesift.session import ship_package

    def seen(writer, spark, partitions=None, trigger=None):
        raise _Stop(partitions)

    ship_package(spark)
    for module in (agent, state):
        monkeypatch.setattr(module, "started", seen)
    before, store = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(state.STATE_STORE)
    sf = _tables(spark, tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        with pytest.raises(_Stop) as stop:
            QUERIES[name].build(spark, sf)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert stop.value.args[0] and stop.value.args[0] <= max(6, spark.sparkContext.defaultParallelism)
    assert spark.conf.get(state.STATE_STORE) == store  # later streams keep theirs


def test_a_micro_batch_takes_several_files(spark, tmp_path):
    src = catalog._span_source(spark, _tables(spark, tmp_path / "t"), most=25)
    n = len(glob.glob(f"{src.removeprefix('file:')}/part-*"))
    for files, per in ((6, 6), (3, 3), (1000, n // catalog.STREAM_SLICES)):
        q = agent.started(catalog._stream(spark, None, src, files).writeStream.format("noop").option("checkpointLocation", str(tmp_path / f"ck{files}")), spark)
        q.awaitTermination()
        rows = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        assert len(rows) == math.ceil(n / per) and sum(rows) == 1001


def test_flush_groups_compute_a_micro_batch_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    _add(spark, src, [_span(t, 0, t) for t in range(1, 11)])
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    traces = _stream(spark, src).select(counted("trace_id").alias("trace_id"))
    state.start_flush_groups(traces, out, ck, ["trace_id"], 4).awaitTermination()
    got = spark.read.schema("trace_id long, flush_group long, place long").parquet(out).orderBy("trace_id").collect()
    assert [r["flush_group"] for r in got] == [0] * 4 + [1] * 4 + [2] * 2
    assert seen.value == 10


def test_traces_of_a_group_share_the_state():
    import json

    def span(trace, n, at, duration=5):
        return Row(facts=json.dumps(dict(zip(state.SPAN_FACTS, (trace, n, n, n == 0, "Payment-service", duration, None, at)))))

    class Handle(_Handle):
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

        def deleteTimer(self, at):
            self.timers.remove(at)

    handle, traces = Handle(), state.CompleteTraces(3, ("Payment-service",), 1000, grouped=True)
    traces.init(handle)
    rows = [span(t, n, 10 * t + n) for n in range(2) for t in (7, 8, 9)]
    assert list(traces.handleInputRows((0,), iter(rows), handle)) == []
    assert (handle.value.writes, handle.map.writes, handle.timers) == (1, 0, [1071])
    (row,) = traces.handleInputRows((0,), iter([span(8, 2, 95, 9), span(9, 1, 700), span(6, 0, 1)]), handle)
    assert (row.trace_id, row.n_spans, row.complete, row.TraceD, row.SpanD1) == (8, 3, True, 5, 9)
    assert handle.value.writes == 2 and handle.timers == [1001]  # trace 6 is due first
    handle.now, handle.timers = 1500, []
    late = list(traces.handleExpiredTimer((0,), handle, None))
    assert [(r.trace_id, r.n_spans, r.complete) for r in late] == [(7, 2, False), (6, 1, False)]
    assert handle.timers == [1700]  # trace 9 was put off
    handle.now, handle.timers = 1700, []
    assert [(r.trace_id, r.last_event_ms) for r in traces.handleExpiredTimer((0,), handle, None)] == [(9, 700)]
    assert not handle.value.kept and handle.timers == []


@pytest.mark.parametrize("most", [12, 4096])
def test_small_traces_are_ordered_in_a_task(spark, monkeypatch, most):
    rng, rows = np.random.default_rng(5), []
    for t in [*range(-3, 12), 1 << 60]:
        ids = (rng.permutation(30)[: 1 + abs(t) % 29] + 1 + (abs(t) % 1000 << 40)).tolist()
        rows += [(t, s, 0 if i < 1 + t % 2 else ids[int(rng.integers(0, i))]) for i, s in enumerate(ids)]
    rows += [(50, 1, 2), (50, 2, 1), (50, 3, 0), (50, 4, 99), (50, 5, 4), (50, 6, 6), (50, -7, 3), (51, 1, 2), (51, 2, 1), (52, 5, 5), (53, 4, 0)]
    rows += [(54, s, s - 1) for s in range(1, 40)]
    written = []
    stored = tour.stored
    monkeypatch.setattr(tour, "stored", lambda df, name="": written.append(name) or stored(df, name))
    monkeypatch.setattr(tour, "WALK_SPANS", most)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = tour.trace_order(spark.createDataFrame(rows, "trace_id long, span_id long, parent_span_id long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len({(r["trace_id"], r["span_id"]) for r in got})
    assert {(r["trace_id"], r["span_id"]): (r["root_span_id"], r["depth"], r["position"]) for r in got} == _walk(rows)
    assert ("tour" in written) == (most < 4096)


ODD_TEXTS = [
    '{"a":1}', ' { "Username" : "x" , "a":[1,{"b":","}] , "Password":null } ', "{}", '{"password":"p","Password":"q","CreditCard":1,"CreditCard":"2"}', "[1]", "oops", None, "",
    '{"a":' * 9 + "1" + "}" * 9, "{'a':'x'}", "{'a':'x,y'}", '{"a":1} tail', '{"a":1}{"b":2}', '{"a":oops}', '{"User\\u006eame":"\\"}"}', '{"a":1,}', '{"b":1.10,"b":1e3}',
]


def test_variants_start_from_the_members_of_their_base(spark):
    rows = spark.createDataFrame([(100 * k + i, t) for k in range(20) for i, t in enumerate(ODD_TEXTS)], "Id long, request string")
    got = augment.augment_rows(rows, 4, rate=0.3)
    base = augment.inject_anomalies(rows.withColumn("copy", F.lit(0)), rate=0.3)  # two passes over the text
    more = base.select("Id", "request").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(4))))
    want = base.unionByName(augment.inject_anomalies(more, rate=0.3))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()  # the base is edited once
    assert {r["Id"] for r in rows.filter(json_members("request").isNotNull()).collect()} == {r["Id"] for r in got.filter("edited AND copy = 0").collect()}


def test_payload_features_are_compiled(spark):
    """The JVM compiles no method of more than 8,000 bytes; rows would be interpreted."""
    rows = spark.createDataFrame([(1, '{"USERNAME":"abc","PassWord":null,"Money":1.5,"money":22}')], "Id long, request string")
    got = payload_features(rows.repartition(2), "request", case_insensitive=True)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    plan = payload_features(spark.read.schema("Id long, request string").json(spark.sparkContext.emptyRDD().map(str)), "request", case_insensitive=True)
    sizes = [c._3().maxMethodCodeSize() for c in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(debug.codegenStringSeq(plan._jdf.queryExecution().executedPlan()))]
    assert all(s < 8000 for s in sizes)
    row = got.first()
    assert (row["usernameE"], row["usernameL"], row["passwordE"], row["passwordL"], row["MoneyE"], row["MoneyL"], row["AddressE"]) == (1, 3, 1, 4, 1, 3, 0)


def test_distances_to_all_centroids_are_vectorised(spark):
    rng = np.random.default_rng(6)
    cents, x = rng.normal(size=(10, 19)), rng.normal(size=(50, 19))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>").repartition(3)
    got = df.select("i", vector.centroid_distances("x", cents.tolist()).alias("d"), vector.nearest_centroid_values("x", cents.tolist()).alias("b"))
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        want = np.sqrt(((cents - x[r["i"]]) ** 2).sum(1))
        assert np.allclose(r["d"], want) and r["b"]["cluster"] == want.argmin() and r["b"]["dist"] == r["d"][r["b"]["cluster"]]


def test_kmeans_over_numbers_takes_blocks(spark):
    df = spark.createDataFrame([(float(i % 5), float(i % 3)) for i in range(60)], "a double, b double")
    model = cl.fit_detector(df, ["a", "b"], k=3)
    assert model.clusterer.getSolver() == "block"
    means = {r["prediction"]: (r["a"], r["b"]) for r in model.transform(df).groupBy("prediction").agg(F.avg("a").alias("a"), F.avg("b").alias("b")).collect()}
    assert all(np.allclose(model.centroids[k], m) for k, m in means.items())
