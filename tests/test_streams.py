"""Traces over several micro-batches: none is lost, and none is emitted twice."""

import datetime as dt

from pyspark.sql import functions as F

from tracesift.schema import SPAN_SCHEMA
from tracesift.streaming import agent


def _span(trace, n, second, root=False):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)
    tags = [("request", "string", "{}"), ("request", "string", "{\"a\":1}")] if root else []
    return (trace, trace * 100 + n, 0 if root else trace * 100, "park-spot", "svc", None, at, 5, tags, n)


def _files(spark, path, *files):
    for rows in files:
        spark.createDataFrame(rows, SPAN_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return agent.dedup_stream(agent.with_event_time(agent.span_stream(spark, path, max_files_per_trigger=1), "1 minute"))


def test_trace_of_twelve_spans_in_two_batches(spark, tmp_path):
    first = [_span(1, n, n, n == 0) for n in range(8)] + [_span(2, 0, 3, True)]
    then = [_span(1, n, n, False) for n in range(8, 12)] + [_span(2, 1, 9)]
    late = [_span(9, 0, 7200, True)]
    early = agent.assemble_traces(_files(spark, str(tmp_path / "a"), first, then, late), 8, timeout_ms=60_000)
    got = sorted((r["trace_id"], r["n_spans"], r["complete"]) for r in agent.run_to_table(early, spark, "early").collect())
    assert got == [(1, 8, True), (2, 2, False)]

    closed = agent.session_assembly(_files(spark, str(tmp_path / "b"), first, then, late), "5 minutes")
    rows = agent.run_to_table(closed, spark, "closed")
    got = sorted((r["trace_id"], r["n_spans"], r["complete"]) for r in rows.collect())
    assert got == [(1, 12, True), (2, 2, False)]
    texts = rows.select(F.from_json(agent.REQUESTS, "array<string>")).first()[0]
    assert texts == ["{}", "{\"a\":1}"]  # every request tag


def test_repeated_spans_count_once(spark, tmp_path):
    a = [_span(1, n, n, n == 0) for n in range(5)]
    closed = agent.session_assembly(_files(spark, str(tmp_path / "c"), a, a, [_span(9, 0, 7200, True)]), "5 minutes")
    assert [(r["trace_id"], r["n_spans"]) for r in agent.run_to_table(closed, spark, "dup").collect()] == [(1, 5)]


def test_micro_batches_stay_small_whatever_the_tables_hold(spark, tmp_path):
    """The span source of the stream queries: one file a micro-batch, bounded, in order of event time, with all spans."""
    from tracesift.plans import catalog

    n, most = 500, 300
    spark.range(n).selectExpr(
        "id AS o_orderkey", "id % 5 AS o_custkey", "100.5D AS o_totalprice", "timestamp_ntz'2020-01-01 00:00:00' AS o_orderdate", "'HIGH' AS o_orderpriority"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(5).selectExpr("id AS c_custkey", "'AUTO' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(4 * n).selectExpr(
        "id % 500 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "cast(id div 500 + 1 as int) AS l_linenumber", "5D AS l_quantity", "timestamp_ntz'2020-01-01 00:00:00' AS l_shipdate"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    path = catalog._span_source(spark, str(tmp_path), most=most)
    read = spark.read.parquet(path).selectExpr("trace_id", "span_id", "unix_seconds(cast(start_time as timestamp)) AS s", "_metadata.file_modification_time AS m").collect()
    files = {}
    for r in read:
        files.setdefault(r["m"], []).append(r)
    order = [files[m] for m in sorted(files)]
    assert len(order) > 5 and [len(f) for f in order[-1:]] == [1] and order[-1][0]["trace_id"] == 0
    assert max(map(len, order)) <= most
    assert all(max(r["s"] for r in a) < min(r["s"] for r in b) for a, b in zip(order, order[1:]))
    spans = sorted((r["trace_id"], r["span_id"]) for f in order[:-1] for r in f)
    assert spans == sorted((t, t * 100 + k) for t in range(1, n + 1) for k in range(5))


def test_cells_are_joined_up_to_the_limit_and_never_over_a_slice():
    from tracesift.plans.catalog import SLICE_CELLS, _micro_batches

    cells = [(0, 3), (1, 3), (2, 3), (5, 9), (SLICE_CELLS, 1), (SLICE_CELLS + 4, 1)]
    assert _micro_batches(cells, 6) == {0: 0, 1: 0, 2: 1, 5: 2, SLICE_CELLS: 3, SLICE_CELLS + 4: 3}
