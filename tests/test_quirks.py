"""One test per decided quirk."""

import datetime as dt

from pyspark.sql import functions as F

from tracesift.operators import features as feat
from tracesift.operators import spans as sp
from tracesift.schema import SERVICE_OPERATIONS, SPAN_SCHEMA


def _span(trace, span, parent, op, dur, tags=None, seq=0, svc="svc"):
    return (trace, span, parent, op, svc, [("host", "h")], dt.datetime(2024, 1, 1), dur, tags or [], seq)


REQ = '{"CreditCard":1234567890123456,"Position":"1, 2","Address":"x","Money":"1$","username":"u","password":"p"}'


def _trace(spark, extra=()):
    rows = [
        _span(1, 100, 0, "park-spot", 50, [("request", "string", REQ)]),
        _span(1, 101, 100, "authentication-service", 1),
        _span(1, 102, 100, "verification-service", 2),
        _span(1, 103, 100, "Spot-Finder-service", 3),
        _span(1, 104, 102, "Payment-service", 4),
        *extra,
    ]
    return spark.createDataFrame(rows, SPAN_SCHEMA)


def test_q1_fixed_duration_order(spark):
    r = feat.trace_features(_trace(spark)).first()
    # training order: Payment, Spot-Finder, authentication, verification (binary sort)
    assert list(SERVICE_OPERATIONS) == sorted(SERVICE_OPERATIONS)
    assert (r["SpanD1"], r["SpanD2"], r["SpanD3"], r["SpanD4"]) == (4, 3, 1, 2)


def test_q4_missing_modes(spark):
    s = _trace(spark).filter(F.col("operation_name") != "Payment-service")
    assert feat.trace_features(s, missing="zero").first()["SpanD1"] == 0
    assert feat.trace_features(s, missing="null").first()["SpanD1"] is None
    assert feat.trace_features(s, missing="drop").count() == 0


def test_q5_id_always_present(spark):
    s = _trace(spark).withColumn("trace_id", F.lit(0).cast("long"))
    assert "Id" in feat.trace_features(s).columns


def test_q6_one_row_per_request_tag(spark):
    s = _trace(spark).withColumn(
        "tags", F.when(F.col("parent_span_id") == 0, F.concat("tags", "tags")).otherwise(F.col("tags"))
    )
    assert feat.trace_features(s).count() == 2


def test_q19_dedup_before_complete(spark):
    extra = [_span(1, 101, 100, "authentication-service", 9, seq=5), _span(1, 105, 100, "authentication", 1),
             _span(1, 106, 100, "verification", 1), _span(1, 107, 100, "spotFinder", 1)]
    s = _trace(spark, extra)
    assert sp.spans_per_trace(s).first()["n_spans"] == 9
    assert sp.complete_traces(sp.dedup_spans(s), 8, strict=True).count() == 1
    # last-wins: the later arrival's duration is kept
    d = sp.dedup_spans(s).filter("span_id = 101").first()
    assert d["duration"] == 9


def test_q24_anchored_regex(spark):
    s = _trace(spark, [_span(1, 108, 100, "service-x", 1)])
    assert s.filter(sp.is_service_span("suffix")).count() == 4
    assert s.filter(sp.is_service_span("contains")).count() == 5


def test_q26_root_by_parent(spark):
    s = _trace(spark).withColumn("span_id", F.col("span_id") + 7)  # root id no longer equals anything special
    assert sp.root_spans(s, None).count() == 1


def test_trace_tree_preorder(spark):
    t = sp.trace_tree(_trace(spark)).orderBy("trace_id", "path").collect()
    assert [r["span_id"] for r in t] == [100, 101, 102, 104, 103]
    assert [r["depth"] for r in t] == [0, 1, 1, 2, 1]


def test_process_runs(spark):
    rows = [_span(1, 100 + i, 0 if i == 0 else 100, "op", 1, svc=s) for i, s in enumerate("aabba")]
    runs = sp.process_runs(spark.createDataFrame(rows, SPAN_SCHEMA)).orderBy("span_id").collect()
    assert [r["run_id"] for r in runs] == [0, 0, 1, 1, 2]


def test_head_sample_trace_coherent(spark):
    from tracesift.operators.sampling import head_sample
    from tracesift.sources.tables import spans_from_tables

    from .conftest import SF_SMALL

    s = spans_from_tables(spark, SF_SMALL)
    kept = head_sample(s, 0.3, 1)
    per = kept.groupBy("trace_id").count().join(s.groupBy("trace_id").count().withColumnRenamed("count", "all"), "trace_id")
    assert per.filter("count != all").count() == 0  # a trace is kept whole or not at all
    share = kept.select("trace_id").distinct().count() / s.select("trace_id").distinct().count()
    assert 0.2 < share < 0.4


def test_q25_no_request_no_features(spark):
    s = _trace(spark).withColumn("tags", F.when(F.col("parent_span_id") == 0, F.array().cast(SPAN_SCHEMA["tags"].dataType))
                                 .otherwise(F.col("tags")))
    assert feat.trace_features(s).count() == 0


def test_span_batches_explode(spark):
    """A batch {process, spans[]} becomes one canonical span row per span."""
    from tracesift.sources.io import explode_batches, span_batch_schema

    s = _trace(spark)
    inner = [f for f in span_batch_schema()["spans"].dataType.elementType.names]
    batches = s.groupBy("service_name", "process_tags").agg(
        F.collect_list(F.struct(*[F.col(c) for c in inner])).alias("spans")
    )
    out = explode_batches(batches)
    assert out.columns == SPAN_SCHEMA.names
    assert out.count() == s.count()
