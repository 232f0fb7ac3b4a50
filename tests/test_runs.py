"""E2 run numbering: the range-partitioned two-pass version equals the per-trace window, also for a hot trace."""

import datetime as dt

from pyspark.sql import functions as F

from tracesift.operators import spans as sp
from tracesift.operators.runs import process_runs
from tracesift.schema import SPAN_SCHEMA


def _spans(spark, n_hot=20000, n_small=300):
    # one hot trace (runs of random length over 3 services) plus many small traces
    hot = (spark.range(n_hot).select(
        F.lit(7).cast("long").alias("trace_id"), (F.col("id") + 1).alias("span_id"),
        F.lit(1).cast("long").alias("parent_span_id"), F.lit("op").alias("operation_name"),
        F.concat(F.lit("svc-"), (F.floor(F.col("id") / (F.pmod(F.col("id"), 7) + 1)) % 3).cast("string")).alias("service_name"),
    ))
    small = (spark.range(n_small * 5).select(
        (F.floor(F.col("id") / 5) + 100).cast("long").alias("trace_id"), F.col("id").alias("span_id"),
        F.lit(0).cast("long").alias("parent_span_id"), F.lit("op").alias("operation_name"),
        F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("service_name"),
    ))
    base = hot.unionByName(small)
    return base.select(
        "trace_id", "span_id", "parent_span_id", "operation_name", "service_name",
        F.array(F.struct(F.lit("host").alias("key"), F.lit("h").alias("value"))).alias("process_tags"),
        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("start_time"), F.lit(1).cast("long").alias("duration"),
        F.array().cast(SPAN_SCHEMA["tags"].dataType).alias("tags"), F.col("span_id").alias("arrival_seq"),
    )


def test_two_pass_equals_window_with_hot_trace(spark):
    s = _spans(spark)
    a = process_runs(s, num_partitions=16).select("trace_id", "span_id", "run_id")
    b = sp.process_runs_window(s).select("trace_id", "span_id", "run_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # the hot trace really was split over several partitions
    parts = (s.repartitionByRange(16, "trace_id", "span_id").filter("trace_id = 7")
             .select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts > 4


def test_single_partition_and_continuing_runs(spark):
    s = _spans(spark, n_hot=500, n_small=3)
    for parts in (1, 3, 50):
        a = process_runs(s, num_partitions=parts).select("trace_id", "span_id", "run_id")
        b = sp.process_runs_window(s).select("trace_id", "span_id", "run_id")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_trace_tree_combines_with_its_source(spark):
    from tracesift.sources.tables import spans_from_tables

    from .conftest import SF_SMALL

    s = sp.dedup_spans(spans_from_tables(spark, SF_SMALL))
    t = sp.trace_tree(s).select("trace_id", "span_id")
    src = s.select("trace_id", "span_id")
    # every tree node is a span; every span under a root is a tree node
    assert t.exceptAll(src).count() == 0
    assert t.count() == t.join(src, ["trace_id", "span_id"], "left_semi").count()


def test_children_of_a_hot_parent(spark):
    s = _spans(spark, n_hot=25000, n_small=10)  # one parent (span 1 of trace 7) with 25000 children
    out = sp.children_by_parent(s).filter("trace_id = 7")
    r = out.groupBy("parent_span_id").agg(F.count("*").alias("n"), F.max("position").alias("last"), F.countDistinct("position").alias("d")).orderBy(F.desc("n")).first()
    assert (r["last"] + 1, r["d"]) == (r["n"], r["n"])


def test_last_arrivals_move_only_the_columns_kept(spark):
    s = _spans(spark, n_hot=50, n_small=4)
    again = s.withColumn("arrival_seq", F.col("arrival_seq") + 1).withColumn("parent_span_id", F.col("parent_span_id") + 5)
    both = s.unionByName(again)
    cols = ("trace_id", "span_id", "parent_span_id")
    got, want = sp.dedup_spans(both, keep=cols), sp.dedup_spans(both).select(*cols)
    assert got.columns == list(cols) and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "process_tags" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_runs_compute_their_input_once_and_keep_its_columns(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    s = _spans(spark, n_hot=200, n_small=3)
    out = process_runs(s.mapInArrow(count, s.schema), num_partitions=4)
    assert out.columns == [*s.columns, "run_id"]
    assert out.drop("run_id").exceptAll(s).count() == 0 and out.count() == s.count()
    assert seen.value == s.count()


def test_tree_computes_its_spans_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    s = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2)], "trace_id long, span_id long, parent_span_id long")
    assert sp.trace_tree(s.mapInArrow(count, s.schema)).count() == 3
    assert seen.value == 3
