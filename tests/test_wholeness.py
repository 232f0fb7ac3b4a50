"""No depth, size or NULL cuts rows off, and forms chosen by size agree."""

import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracesift.functions import vector
from tracesift.operators import cluster as cl
from tracesift.operators import spans as sp
from tracesift.sources.io import parse_trace_requests, unjudged_requests

COLS = "trace_id long, span_id long, parent_span_id long"


def test_tree_follows_long_chains(spark):
    chain = spark.createDataFrame([(1, i + 1, i) for i in range(100)], COLS)
    assert sp.trace_tree(chain).agg(F.max("depth"), F.count("*")).first() == (99, 100)


def test_tree_reports_cycles(spark):
    # 1 -> 2 -> 3 -> 2: span 2 arrives with two parents
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 2, 3)], COLS)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = sorted((r["span_id"], r["depth"]) for r in sp.trace_tree(rows).collect())
    assert got == [(1, 0), (2, 1), (3, 2)]
    assert any("1 edges lead back" in str(w.message) for w in said)


def test_children_have_positions(spark):
    rows = spark.createDataFrame([(1, 100 + i, 7) for i in reversed(range(50))] + [(2, 5, 7), (2, 9, 0)], COLS)
    got = sorted((r["trace_id"], r["position"], r["span_id"]) for r in sp.children_by_parent(rows).collect())
    assert got == [(1, i, 100 + i) for i in range(50)] + [(2, 0, 5)]


@pytest.mark.parametrize("scale, gap", [(5e5, 0.001), (1e8, 1.0), (1.0, 0.0)])
def test_distance_forms_agree(spark, monkeypatch, scale, gap):
    rng = np.random.default_rng(3)
    cents = (scale + gap * rng.integers(0, 3, (6, 4))).tolist()
    rows = [(i, [float(v) for v in scale + gap * rng.normal(size=4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, x array<double>").repartition(2)

    def nearest():
        return [(r["i"], r["b"]["cluster"], r["b"]["dist"]) for r in df.select("i", vector.nearest_centroid_values("x", cents).alias("b")).orderBy("i").collect()]

    written_out = nearest()
    monkeypatch.setattr(vector, "UNROLL_LIMIT", 0)
    monkeypatch.setattr(vector, "BLOCK_CELLS", 60)
    assert nearest() == written_out


def test_distances_to_ten_centroids_are_not_interpreted(spark):
    """190 written-out terms make a method of more than the 8,000 bytes that the JVM compiles."""
    df = spark.createDataFrame([(0, [0.0] * 19)], "i int, x array<double>")
    near = df.select(vector.nearest_centroid_values("x", [[float(j)] * 19 for j in range(10)]).alias("b"))
    assert "ArrowEvalPython" in near._jdf.queryExecution().executedPlan().toString()
    assert near.first()["b"]["cluster"] == 0


def test_rows_with_nulls_are_kept_and_flagged(spark):
    rows = [(i, float(i % 5), float(i % 3)) for i in range(20)] + [(20, None, 1.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    model = cl.fit_detector(df, ["a", "b"], k=2)
    got = {r["i"]: r for r in model.transform(df).collect()}
    assert len(got) == 21
    assert got[20]["incomplete"] and got[20]["anomaly"] == 1
    assert not any(got[i]["incomplete"] for i in range(20))


def test_saved_detector_keeps_its_rules(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 5), float(i % 3)) for i in range(20)] + [(None, 2.0)], "a double, b double")
    model = cl.fit_detector(df, ["a", "b"], k=2)
    cl.save_detector(model, spark, str(tmp_path / "m"))
    loaded = cl.load_detector(spark, str(tmp_path / "m"))
    key = lambda r: str(r)
    cols = ["a", "b", "prediction", "dist", "anomaly", "incomplete"]
    assert sorted(map(tuple, loaded.transform(df).select(cols).collect()), key=key) == sorted(map(tuple, model.transform(df).select(cols).collect()), key=key)


def test_bad_elements_do_not_take_their_neighbours(spark):
    one, two = '{"traceID":1,"park-spot":5,"request":{"a":1}}', '{"traceID":2,"park-spot":6,"request":{"a":"],["}}'
    oops = '{"traceID": 3,"park-spot":5,"request":oops}'
    bodies = [f"[{one},{two}]", f" [{one} , {oops},{two}, 7, {{}}] ", "[]", None, "no array", f"[{one}", f"[{one}][{two}]", "[]]", '["]', "[[1],2]"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = sorted(((r["Id"], r["bad_body"]) for r in parse_trace_requests(df).collect()), key=str)
    want = [(1, None), (2, None)] * 2 + [(3, oops), (None, "7"), (None, "{}"), (None, "no array"), (1, f"[{one}"), (1, f"[{one}][{two}]"), (None, "[]]"), (None, '["]'), (None, "[1]"), (None, "2")]
    assert got == sorted(want, key=str)
    assert unjudged_requests(df).count() == 10
    rows = {r["Id"]: r for r in parse_trace_requests(df).filter("bad_body IS NULL").collect()}
    assert rows[2]["TraceD"] == 6 and rows[2]["request"] == '{"a":"],["}'


def test_run_numbers_of_long_groups():
    from tracesift.operators.runs import _number

    pdf = pd.DataFrame({"_g": ["a", "a", "a", "b", "b"], "_pk": ["x", "x", "y", "y", "y"]})
    ids, carry = _number(pdf, None)
    assert ids.tolist() == [0, 0, 1, 0, 0] and carry == ("b", "y", 1)
    ids, _ = _number(pd.DataFrame({"_g": ["b", "b"], "_pk": ["y", "z"]}), carry)
    assert ids.tolist() == [0, 1]
