"""Forms for inputs of any size: trees by pointer jumping, counted samples, centroid blocks, running thresholds, independent draws."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesift import session
from tracesift.operators import cluster as cl
from tracesift.operators import sampling, tour
from tracesift.operators.evaluate import RunningThreshold
from tracesift.operators.iforest import binomial_steps


def _walk(rows):
    """Plain depth-first walk: {(trace, span): (root, depth, position)}."""
    kids, out = {}, {}
    for t, s, p in rows:
        kids.setdefault((t, p), []).append(s)
    for t in {r[0] for r in rows}:
        for root in sorted(kids.get((t, 0), [])):
            todo, n = [(root, 0)], 0
            while todo:
                s, d = todo.pop()
                out[t, s] = (root, d, n)
                n += 1
                todo += [(c, d + 1) for c in sorted(kids.get((t, s), []), reverse=True)]
    return out


def _order(spark, rows):
    got = tour.trace_order(spark.createDataFrame(rows, "trace_id long, span_id long, parent_span_id long")).collect()
    assert len(got) == len({(r["trace_id"], r["span_id"]) for r in got})
    return {(r["trace_id"], r["span_id"]): (r["root_span_id"], r["depth"], r["position"]) for r in got}


def test_trace_order_of_random_trees(spark):
    rng = np.random.default_rng(4)
    rows = []
    for t in range(1, 12):
        ids = rng.permutation(np.arange(1, 40)).tolist()
        rows += [(t, s, 0 if i < 1 + t % 2 else ids[int(rng.integers(0, i))]) for i, s in enumerate(ids)]
    rows += [(50, 1, 2), (50, 2, 1), (50, 3, 0), (50, 4, 99), (50, 5, 4), (50, 6, 6)]  # a circle, a root, an orphan with a child, a loop
    assert _order(spark, rows) == _walk(rows)
    assert _order(spark, rows[:0]) == {}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(tour, "stored", lambda df, name="": written.append(name) or session.stored(df, name))
    rows = [(1, s, s - 1) for s in range(1, 10_001)] + [(2, 1, 0)]
    got = _order(spark, rows)
    assert got[1, 10_000] == (1, 9_999, 9_999) and len(got) == 10_001
    assert written.count("tour") <= 20


@pytest.mark.parametrize("few", [1 << 16, 4])
def test_reservoir_has_its_size_and_the_count(spark, monkeypatch, few):
    monkeypatch.setattr(sampling, "_FEW_ROWS", few)
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 10).alias("v")).union(spark.range(2000).select(F.lit(-1).cast("long"), F.lit(0).cast("long")))
    for k in (0, 1, 700, 4999, 5000, 9000):
        rows, n = sampling.reservoir_sample_and_count(df, k, 3, ["id"])
        assert (rows.count(), n) == (min(k, 5000), 5000)
    empty, n = sampling.reservoir_sample_and_count(df.limit(0), 5, 3, ["id"])
    assert (empty.count(), n) == (0, 0)
    same = sampling.reservoir_sample(df.filter("id >= 0"), 300, 3, ["id"])
    assert {r["id"] for r in sampling.reservoir_sample_and_count(df.filter("id >= 0"), 300, 3, ["id"])[0].collect()} == {r["id"] for r in same.collect()}


def test_reservoir_is_uniform(spark):
    df = spark.range(200)
    hits = Counter()
    for seed in range(30):
        hits.update(r["id"] for r in sampling.reservoir_sample_and_count(df, 50, seed, ["id"])[0].collect())
    chi = sum((hits[i] - 7.5) ** 2 / (7.5 * 0.75) for i in range(200))
    assert abs(chi - 200) < 5 * math.sqrt(2 * 200)


def test_large_centroid_tables(spark):
    rng = np.random.default_rng(1)
    cents = rng.normal(size=(20_000, 300)).round(2)
    x = np.concatenate([cents[rng.integers(0, 20_000, 30)] + rng.normal(size=(30, 300)), cents[[7, 19_999]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, vec array<double>").repartition(2)
    got = {r["i"]: r for r in cl.assign_nearest(df, "vec", cents.tolist()).collect()}
    d = np.stack([np.sqrt(((cents - v) ** 2).sum(1)) for v in x])
    assert [got[i]["prediction"] for i in range(32)] == d.argmin(1).tolist()
    assert all(got[i]["dist"] == pytest.approx(d[i].min(), abs=1e-9) for i in range(32))
    flagged = cl.flag_anomalies(cl.assign_nearest(df, "vec", cents.tolist()), [1.0] * 20_000).collect()
    assert {r["i"] for r in flagged if not r["anomaly"]} == {30, 31}


def test_blocks_equal_the_whole_table(spark, monkeypatch):
    rng = np.random.default_rng(2)
    cents = rng.integers(0, 3, size=(40, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(rng.integers(0, 4, size=4).astype(float).tolist(),) for _ in range(200)], "vec array<double>")
    whole = Counter((tuple(r["vec"]), r["prediction"], r["dist"]) for r in cl.assign_nearest(df, "vec", cents.tolist()).collect())
    given = df.withColumn("prediction", F.lit(3))
    near = Counter((tuple(r["vec"]), round(r["dist"], 9)) for r in cl.distance_to_cluster(given, "vec", "prediction", cents.tolist()).collect())
    monkeypatch.setattr(cl, "BLOCK_CELLS", 12)
    assert Counter((tuple(r["vec"]), r["prediction"], r["dist"]) for r in cl.assign_nearest(df, "vec", cents.tolist()).collect()) == whole
    assert Counter((tuple(r["vec"]), round(r["dist"], 9)) for r in cl.distance_to_cluster(given, "vec", "prediction", cents.tolist()).collect()) == near


def test_threshold_over_micro_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    running, seen = RunningThreshold(spark, str(tmp_path / "t"), contamination=0.2), []
    for epoch in range(4):
        part = rng.normal(epoch, 1, 2000)
        seen.append(part)
        df = spark.createDataFrame([(float(v),) for v in part] + [(None,), (float("nan"),)], "anomalyScore double")
        got = running.update(df, epoch)
        assert abs((np.concatenate(seen) <= got).mean() - 0.8) < 0.01
    again = running.update(spark.createDataFrame([(float(v),) for v in seen[1]], "anomalyScore double"), 1)  # a replay
    assert abs((np.concatenate(seen[:2]) <= again).mean() - 0.8) < 0.01
    assert RunningThreshold(spark, str(tmp_path / "e")).update(df.limit(0), 0) is None


@pytest.mark.parametrize("trees,p", [(100, 0.002), (20, 0.4), (1, 0.5), (7, 1.0)])
def test_binomial_steps(trees, p):
    steps = binomial_steps(trees, p)
    for k, s in enumerate(steps):
        assert s == pytest.approx(sum(math.comb(trees, j) * p**j * (1 - p) ** (trees - j) for j in range(k + 1)), abs=1e-12)
    assert len(steps) <= trees and (len(steps) == trees or 1 - steps[-1] < 1e-12)
