"""Isolation-forest laws and labelled quality (§5.3)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tracesift.functions.forest import depth_limit_value
from tracesift.operators.evaluate import auc_binary
from tracesift.operators.iforest import IForest, IForestModel, grow_tree


def _labelled(spark, n_in=444, n_out=239, seed=0):
    """Same shape as the reference's labelled table: 9 integer features 1..10, ~35% outliers."""
    rng = np.random.default_rng(seed)
    inl = np.clip(rng.normal(2.0, 1.0, size=(n_in, 9)).round(), 1, 10)
    out = np.clip(rng.normal(7.0, 2.0, size=(n_out, 9)).round(), 1, 10)
    X = np.vstack([inl, out]).astype(int)
    y = np.array([2] * n_in + [4] * n_out)
    pdf = pd.DataFrame(X, columns=[f"_c{i}" for i in range(1, 10)])
    pdf.insert(0, "_c0", np.arange(len(y)))
    pdf["_c10"] = y
    df = spark.createDataFrame(pdf)
    return VectorAssembler(inputCols=[f"_c{i}" for i in range(1, 10)], outputCol="features").transform(df)


@pytest.fixture(scope="module")
def data(spark):
    return _labelled(spark).cache()


@pytest.fixture(scope="module")
def model(data):
    return IForest(numTrees=30, maxSamples=64, contamination=0.35, maxDepth=100, seed=123456).fit(data)


def test_node_table_laws(model):
    nodes = model.nodes
    psi = model.num_samples
    limit = depth_limit_value(psi, 100)
    for t, g in nodes.groupby("tree_id"):
        g = g.sort_values("id")
        assert list(g["id"]) == list(range(len(g)))  # pre-order ids 0..n-1
        leaves = g[g["feature_index"] < 0]
        assert leaves["num_instance"].sum() == psi  # every sampled row ends in one leaf
        internal = g[g["feature_index"] >= 0]
        assert (internal["num_instance"] == 0).all()
        # depth of every node <= limit
        depth = {0: 0}
        for r in g.itertuples():
            if r.feature_index >= 0:
                depth[r.left_child] = depth[r.id] + 1
                depth[r.right_child] = depth[r.id] + 1
        assert max(depth.values()) <= limit


def test_splits_inside_range():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(50, 3))
    rows = grow_tree(X, 0, 7, 8, 1.0)
    by_id = {r[1]: r for r in rows}
    # walk: each split value lies in [min, max) of its node's rows
    stack = [(0, np.arange(50))]
    while stack:
        nid, idx = stack.pop()
        _, _, f, v, left, right, n = by_id[nid]
        if f < 0:
            assert n == len(idx)
            continue
        col = X[idx, f]
        assert col.min() <= v < col.max() or v == col.min()
        stack.append((left, idx[col < v]))
        stack.append((right, idx[col >= v]))


def test_same_seed_same_forest_across_partitionings(spark, data):
    a = IForest(numTrees=10, maxSamples=32, seed=9, idCol="_c0").fit(data.repartition(3))
    b = IForest(numTrees=10, maxSamples=32, seed=9, idCol="_c0").fit(data.repartition(7))
    pd.testing.assert_frame_equal(a.nodes.reset_index(drop=True), b.nodes.reset_index(drop=True))


def test_scores_and_threshold(model, data):
    pred = model.transform(data)
    s = pred.agg(F.min("anomalyScore").alias("lo"), F.max("anomalyScore").alias("hi"),
                 F.avg("prediction").alias("share")).first()
    assert 0.0 < s["lo"] <= s["hi"] <= 1.0
    assert s["share"] <= 0.35 + 1e-9  # strict > at an exact quantile never exceeds the contamination


def test_labelled_quality(model, data):
    pred = model.transform(data).withColumn("label", (F.col("_c10") == 4).cast("int"))
    auc = auc_binary(pred, "prediction", "label").first()["auc"]
    assert auc > 0.85, auc


def test_save_load_roundtrip(spark, model, data, tmp_path):
    path = str(tmp_path / "forest")
    model.write().overwrite().save(path)
    loaded = IForestModel.load(path)
    assert loaded.threshold == model.threshold and loaded.num_samples == model.num_samples
    pd.testing.assert_frame_equal(loaded.nodes.reset_index(drop=True), model.nodes.reset_index(drop=True),
                                  check_dtype=False)
    a = model.transform(data).select("_c0", "anomalyScore").orderBy("_c0").collect()
    b = loaded.transform(data).select("_c0", "anomalyScore").orderBy("_c0").collect()
    assert a == b


def test_max_samples_rules(spark, data):
    with pytest.raises(ValueError):  # Q15: an explicit count above n is an error
        IForest(numTrees=2, maxSamples=10_000).fit(data)
    est = IForest(numTrees=2)  # Q28: default 256 capped at n
    assert est._num_samples(100) == 100
    assert IForest(maxSamples=0.5)._num_samples(322) == 161  # Q13: no lost row
    assert IForest(maxSamples=1.0)._num_samples(322) == 322


def test_bootstrap_half_open(spark):
    from tracesift.operators.iforest import tree_samples

    s = tree_samples(spark, 5, 10, 50, 3, True).toPandas()
    assert s["row_idx"].between(0, 9).all()  # Q14: index n never drawn
    s2 = tree_samples(spark, 5, 100, 50, 3, False).toPandas()
    assert (s2.groupby("tree_id")["row_idx"].nunique() == 50).all()


def test_sparse_vectors(spark):
    from pyspark.ml.linalg import SparseVector, Vectors

    rows = [(Vectors.sparse(3, [0], [float(i)]),) if i % 2 else (Vectors.dense([0.0, float(i), 1.0]),) for i in range(40)]
    df = spark.createDataFrame(rows, ["features"])
    assert isinstance(rows[1][0], SparseVector)
    m = IForest(numTrees=5, maxSamples=16, seed=1).fit(df)  # Q11: no crash on sparse input
    assert m.transform(df).count() == 40


def test_c_of_n():
    from tracesift.functions.forest import avg_path_length_value

    assert avg_path_length_value(2) == 1.0 and avg_path_length_value(1) == 0.0
    assert math.isclose(avg_path_length_value(256), 2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_schema_checks(spark, model, data):
    """Features must be a vector/array; output columns must not exist yet."""
    bad = spark.createDataFrame([("x",)], "features string")
    with pytest.raises(TypeError):
        IForest(numTrees=2).fit(bad)
    with pytest.raises(ValueError):
        model.transform(model.transform(data))  # prediction/score columns already present


def test_threshold_survives_copy(model):
    """Q10: the threshold is set in fit and kept by copy."""
    assert model.getThreshold() is not None
    assert model.copy().threshold == model.threshold


def test_short_draws_are_redrawn(spark, data):
    """Trees whose Bernoulli draw came up short are drawn again, so every tree gets exactly psi rows."""

    class Starved(IForest):
        def _thin(self, data, n, psi, trees, factor):
            return super()._thin(data, n, psi, trees, factor * 0.05)

    m = Starved(numTrees=12, maxSamples=64, seed=3).fit(data)
    assert m.num_trees == 12
    for _, g in m.nodes.groupby("tree_id"):
        assert g.loc[g["feature_index"] < 0, "num_instance"].sum() == 64


def test_bootstrap_fit(spark, data):
    m = IForest(numTrees=8, maxSamples=64, seed=3, bootstrap=True).fit(data)
    for _, g in m.nodes.groupby("tree_id"):
        assert g.loc[g["feature_index"] < 0, "num_instance"].sum() == 64


def test_a_walk_holds_a_block_of_rows_whatever_the_batch():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from tracesift.operators.iforest import NODE_SCHEMA, _Forest, grow_tree

    rng = np.random.default_rng(5)
    nodes = pd.DataFrame([r for t in range(60) for r in grow_tree(rng.random((128, 4)), t, 3, 7, 1.0)], columns=NODE_SCHEMA.names)
    forest, X = _Forest(nodes), rng.random((8000, 4))
    tracemalloc.start()
    means = forest.mean_path_lengths(X)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # one array of rows x trees has 3.8 MB, a walk has about ten
    assert (means == forest._walk(X).mean(axis=1)).all() and (forest.path_lengths(X) == forest._walk(X)).all()


def test_walks_agree_with_steps_node_by_node():
    from tracesift.operators.iforest import NODE_SCHEMA, _Forest, avg_path_length_value, grow_tree

    rng = np.random.default_rng(5)
    grown = [r for t in range(4) for r in grow_tree(rng.random((40, 3)), t, 2, 4, 1.0)]
    grown += grow_tree(np.zeros((5, 3)), 4, 2, 4, 1.0)  # a tree of one leaf
    nodes = pd.DataFrame(grown, columns=NODE_SCHEMA.names)
    X = np.vstack([rng.random((60, 3)), [[np.nan, 0.5, 0.5], [0.5, np.nan, np.nan]]])
    got = _Forest(nodes).path_lengths(X)
    for t, tree in nodes.groupby("tree_id"):
        by = {r.id: r for r in tree.itertuples()}
        for i, x in enumerate(X):
            r, steps = by[0], 0
            while r.feature_index >= 0:
                r, steps = by[r.left_child if x[r.feature_index] < r.feature_value else r.right_child], steps + 1
            assert abs(got[i, t] - steps - avg_path_length_value(r.num_instance)) < 1e-12


def test_a_walk_takes_a_step_a_level():
    from tracesift.operators.iforest import NODE_SCHEMA, _Forest, grow_tree

    rng = np.random.default_rng(6)
    nodes = pd.DataFrame([r for t in range(40) for r in grow_tree(rng.random((256, 19)), t, 3, 8, 1.0)], columns=NODE_SCHEMA.names)
    forest = _Forest(nodes)
    assert forest.levels <= 8 and (forest.column >= 0).all()  # no check of live places a step
