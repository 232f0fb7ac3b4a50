"""Cluster detector laws: own centroid is the nearest; training rows are never flagged; empty clusters."""

from pyspark.sql import functions as F

from tracesift.operators import cluster as cl

from .conftest import SF_SMALL


def test_nearest_and_no_training_flags(spark):
    from tracesift.sources.tables import load

    emb = load(spark, SF_SMALL, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    cents = [r["centroid"] for r in cl.label_centroids(
        load(spark, SF_SMALL, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"), "label"),
        "vec", "label", None).orderBy("cluster").collect()]
    model = cl.fit_with_centroids(emb, "vec", cents)
    out = model.transform(emb)
    assert out.filter("anomaly = 1").count() == 0  # rule is strictly greater than the training max
    # brute force: own centroid is the nearest
    import numpy as np

    C = np.array(cents)
    for r in out.select("vec", "prediction", "dist").limit(50).collect():
        d = np.sqrt(((C - np.array(r["vec"])) ** 2).sum(axis=1))
        assert int(d.argmin()) == r["prediction"]
        assert abs(d.min() - r["dist"]) < 1e-9


def test_empty_cluster_and_fewer_points(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([0.0, 0.0],), ([10.0, 10.0],)], "vec array<double>")
    model = cl.fit_with_centroids(df, "vec", [[0.0, 0.0], [10.0, 10.0], [100.0, 100.0]])
    assert model.max_dist == [0.0, 0.0, 0.0]  # empty cluster -> 0 (Q16)
    assigned = cl.assign_nearest(df, "vec", model.centroids)
    assert cl.clustering_score(assigned, 3).first()["score"] == 0.0


def test_mllib_pipelines_run(spark):
    from tracesift.sources.tables import load

    p = load(spark, SF_SMALL, "part")
    m = cl.fit_detector(p, ["p_size", "p_retailprice"], ["p_brand"], k=3, algorithm="kmeans", scale=True)
    assert m.k <= 3 and len(m.max_dist) == m.k
    out = m.transform(p)
    assert out.filter("anomaly = 1").count() == 0
