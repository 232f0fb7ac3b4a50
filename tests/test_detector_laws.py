"""The laws of the clustering detectors hold for a fitted one and tell when it was tampered with."""

import numpy as np

from tracesift.operators import cluster as cl
from tracesift.plans import catalog

LAWS = ["within_limits", "nearest", "limits_are_maxima", "centred", "score_recomputed", "reloads"]


def test_laws_notice_a_wrong_model(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.5, (40, 2)) for c in ((0, 0), (9, 0), (0, 9))])
    train = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    train = train.unionByName(spark.createDataFrame([(None, 1.0)], train.schema))
    model = cl.fit_detector(train, ["x", "y"], k=3, max_iter=100)
    assert catalog._detector_laws(spark, train, model) == (121, 3, True, True, True, True, True, True)

    limits = list(model.max_dist)
    model.max_dist[0] /= 2
    n, k, *held = catalog._detector_laws(spark, train, model)
    assert dict(zip(LAWS, held)) == dict.fromkeys(LAWS, True) | {"within_limits": False, "limits_are_maxima": False}

    model.max_dist, model.centroids[1] = limits, [model.centroids[1][0] + 1.0, model.centroids[1][1]]
    n, k, *held = catalog._detector_laws(spark, train, model)
    wrong = dict(zip(LAWS, held))
    assert wrong["nearest"] and wrong["reloads"]
    assert not wrong["centred"] and not wrong["limits_are_maxima"] and not wrong["score_recomputed"]
