"""Vector math as built-in array expressions (H7, H12): no Python UDF, stays in codegen."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_array(col) -> Column:
    """ML vector -> array<double>."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(_c(col))


def squared_distance(x, c) -> Column:
    """Sum of squared differences of two equal-length numeric arrays."""
    diffs = F.zip_with(_c(x), _c(c), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v)


def euclidean_distance(x, c) -> Column:
    """H7: Euclidean distance of two numeric arrays."""
    return F.sqrt(squared_distance(x, c))


BLOCK_CELLS = 1 << 20  # row x centroid distances that a task holds at once
UNROLL_LIMIT = 48  # plan choice only, same terms in the same order; k * d terms written out as plain arithmetic (beyond 8,000 bytes of code the JVM interprets a method row by row)


def squared_distance_to(x: Column, c: Sequence[float]) -> Column:
    """Sum of squared differences to a given point, written out."""
    terms = [(x[i].cast("double") - F.lit(float(v))) * (x[i].cast("double") - F.lit(float(v))) for i, v in enumerate(c)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def nearest_centroid_values(x, centroids: Sequence[Sequence[float]]) -> Column:
    """Nearest of k literal centroids: struct<cluster:int, dist:double>, ties to the lower index.

    Up to ``UNROLL_LIMIT`` k*d terms the squared distances are written out as
    arithmetic on ``x[i]`` (compiled by whole-stage codegen; higher-order array
    functions would be interpreted row by row). Larger tables use a vectorised
    numpy ``pandas_udf`` over Arrow batches that sums the same squared differences in the same order,
    so both forms give the same clusters and distances.
    """
    x = _c(x)
    k, d = len(centroids), len(centroids[0]) if centroids else 0
    if k * d <= UNROLL_LIMIT:
        cands = [F.struct(squared_distance_to(x, c).alias("d2"), F.lit(j).alias("cluster")) for j, c in enumerate(centroids)]
        best = cands[0] if k == 1 else F.least(*cands)
        return F.struct(best["cluster"].cast("int").alias("cluster"), F.sqrt(best["d2"]).alias("dist"))
    return _nearest_udf(centroids)(x)


def _rows_of(v, d: int) -> np.ndarray:
    """An Arrow list column as a matrix, without an object a row."""
    flat = v.flatten()
    if v.null_count == 0 and len(flat) == len(v) * d:
        return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(v), d)
    return np.stack([np.asarray(a, dtype=np.float64) for a in v.to_pylist()])


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids; one term after the other, in the order of the written-out form."""
    out = np.zeros((len(x), len(c)))
    for i in range(c.shape[1]):
        out += (x[:, i, None] - c[None, :, i]) ** 2
    return out


def _nearest_udf(centroids: Sequence[Sequence[float]]):
    C = np.asarray(centroids, dtype=np.float64)
    out_type = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("dist", T.DoubleType())])

    @F.arrow_udf(out_type)
    def nearest(v: pa.Array) -> pa.Array:
        X = _rows_of(v, C.shape[1]) if len(v) else np.zeros((0, C.shape[1]))
        cluster, best = np.zeros(len(X), np.int32), np.zeros(len(X))
        rows = max(1, BLOCK_CELLS // len(C))
        for at in range(0, len(X), rows):
            d2 = _squares(X[at : at + rows], C)
            j = d2.argmin(axis=1)
            cluster[at : at + rows], best[at : at + rows] = j, d2[np.arange(len(d2)), j]
        return pa.StructArray.from_arrays([pa.array(cluster), pa.array(np.sqrt(best), from_pandas=False)], names=["cluster", "dist"])

    return nearest


def centroid_distances(x, centroids: Sequence[Sequence[float]]) -> Column:
    """H7: array of the distances to each of k literal centroids, vectorised over Arrow batches."""
    C = np.asarray(centroids, dtype=np.float64)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def distances(v: pa.Array) -> pa.Array:
        X = _rows_of(v, C.shape[1]) if len(v) else np.zeros((0, C.shape[1]))
        found = np.sqrt(_squares(X, C))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(X) + 1, dtype=np.int32) * len(C)), pa.array(found.ravel()))

    return distances(_c(x))


def distance_to_values(x, centroids: Sequence[Sequence[float]], cluster) -> Column:
    """Distance of ``x`` to the literal centroid with index ``cluster`` (0-based), written out per dimension."""
    x, cl = _c(x), _c(cluster)
    d = len(centroids[0])
    terms = []
    for i in range(d):
        ci = F.element_at(F.array(*[F.lit(float(c[i])) for c in centroids]), cl + 1)
        terms.append((x[i].cast("double") - ci) * (x[i].cast("double") - ci))
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.sqrt(out)


def flag_beyond(dist, max_dist) -> Column:
    """1 when the distance is strictly greater than the cluster's training maximum."""
    return F.when(_c(dist) > _c(max_dist), F.lit(1)).otherwise(F.lit(0))
