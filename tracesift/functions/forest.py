"""Isolation-forest scalar math as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EULER_GAMMA


def _c(col) -> Column:
    return F.col(col) if isinstance(col, (str,)) else col


def avg_path_length(n) -> Column:
    """H8: c(n) = 2(ln(n-1)+gamma) - 2(n-1)/n for n > 2; 1 for n = 2; else 0."""
    n = _c(n).cast("double")
    return (
        F.when(n > 2, F.lit(2.0) * (F.log(n - 1) + F.lit(EULER_GAMMA)) - F.lit(2.0) * (n - 1) / n)
        .when(n == 2, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def avg_path_length_value(n: float) -> float:
    if n > 2:
        return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n
    if n == 2:
        return 1.0
    return 0.0


def anomaly_score(mean_path, norm) -> Column:
    """2^(-mean/c(psi))."""
    return F.pow(F.lit(2.0), -_c(mean_path) / (norm if isinstance(norm, Column) else F.lit(float(norm))))


def score_to_prediction(score, threshold) -> Column:
    """1.0 when the score is strictly greater than the threshold, else 0.0."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_c(score) > thr).cast("double")


def depth_limit(n, max_depth: int) -> Column:
    """min(maxDepth, ceil(log2(max(2, n))))."""
    return F.least(F.lit(max_depth), F.ceil(F.log2(F.greatest(F.lit(2.0), _c(n).cast("double")))).cast("int"))


def depth_limit_value(n: int, max_depth: int) -> int:
    return int(min(max_depth, math.ceil(math.log2(max(2, n)))))
