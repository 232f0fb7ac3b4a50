"""Payload and trace features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json import payload_feature_columns, with_json_parts
from ..schema import DURATION_FEATURES, FEATURE_COLUMNS, PAYLOAD_KEYS, REQUEST_TAG, SERVICE_OPERATIONS
from .spans import is_root, request_tags, trace_durations


def payload_features(
    df: DataFrame, json_col: str = "request", keys: Sequence[str] = PAYLOAD_KEYS, case_insensitive: bool = False,
    keep: Sequence[str] = ("Id",),
) -> DataFrame:
    """H5: feature columns of a JSON payload column, next to the ``keep`` columns."""
    keep = [c for c in keep if c in df.columns]
    lower = "_jl" if case_insensitive else None
    parts = with_json_parts(df, json_col, lower_col=lower)
    return parts.select(*keep, *payload_feature_columns(json_col, keys, case_insensitive, "_jk", "_jc", lower))


def trace_features(
    spans: DataFrame,
    keys: Sequence[str] = PAYLOAD_KEYS,
    operations: Sequence[str] = SERVICE_OPERATIONS,
    missing: str = "zero",
    match: str = "suffix",
    case_insensitive: bool = False,
) -> DataFrame:
    """H6: one feature row per ``request`` tag of a root span.

    Id = trace id; payload features (H5); TraceD = root duration; SpanD1..n = the
    service-span durations in ``operations`` order. A trace lacking a service span
    gets NULL (``missing="null"``), 0 (``"zero"``) or is dropped (``"drop"``).

    Plan: roots -> explode request tags; service spans -> one hash aggregate per
    trace (conditional max = fixed-value pivot); left join on trace_id. The
    aggregate output is already partitioned by trace_id, so the join re-shuffles
    only the root side; AQE splits a skewed trace.
    """
    roots = request_tags(spans.filter(is_root()), REQUEST_TAG)
    durs = trace_durations(spans, operations, match)
    span_cols = [f"SpanD{i + 1}" for i in range(len(operations))]
    joined = roots.join(durs, "trace_id", "left")
    if missing == "zero":
        dcols = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in span_cols]
    elif missing in ("null", "drop"):
        dcols = [F.col(c).cast("long").alias(c) for c in span_cols]
    else:
        raise ValueError(f"unknown missing mode {missing!r}")
    out = with_json_parts(joined, REQUEST_TAG).select(
        F.col("trace_id").alias("Id"),
        *payload_feature_columns(REQUEST_TAG, keys, case_insensitive, "_jk", "_jc"),
        F.col("duration").cast("long").alias("TraceD"),
        *dcols,
    )
    if missing == "drop":
        out = out.dropna(subset=span_cols)
    return out


def feature_range(df: DataFrame, cols: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Min and max of every feature column in one aggregate (one row)."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*aggs)


__all__ = ["payload_features", "trace_features", "feature_range", "DURATION_FEATURES"]
