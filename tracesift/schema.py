"""Schemas and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference's for results to match.
# ---------------------------------------------------------------------------
# Payload keys probed for features, in feature order (case-sensitive by default).
PAYLOAD_KEYS = ("CreditCard", "Position", "Address", "Money", "username", "password")
# Server-span operations, in the order the training rows use (binary sort order).
SERVICE_OPERATIONS = (
    "Payment-service",
    "Spot-Finder-service",
    "authentication-service",
    "verification-service",
)
# Client-span operations emitted by the root service.
CLIENT_OPERATIONS = ("authentication", "verification", "spotFinder")
ROOT_OPERATION = "park-spot"
REQUEST_TAG = "request"
EXCLUDED_SERVICE = "jaeger-query"
SPANS_PER_TRACE = 8
FLUSH_TRACES = 5000
EULER_GAMMA = 0.5772156649
INJECTION_RATE = 1.0 / 900.0
SQL_INJECTIONS = (
    " ‘ and 1=1--",
    "‘ and 1=2-- ",
    " UNION SELECT 1,@@version-- ",
    " UNION SELECT 1,name FROM master..sysdatabases-- ",
)

# Canonical feature row: E = key exists (0/1), L = length of the value text. Fixed names.
PAYLOAD_FEATURES = [
    "JTotalL", "JTotalC",
    "CreditCardE", "CreditCardL",
    "PositionE", "Position1L",
    "AddressE", "AddressL",
    "MoneyE", "MoneyL",
    "usernameE", "usernameL",
    "passwordE", "passwordL",
]
DURATION_FEATURES = ["TraceD", "SpanD1", "SpanD2", "SpanD3", "SpanD4"]
# ---------------------------------------------------------------------------
FEATURE_COLUMNS = PAYLOAD_FEATURES + DURATION_FEATURES
FEATURE_SCHEMA = T.StructType(
    [T.StructField("Id", T.LongType(), False)]
    + [T.StructField(c, T.LongType(), True) for c in FEATURE_COLUMNS]
)

KV = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
TAG = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

SPAN_SCHEMA = T.StructType(
    [
        T.StructField("trace_id", T.LongType(), False),
        T.StructField("span_id", T.LongType(), False),
        T.StructField("parent_span_id", T.LongType(), False),
        T.StructField("operation_name", T.StringType(), False),
        T.StructField("service_name", T.StringType(), False),
        T.StructField("process_tags", T.ArrayType(KV), True),
        T.StructField("start_time", T.TimestampNTZType(), True),
        T.StructField("duration", T.LongType(), True),
        T.StructField("tags", T.ArrayType(TAG), True),
        T.StructField("arrival_seq", T.LongType(), False),
    ]
)
SPAN_COLUMNS = [f.name for f in SPAN_SCHEMA.fields]

# Span batch as delivered by an agent: one process, many spans.
SPAN_BATCH_SCHEMA = T.StructType(
    [
        T.StructField("service_name", T.StringType()),
        T.StructField("process_tags", T.ArrayType(KV)),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType([f for f in SPAN_SCHEMA.fields if f.name not in ("service_name", "process_tags")])
            ),
        ),
    ]
)

# Flat isolation-tree node table (one row per node, ids in pre-order from 0).
NODE_SCHEMA = T.StructType(
    [
        T.StructField("tree_id", T.IntegerType(), False),
        T.StructField("id", T.IntegerType(), False),
        T.StructField("feature_index", T.IntegerType(), False),
        T.StructField("feature_value", T.DoubleType(), False),
        T.StructField("left_child", T.IntegerType(), False),
        T.StructField("right_child", T.IntegerType(), False),
        T.StructField("num_instance", T.LongType(), False),
    ]
)
