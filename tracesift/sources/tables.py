"""Driver tables, and how they stand in for spans, payloads and labelled data.

Role mapping (keys are 0-based, so +1 keeps 0 free for "none"):

* root span per order: trace_id = o_orderkey + 1, span_id = trace_id * 100, parent 0,
  operation ``park-spot``, duration = floor(o_totalprice), start = o_orderdate, and a
  ``request`` tag holding a JSON payload built from the order and its customer.
* one span per line item: span_id = trace_id * 100 + l_linenumber. Lines 1-4 are the
  four server spans (children of the root), lines 5-7 the three client spans
  (children of lines 1-3). duration = l_quantity. (l_orderkey, l_linenumber) is not
  unique, so duplicate span ids occur, as in the span stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLIENT_OPERATIONS, REQUEST_TAG, ROOT_OPERATION, SPAN_COLUMNS

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Line number -> operation: 1..4 server spans, 5..7 client spans.
LINE_OPERATIONS = (
    "authentication-service",
    "verification-service",
    "Spot-Finder-service",
    "Payment-service",
) + CLIENT_OPERATIONS


NESTED = ',"Meta":{"CreditCard":5,"v":1.10,"w":[1,{"u":"}"}],"k":1,"k":2}'
NUMBERS = ',"Ratio":1e3,"Big":123456789012345678901234567890'

SMALL_INPUT_BYTES = 512 * 1024 * 1024
SPREAD_BYTES_PER_PARTITION = 256 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of a plan (file sizes for a scan); None when unavailable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001
        return None


def spread_small(df: DataFrame, limit_bytes: int = SMALL_INPUT_BYTES) -> DataFrame:
    """Spread a small input over all cores.

    A small file may hold a single row group, which Spark reads in one task, and
    everything up to the first shuffle then runs on one core. Below
    ``limit_bytes`` (estimated by the planner, no data read) the scan is
    round-robin repartitioned into about one partition per 256 KB, at most the
    default parallelism; larger inputs keep their file splits and pay no extra
    shuffle.
    """
    size = estimated_bytes(df)
    if size is None or size > limit_bytes:
        return df
    # about 256 KB of (compressed) input per partition, never more partitions than cores
    n = min(df.sparkSession.sparkContext.defaultParallelism, max(1, -(-size // SPREAD_BYTES_PER_PARTITION)))
    return df.repartition(n) if n > 1 else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_small(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def _md5_long(text: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def payload_text(k: F.Column, c: F.Column, seg: F.Column, totalprice: F.Column, priority: F.Column) -> F.Column:
    """Compact JSON request payload for order key ``k`` and customer key ``c``.

    Variants: CreditCard as a string when k % 97 = 13 (type change); capitalised
    Username/Password keys when k % 3 = 0; no password when k % 50 = 7 (missing
    field); an extra unknown key when k % 41 = 0. Harder members, which edits have to leave alone: a nested
    object with a key of the schema, a repeated key, a fraction and a brace in a string (k % 29 = 3), an exponent and a
    number beyond 64 bits (k % 31 = 4).
    """
    s = lambda x: x.cast("string")
    card = s(F.lit(4000000000000000) + (k * 7919 + c) % 999999999999)
    card_json = F.when(k % 97 == 13, F.concat(F.lit('"'), card, F.lit('"'))).otherwise(card)
    position = F.concat(
        s(c % 180 - 90), F.lit("."), F.lpad(s(k % 100000), 5, "0"), F.lit(", "),
        s(k % 360 - 180), F.lit("."), F.lpad(s(c * 7 % 100000), 5, "0"),
    )
    address = F.concat(s(c % 9000 + 100), F.lit(" "), seg, F.lit(" Avenue"))
    money = F.concat(s(F.floor(totalprice).cast("long")), F.lit(","), F.lpad(s(k % 100), 2, "0"), F.lit("$"))
    cap = k % 3 == 0
    user_key = F.when(cap, F.lit("Username")).otherwise(F.lit("username"))
    pass_key = F.when(cap, F.lit("Password")).otherwise(F.lit("password"))
    password = F.substring(F.md5(s(k)), 1, 16)
    pw_part = F.when(k % 50 == 7, F.lit("")).otherwise(
        F.concat(F.lit(',"'), pass_key, F.lit('":"'), password, F.lit('"'))
    )
    extra = F.when(k % 41 == 0, F.concat(F.lit(',"Priority":"'), priority, F.lit('"'))).otherwise(F.lit(""))
    return F.concat(
        F.lit('{"CreditCard":'), card_json,
        F.lit(',"Position":"'), position,
        F.lit('","Address":"'), address,
        F.lit('","Money":"'), money,
        F.lit('","'), user_key, F.lit('":"user'), s(c), F.lit('"'),
        pw_part, extra, F.when(k % 29 == 3, F.lit(NESTED)).otherwise(F.lit("")), F.when(k % 31 == 4, F.lit(NUMBERS)).otherwise(F.lit("")), F.lit("}"),
    )


def root_spans_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # customer is a dimension (one row per key): Spark picks broadcast or sort-merge by size.
    oc = o.join(c, o.o_custkey == c.c_custkey, "left")
    k = F.col("o_orderkey")
    payload = payload_text(k, F.col("o_custkey"), F.coalesce("c_mktsegment", F.lit("")), F.col("o_totalprice"), F.col("o_orderpriority"))
    req = F.struct(F.lit(REQUEST_TAG).alias("key"), F.lit("string").alias("type"), payload.alias("value"))
    prio = F.struct(F.lit("priority").alias("key"), F.lit("string").alias("type"), F.col("o_orderpriority").alias("value"))
    tags = (
        F.when(k % 23 == 5, F.array(prio))  # no request tag
        .when(k % 199 == 0, F.array(req, prio, req))  # two request tags
        .otherwise(F.array(req, prio))
    )
    trace = k + 1
    return oc.select(
        trace.alias("trace_id"),
        (trace * 100).alias("span_id"),
        F.lit(0).cast("long").alias("parent_span_id"),
        F.lit(ROOT_OPERATION).alias("operation_name"),
        F.lit("Root-Service").alias("service_name"),
        F.array(F.struct(F.lit("host").alias("key"), F.lit("h-root").alias("value"))).alias("process_tags"),
        F.col("o_orderdate").alias("start_time"),
        F.floor("o_totalprice").cast("long").alias("duration"),
        tags.alias("tags"),
        _md5_long(k.cast("string")).alias("arrival_seq"),
    )


def service_spans_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    trace = F.col("l_orderkey") + 1
    line = F.col("l_linenumber")
    ops = F.array(*[F.lit(o) for o in LINE_OPERATIONS])
    parent = F.when(line > 4, trace * 100 + line - 4).otherwise(trace * 100)
    service = F.when(F.col("l_partkey") % 53 == 0, F.lit("Jaeger-Query")).otherwise(
        F.concat(F.lit("svc-"), (F.col("l_suppkey") % 4).cast("string"))
    )
    key = F.concat_ws("|", *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return li.select(
        trace.alias("trace_id"),
        (trace * 100 + line).alias("span_id"),
        parent.alias("parent_span_id"),
        F.element_at(ops, line).alias("operation_name"),
        service.alias("service_name"),
        F.array(
            F.struct(F.lit("host").alias("key"), F.concat(F.lit("h"), (F.col("l_suppkey") % 3).cast("string")).alias("value"))
        ).alias("process_tags"),
        F.col("l_shipdate").alias("start_time"),
        F.col("l_quantity").cast("long").alias("duration"),
        F.array().cast("array<struct<key:string,type:string,value:string>>").alias("tags"),
        _md5_long(key).alias("arrival_seq"),
    )


def spans_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans (roots and line spans) in the canonical span schema."""
    return root_spans_from_tables(spark, sf_dir).unionByName(service_spans_from_tables(spark, sf_dir)).select(*SPAN_COLUMNS)


def payloads_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per request tag of an order: (Id, request)."""
    roots = root_spans_from_tables(spark, sf_dir)
    tags = F.filter("tags", lambda t: t["key"] == REQUEST_TAG)
    return roots.select(F.col("trace_id").alias("Id"), F.explode(tags).alias("t")).select("Id", F.col("t.value").alias("request")).where("request IS NOT NULL")
