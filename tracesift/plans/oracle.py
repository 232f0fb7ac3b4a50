"""DuckDB SQL twins of the registered queries (the correctness oracle).

The CTEs below rebuild the span role mapping of ``sources.tables`` in DuckDB's
dialect, byte for byte (integer arithmetic only, so both engines format the
same text).
"""

from __future__ import annotations

from ..schema import PAYLOAD_KEYS, SERVICE_OPERATIONS

LINE_OPS_SQL = (
    "['authentication-service','verification-service','Spot-Finder-service','Payment-service',"
    "'authentication','verification','spotFinder']"
)

SPANS_CTE = f"""
oc AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, coalesce(cu.c_mktsegment, '') AS seg,
         o.o_totalprice AS tp, o.o_orderpriority AS prio, o.o_orderdate AS od
  FROM orders o LEFT JOIN customer cu ON o.o_custkey = cu.c_custkey
),
pl AS (
  SELECT *,
    '{{"CreditCard":' || CASE WHEN k % 97 = 13 THEN '"' || card || '"' ELSE card END
    || ',"Position":"' || CAST(c % 180 - 90 AS VARCHAR) || '.' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0')
    || ', ' || CAST(k % 360 - 180 AS VARCHAR) || '.' || lpad(CAST(c * 7 % 100000 AS VARCHAR), 5, '0')
    || '","Address":"' || CAST(c % 9000 + 100 AS VARCHAR) || ' ' || seg || ' Avenue'
    || '","Money":"' || CAST(CAST(floor(tp) AS BIGINT) AS VARCHAR) || ',' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '$'
    || '","' || CASE WHEN k % 3 = 0 THEN 'Username' ELSE 'username' END || '":"user' || CAST(c AS VARCHAR) || '"'
    || CASE WHEN k % 50 = 7 THEN '' ELSE ',"' || CASE WHEN k % 3 = 0 THEN 'Password' ELSE 'password' END
         || '":"' || substr(md5(CAST(k AS VARCHAR)), 1, 16) || '"' END
    || CASE WHEN k % 41 = 0 THEN ',"Priority":"' || prio || '"' ELSE '' END
    || CASE WHEN k % 29 = 3 THEN ',"Meta":{{"CreditCard":5,"v":1.10,"w":[1,{{"u":"}}"}}],"k":1,"k":2}}' ELSE '' END
    || CASE WHEN k % 31 = 4 THEN ',"Ratio":1e3,"Big":123456789012345678901234567890' ELSE '' END
    || '}}' AS payload
  FROM (SELECT *, CAST(4000000000000000 + (k * 7919 + c) % 999999999999 AS VARCHAR) AS card FROM oc)
),
roots AS (
  SELECT k + 1 AS trace_id, (k + 1) * 100 AS span_id, CAST(0 AS BIGINT) AS parent_span_id,
    'park-spot' AS operation_name, 'Root-Service' AS service_name, 'h-root' AS host,
    od AS start_time, CAST(floor(tp) AS BIGINT) AS duration,
    CASE WHEN k % 23 = 5 THEN [{{'key': 'priority', 'type': 'string', 'value': prio}}]
         WHEN k % 199 = 0 THEN [{{'key': 'request', 'type': 'string', 'value': payload}},
                                 {{'key': 'priority', 'type': 'string', 'value': prio}},
                                 {{'key': 'request', 'type': 'string', 'value': payload}}]
         ELSE [{{'key': 'request', 'type': 'string', 'value': payload}},
               {{'key': 'priority', 'type': 'string', 'value': prio}}] END AS tags,
    ('0x' || substr(md5(CAST(k AS VARCHAR)), 1, 15))::BIGINT AS arrival_seq
  FROM pl
),
lines AS (
  SELECT l_orderkey + 1 AS trace_id, (l_orderkey + 1) * 100 + l_linenumber AS span_id,
    CASE WHEN l_linenumber > 4 THEN (l_orderkey + 1) * 100 + l_linenumber - 4 ELSE (l_orderkey + 1) * 100 END AS parent_span_id,
    {LINE_OPS_SQL}[l_linenumber] AS operation_name,
    CASE WHEN l_partkey % 53 = 0 THEN 'Jaeger-Query' ELSE 'svc-' || CAST(l_suppkey % 4 AS VARCHAR) END AS service_name,
    'h' || CAST(l_suppkey % 3 AS VARCHAR) AS host,
    l_shipdate AS start_time, CAST(trunc(l_quantity) AS BIGINT) AS duration,
    CAST([] AS STRUCT(key VARCHAR, type VARCHAR, value VARCHAR)[]) AS tags,
    ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15))::BIGINT AS arrival_seq
  FROM lineitem
),
spans AS MATERIALIZED (SELECT * FROM roots UNION ALL SELECT * FROM lines)
"""

REQ_CTE = """
req AS (
  SELECT trace_id, span_id, duration, t.value AS request
  FROM (SELECT trace_id, span_id, duration, unnest(list_filter(tags, lambda x: x.key = 'request')) AS t
        FROM spans WHERE parent_span_id = 0)
)
"""


def durs_cte(operations=SERVICE_OPERATIONS, name="durs") -> str:
    ops = ", ".join(f"'{o}'" for o in operations)
    aggs = ",\n    ".join(
        f"max(CASE WHEN operation_name = '{o}' THEN duration END) AS SpanD{i + 1}" for i, o in enumerate(operations)
    )
    return f"""
{name} AS (
  SELECT trace_id,
    {aggs}
  FROM spans
  WHERE regexp_full_match(operation_name, '.*service') AND operation_name IN ({ops})
  GROUP BY trace_id
)
"""


def json_ok(col: str) -> str:
    return f"(json_valid({col}) AND json_type({col}) = 'OBJECT')"


def payload_features_sql(col: str = "request", keys=PAYLOAD_KEYS) -> str:
    ok = json_ok(col)
    parts = [
        f"CASE WHEN {ok} THEN length(json({col})::VARCHAR) END AS JTotalL",
        f"CASE WHEN {ok} THEN CAST(len(json_keys({col})) AS BIGINT) END AS JTotalC",
    ]
    for k in keys:
        lname = "Position1L" if k == "Position" else f"{k}L"
        has = f"list_contains(json_keys({col}), '{k}')"
        parts.append(f"CASE WHEN {ok} THEN CAST({has} AS BIGINT) END AS {k}E")
        parts.append(
            f"CASE WHEN {ok} THEN CASE WHEN {has} THEN coalesce(length(json_extract_string({col}, '$.\"{k}\"')), 4) "
            f"ELSE 0 END END AS {lname}"
        )
    return ",\n  ".join(parts)


def trace_features_sql(missing: str = "zero") -> str:
    spans = [f"SpanD{i + 1}" for i in range(len(SERVICE_OPERATIONS))]
    if missing == "zero":
        dcols = ", ".join(f"CAST(coalesce(d.{s}, 0) AS BIGINT) AS {s}" for s in spans)
    else:
        dcols = ", ".join(f"d.{s} AS {s}" for s in spans)
    where = ""
    if missing == "drop":
        where = "WHERE " + " AND ".join(f"d.{s} IS NOT NULL" for s in spans)
    return f"""
tf AS (
  SELECT r.trace_id AS Id,
  {payload_features_sql('r.request')},
  r.duration AS TraceD, {dcols}
  FROM req r LEFT JOIN durs d ON r.trace_id = d.trace_id
  {where}
)
"""


def with_spans(*ctes: str, body: str) -> str:
    parts = [SPANS_CTE] + list(ctes)
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body

DEDUP_CTE = """
dd AS MATERIALIZED (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY trace_id, span_id
      ORDER BY arrival_seq DESC, start_time DESC, duration DESC, operation_name DESC,
               service_name DESC, parent_span_id DESC) AS rn
    FROM spans) WHERE rn = 1
)
"""

CONFORM_CTE = f"""
conf AS (
  SELECT trace_id, span_id, request,
    CASE WHEN {json_ok('request')}
         THEN len(list_intersect(json_keys(request), ['CreditCard','Position','Address','Money','username','password'])) != 6
         ELSE true END AS nonconforming
  FROM req
)
"""

PAY_CTE = """
pay AS (
  SELECT trace_id AS Id, t.value AS request
  FROM (SELECT trace_id, unnest(list_filter(tags, lambda x: x.key = 'request')) AS t FROM roots)
)
"""


def payload_features_ci_sql(col: str = "request", keys=PAYLOAD_KEYS) -> str:
    ok = json_ok(col)
    parts = [
        f"CASE WHEN {ok} THEN length(json({col})::VARCHAR) END AS JTotalL",
        f"CASE WHEN {ok} THEN CAST(len(json_keys({col})) AS BIGINT) END AS JTotalC",
    ]
    for k in keys:
        lname = "Position1L" if k == "Position" else f"{k}L"
        actual = f"list_filter(json_keys({col}), lambda x: lower(x) = lower('{k}'))"
        has = f"(len({actual}) > 0)"
        parts.append(f"CASE WHEN {ok} THEN CAST({has} AS BIGINT) END AS {k}E")
        parts.append(
            f"CASE WHEN {ok} THEN CASE WHEN {has} THEN coalesce(length(json_extract_string({col}, '$.\"' || {actual}[1] || '\"')), 4) "
            f"ELSE 0 END END AS {lname}"
        )
    return ",\n  ".join(parts)

# Embeddings with per-label centroids (rounded means) and distances to every centroid.
EMB_CTE = """
ev AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
split AS (
  SELECT vec_id, (('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|split'), 1, 15))::BIGINT / 1152921504606846976.0) < 0.8 AS is_train
  FROM embeddings
),
cent AS (
  SELECT CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster, label, c FROM (
    SELECT label, list(round(m, 2) ORDER BY pos) AS c FROM (
      SELECT label, pos, avg(v) AS m FROM (
        SELECT label, unnest(e) AS v, unnest(range(1, len(e) + 1)) AS pos FROM ev JOIN split USING (vec_id) WHERE is_train) GROUP BY label, pos)
    GROUP BY label)
),
dist AS (
  SELECT ev.vec_id, ev.label, cent.cluster,
    sqrt(list_sum(list_transform(range(1, len(ev.e) + 1), lambda i: (ev.e[i] - cent.c[i]) * (ev.e[i] - cent.c[i])))) AS d
  FROM ev, cent
),
near AS (SELECT vec_id, arg_min(cluster, d) AS prediction, min(d) AS d FROM dist GROUP BY vec_id),
mx AS (
  SELECT c.cluster, coalesce(max(n.d), 0.0) AS max_dist
  FROM cent c LEFT JOIN (SELECT n.* FROM near n JOIN split s USING (vec_id) WHERE s.is_train) n ON n.prediction = c.cluster
  GROUP BY c.cluster
),
test AS (
  SELECT n.vec_id, n.prediction, n.d, m.max_dist, CASE WHEN n.d > m.max_dist THEN 1 ELSE 0 END AS anomaly
  FROM near n JOIN split s USING (vec_id) JOIN mx m ON m.cluster = n.prediction WHERE NOT s.is_train
)
"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
