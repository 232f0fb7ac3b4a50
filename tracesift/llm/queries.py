"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroid_clustering,
    decontaminate,
    exact_dedup,
    html_extraction,
    importance_resampling,
    language_id,
    line_dedup,
    pii,
    sentencepiece_codec,
    simhash,
    suffix_dedup,
    token_output,
    url_filter,
)
from .support import table

MIN_SITES = 8
BUCKETS = 10_000
CENTROIDS, ROUNDS, DIMS = 8, 10, 64


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2, seed=42)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate_lines(table(spark, sf_dir, "documents"), min_sites=MIN_SITES)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_file_report(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_report(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_language_id(docs.filter(~language_id.held_out()))
    found = language_id.predict_language(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, max_n=1, buckets=BUCKETS, min_words=20, seed=2024)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labeller = html_extraction.fit_on_pages(html_extraction.sample_pages(pages))
    return html_extraction.extract_main_text(pages, labeller).select("page_id", "url", "text", "n_chars")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.clustering_report(table(spark, sf_dir, "embeddings"), k=CENTROIDS, rounds=ROUNDS, dims=DIMS, seed=3)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash_neardup": op3_simhash_neardup,
    "op4_url_filter": op4_url_filter,
    "op5_line_dedup": op5_line_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_output": op7_token_output,
    "op8_pii": op8_pii,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_html_extraction": op12_html_extraction,
    "op13_centroid_clustering": op13_centroid_clustering,
}

_URL_SQL = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
rest AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT rid, page_id,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
best AS (
  SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (rid)
"""

_EXACT_SQL = """
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM h JOIN g USING (text_sha256)
"""

_LINE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT rid, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM lines),
boiler AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT keyed.*, boiler.k IS NOT NULL AS gone FROM keyed LEFT JOIN boiler USING (k)),
kept AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t
  FROM marked GROUP BY rid)
SELECT doc_id, n_lines, n_removed, sha256(t) AS kept_sha256 FROM docs JOIN kept USING (rid)
"""

# The CRC table follows from its polynomial; a word's bytes are folded over it.
_RESAMPLE_SQL = rf"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
docs AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
goals AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
doc_words AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM docs),
goal_words AS (SELECT unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM goals),
words AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM doc_words UNION ALL SELECT w FROM goal_words)),
coded AS (
  SELECT w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                lambda c, b: xor(c >> 8, steps.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
  FROM words, steps),
s AS (SELECT bucket, count(*) AS n FROM doc_words JOIN coded USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM goal_words JOIN coded USING (w) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS tt),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (ss + {BUCKETS}) / ((s.n::DOUBLE + 1) * (tt + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS g FROM doc_words JOIN coded USING (w) JOIN gains USING (bucket) GROUP BY rid),
scored AS (
  SELECT rid, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM docs LEFT JOIN weights USING (rid)),
placed AS (
  SELECT rid, row_number() OVER (ORDER BY weight + noise DESC, doc_id ASC NULLS LAST, rid) AS place, count(*) OVER () AS total FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= 10 * total // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (rid)
"""


def _cluster_sql() -> str:
    """The rounds written out one after the other."""
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    ctes = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1024) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE) AND abs(x::DOUBLE) < {centroid_clustering.LIMIT // centroid_clustering.SCALE})) = {DIMS})""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, vec_id, x) - 1 AS INTEGER) AS k, x AS c
  FROM v QUALIFY k < {CENTROIDS})""",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"""d{r} AS (SELECT rid, x, k, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r})""")
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT rid, x, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)""")
        if r < ROUNDS:
            ctes.append(f"""p{r} AS (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r})""")
            ctes.append(f"""m{r} AS (SELECT k, list({floor} ORDER BY i) AS c FROM (SELECT k, i, sum(e) AS s, count(*) AS n FROM p{r} GROUP BY k, i) GROUP BY k)""")
            ctes.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.k = c{r}.k)""")
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, a.k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.k JOIN v ON v.rid = a.rid"""
    )


SQL = {"op11_importance_resampling": _RESAMPLE_SQL, "op13_centroid_clustering": _cluster_sql(), "op5_line_dedup": _LINE_SQL, "op4_url_filter": _URL_SQL, "op6_exact_dedup": _EXACT_SQL}
