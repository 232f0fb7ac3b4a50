"""Line dedup by distinct-site spread. JVM only.

Each line's hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by aggregation,
so a line of any frequency costs one sketch per task. Lines whose estimate is near the threshold
(within ``MARGIN`` relative errors) get an exact distinct count. Lines on ``min_sites`` sites or more
are cross-site boilerplate and are removed from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import store, text_or_empty

LG_K = 10  # 2**LG_K registers
MARGIN = 4 * 1.04 / 2 ** (LG_K / 2)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of the trimmed line, as two independently seeded hashes."""
    trimmed = F.trim(line, F.lit(" \t\r\x0b\x0c"))
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(1), trimmed).alias("b"))


def _filled(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c")) != ""


def boilerplate_lines(rows: DataFrame, min_sites: int) -> DataFrame:
    """From rows (key, site) the keys on ``min_sites`` distinct sites or more; null sites are no sites."""
    spread = rows.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select("key", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = store(spread.filter(F.col("sites") >= min_sites * (1 - MARGIN)), "line-spread")
    clear = spread.filter(F.col("sites") > min_sites * (1 + MARGIN)).select("key")
    near = spread.filter(F.col("sites") <= min_sites * (1 + MARGIN)).select("key")
    exact = rows.join(near, "key", "left_semi").groupBy("key").agg(F.countDistinct("site").alias("n")).filter(F.col("n") >= min_sites).select("key")
    return store(clear.unionByName(exact), "boilerplate")


def drop_boilerplate_lines(docs: DataFrame, min_sites: int, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, text (without boilerplate lines), n_lines, n_removed.

    Lines end at a line feed; they are equal when equal without the white space around them, and blank
    lines are never removed. Null text counts as one blank line. A null site spreads nothing. Repeated
    rows get the same result; null ids stay null; other columns are ignored. Very long texts are read whole; an
    empty table gives an empty result.
    """
    narrow = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs, text_col).alias("t"), docs[site_col].cast("string").alias("site"))
    doc = F.struct(F.xxhash64("doc_id", "t").alias("a"), F.xxhash64(F.lit(1), "doc_id", "t").alias("b"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("t")), _filled), _key))
    rows = store(narrow.select(doc.alias("doc"), "site", F.explode(keys).alias("key")), "lines")
    boiler = boilerplate_lines(rows.select("key", "site"), min_sites)
    bad = rows.join(boiler, "key", "left_semi").groupBy("doc").agg(F.collect_set("key").alias("bad"))  # of one document's own lines
    lines = _lines(F.col("t"))
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~_filled(x) | ~F.array_contains(F.col("bad"), _key(x))))
    out = narrow.withColumn("doc", doc).join(bad, "doc", "left").select("doc_id", lines.alias("l"), kept.alias("k"))
    return out.select("doc_id", F.array_join("k", "\n").alias("text"), F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size("k")).cast("long").alias("n_removed"))
