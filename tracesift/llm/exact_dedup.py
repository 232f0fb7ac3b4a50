"""Exact dedup by two-pass Bloom filtering. JVM only.

Pass 1 sets k = 2 positions per text digest in a filter of m bits and keeps the positions that
were set at least twice: an aggregation of integers, reduced to at most ``MAX_BITS / 8`` bytes of
bitmaps. Pass 2 probes every row: rows with an unshared position are certainly unique and pass
straight through; only the others shuffle, and there the full digest decides.

m follows the row count (16 bits a row) up to ``MAX_BITS``. Beyond that the filter keeps its size,
more unique rows are sent on to the exact comparison, and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import store, text_or_empty

BITS_PER_ROW, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 27  # the filter that is broadcast has 16 MB at most
BUCKET_BITS = 32_768  # of Spark's bitmap functions


def _bits(rows: int) -> int:
    bits = MIN_BITS
    while bits < rows * BITS_PER_ROW and bits < MAX_BITS:
        bits *= 2
    return bits


def _positions(digest: Column, bits: int) -> list[Column]:
    return [(F.xxhash64(F.lit(i), digest).bitwiseAND(F.lit(bits - 1)) + 1) for i in (1, 2)]


def repeated_filter(digests: DataFrame, digest_col: str) -> tuple[DataFrame, int]:
    """The filter of positions set twice or more, as bitmaps by bucket, and its size in bits."""
    bits = _bits(digests.count())
    hit = digests.select(F.explode(F.array_distinct(F.array(*_positions(F.col(digest_col), bits)))).alias("at"))
    shared = hit.groupBy("at").agg(F.count("*").alias("n")).filter("n >= 2")
    maps = shared.groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__map"))
    return store(maps, "bloom"), bits


def with_candidate_flag(df: DataFrame, digest_col: str, maps: DataFrame, bits: int) -> DataFrame:
    """``df`` with ``__maybe``: both positions of the row's digest are set in the filter.

    The filter is broadcast: at most MAX_BITS / BUCKET_BITS rows of 4 kB whatever the data.
    """
    out = df
    for i, at in enumerate(_positions(F.col(digest_col), bits)):
        side = F.broadcast(maps.select(F.col("__bucket").alias(f"__b{i}"), F.col("__map").alias(f"__m{i}")))
        out = out.withColumn(f"__p{i}", at).join(side, F.bitmap_bucket_number(f"__p{i}") == F.col(f"__b{i}"), "left")
    is_set = [f"coalesce(getbit(cast(conv(hex(substring(__m{i}, cast(bitmap_bit_position(__p{i}) div 8 as int) + 1, 1)), 16, 10) as bigint), cast(bitmap_bit_position(__p{i}) % 8 as int)), 0) = 1" for i in (0, 1)]
    return out.withColumn("__maybe", F.expr(" AND ".join(is_set))).drop(*[f"__{k}{i}" for k in "pbm" for i in (0, 1)])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are equal. Of equal texts the row with the largest
    id stays. Rows that repeat an id and its text are one document and share its verdict; they count in
    group_size. A null id is smaller than any other; a group of null ids only has a null keep_id and
    stays. Texts of any length are compared whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    narrow = store(docs.select(docs[id_col].alias("doc_id"), F.unhex(F.sha2(text_or_empty(docs, text_col), 256)).alias("digest")), "digests")
    maps, bits = repeated_filter(narrow, "digest")
    flagged = with_candidate_flag(narrow, "digest", maps, bits)
    alone = flagged.filter("NOT __maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    maybe = flagged.filter("__maybe").select("doc_id", "digest")
    groups = maybe.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    shared = maybe.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    return alone.unionByName(shared).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Of rows that repeat an id and its text, any one stays. Texts of rows that the filter shows to be unique never shuffle.
    """
    digest = F.unhex(F.sha2(text_or_empty(docs, text_col), 256))
    narrow = store(docs.select(docs[id_col].alias("doc_id"), digest.alias("digest")), "digests")
    maps, bits = repeated_filter(narrow, "digest")
    maybe = with_candidate_flag(narrow, "digest", maps, bits).filter("__maybe")
    keepers = maybe.groupBy("digest").agg(F.max("doc_id").alias("__keep_id")).withColumnRenamed("digest", "__digest")
    flagged = with_candidate_flag(docs.withColumn("__digest", digest), "__digest", maps, bits)
    shared = flagged.filter("__maybe").join(keepers, "__digest").filter(F.col(id_col).eqNullSafe(F.col("__keep_id"))).dropDuplicates([id_col, "__digest"])
    return flagged.filter("NOT __maybe").select(docs.columns).unionByName(shared.select(docs.columns))
