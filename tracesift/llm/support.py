"""Shared helpers of the training-data operators: tables, stored intermediates, Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor rereads files that every machine sees, and nothing
    upstream (Python passes over texts above all) is computed a second time.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(df: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets, bytes) of a null-free Arrow string column, without copying the texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def row_slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes add up to about ``limit``; a larger row stands alone."""
    start, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def word_numbers(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words between single spaces, the number of each word in order, and the words of each text."""
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())


def spelled(codes: list[bytes], which: np.ndarray, kind: str = "<i4") -> tuple[np.ndarray, np.ndarray]:
    """The codes that ``which`` numbers, one after the other, and the length of each."""
    size = np.fromiter(map(len, codes), np.int64, len(codes)) // np.dtype(kind).itemsize
    sizes = size[which]
    ends = np.cumsum(sizes)
    at = np.repeat((np.cumsum(size) - size)[which] - (ends - sizes), sizes)
    at += np.arange(len(at))
    return np.frombuffer(b"".join(codes), kind)[at], sizes


def text_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive stretches of ``counts``."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
