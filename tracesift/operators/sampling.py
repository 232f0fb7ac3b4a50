"""Head and tail sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HASH_SPACE, hash_int

_FEW_ROWS = 1 << 16  # rows that are numbered rather than counted once more


def head_sample(spans: DataFrame, rate: float, seed: int = 0, key: str = "trace_id") -> DataFrame:
    """Keep a ``rate`` share of traces, decided once per trace id so all its spans agree.

    rate 1 keeps everything (the constant sampler); otherwise a trace is kept when
    md5(trace_id|seed) falls below rate * 2^60. A pure map-side filter.
    """
    if rate >= 1.0:
        return spans
    if rate <= 0.0:
        return spans.limit(0)
    bound = int(rate * HASH_SPACE)
    return spans.filter(hash_int(key, F.lit(str(seed))) < F.lit(bound))


def reservoir_sample(df: DataFrame, k: int, seed: int, key_cols: Sequence[str]) -> DataFrame:
    """Exact-size uniform sample of k rows: the k smallest md5(key|seed) values.

    Spark plans ``orderBy(...).limit(k)`` as a distributed top-k
    (TakeOrderedAndProject): each task keeps k rows, the driver merges k per task.
    """
    h = hash_int(*key_cols, F.lit(str(seed)))
    return df.withColumn("_h", h).orderBy("_h", *key_cols).limit(k).drop("_h")


_CELL_BITS = 12
_HASH_BITS = 60


def reservoir_sample_and_count(df: DataFrame, k: int, seed: int, key_cols: Sequence[str]) -> tuple[DataFrame, int]:
    """(exactly min(k, n) rows drawn uniformly, n); the sample stays distributed, so ``k`` may be of any size.

    The rows with the k smallest md5(key|seed), as in ``reservoir_sample``. A histogram of the hashes' leading bits
    (4,096 counts, partial sums on the map side) gives n and the cell in which the k-th smallest lies; that cell is
    looked at again by its next bits until few rows are left in it, and those are numbered. Rows with equal keys are told apart
    by position, so copies neither crowd the sample out nor make it larger.
    """
    from ..session import stored
    from .indexing import dense_index

    if k < 0:
        raise ValueError(f"a sample of {k} rows")
    rows = stored(df.withColumn("_h", hash_int(*key_cols, F.lit(str(seed)))), "reservoir")
    total, below, low, bits = None, 0, 0, _HASH_BITS
    while True:
        bits -= _CELL_BITS
        cell = F.shiftright(F.col("_h") - F.lit(low), bits)
        inside = rows if total is None else rows.filter((F.col("_h") >= low) & (F.col("_h") < low + (1 << (bits + _CELL_BITS))))
        counts = sorted((r["c"], r["n"]) for r in inside.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect())  # 4,096 rows at most
        if total is None:
            total = sum(n for _, n in counts)
            if k >= total:
                return rows.drop("_h"), total
        for c, n in counts:
            if below + n > k:
                low, left = low + (c << bits), n
                break
            below += n
        if below == k or left <= _FEW_ROWS or bits == 0:
            break
    sure = rows.filter(F.col("_h") < low)
    if below == k:
        return sure.drop("_h"), total
    edge = rows.filter((F.col("_h") >= low) & (F.col("_h") < low + (1 << bits)))
    numbered, _ = dense_index(edge, ["_h", *key_cols], "_at")
    return sure.unionByName(numbered.filter(F.col("_at") < k - below).drop("_at")).drop("_h"), total


def tail_sample(spans: DataFrame, flagged: DataFrame, mode: str = "anomalous") -> DataFrame:
    """Forward the spans of flagged traces (``anomalous``) or everything (``passthrough``).

    ``flagged`` holds trace ids; the semi join keeps the span columns only.
    """
    if mode == "passthrough":
        return spans
    if mode != "anomalous":
        raise ValueError(f"unknown mode {mode!r}")
    return spans.join(flagged.select("trace_id").distinct(), "trace_id", "left_semi")
