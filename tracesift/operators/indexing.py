"""Dense 0-based row indices without leaving the JVM (E1, used by E3, D7 and the forest).

``monotonically_increasing_id`` is unique but not dense: it counts within a
partition from a start of the partition's own. Taking it together with
``spark_partition_id`` on checkpointed rows, counting rows per partition (one
row per partition reaches the driver) and moving each partition's start to its
offset gives a dense index. The checkpoint makes both
passes see the same rows in the same order, also after an executor is lost.
The offset table has one row per partition, a bound known before it is
broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_checkpoint

_PID = "_ix_pid"
_MONO = "_ix_mono"
MAX_OFFSET_ROWS = 1_000_000  # partitions; the offset table is broadcast below this


def dense_index(df: DataFrame, order_cols: Sequence[str] | None = None, name: str = "row_idx") -> tuple[DataFrame, int]:
    """(rows with a dense ``name`` column in ``order_cols`` order, row count).

    Without ``order_cols`` the index follows the input's partition order.
    """
    base = df.orderBy(*order_cols) if order_cols else df
    marked = fresh_checkpoint(base.withColumn(_PID, F.spark_partition_id()).withColumn(_MONO, F.monotonically_increasing_id()))
    parts = marked.groupBy(_PID).agg(F.count(F.lit(1)).alias("n"), F.min(_MONO).alias("start")).collect()
    offsets, total = [], 0
    for pid, n, start in sorted(tuple(r) for r in parts):
        offsets.append((pid, total - start))
        total += n
    spark = df.sparkSession
    offs = spark.createDataFrame(offsets or [(0, 0)], f"{_PID} int, _ix_off long")
    offs = F.broadcast(offs) if len(offsets) <= MAX_OFFSET_ROWS else offs
    out = marked.join(offs, _PID).withColumn(name, F.col("_ix_off") + F.col(_MONO)).drop(_PID, _MONO, "_ix_off")
    return out, total


def select_ranks(df: DataFrame, col: str, ranks: Sequence[int]) -> dict[int, object]:
    """Values at 0-based ranks of ``col`` in ascending order (a distributed sort; only the wanted rows are collected)."""
    idx, _ = dense_index(df.select(col), [col], "_rank")
    rows = idx.filter(F.col("_rank").isin([int(r) for r in set(ranks)])).collect()
    return {int(r["_rank"]): r[col] for r in rows}
