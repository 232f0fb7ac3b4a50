"""Counting, quantiles, AUC and run reports."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import id_list_text


def anomaly_id_list(df: DataFrame, id_col: str, flag_col: str, group_cols: Sequence[str]) -> DataFrame:
    """Per group (e.g. a flush group of bounded size) the sorted comma list of flagged ids; '' if none."""
    ids = F.collect_list(F.when(F.col(flag_col), F.col(id_col)))
    return df.groupBy(*group_cols).agg(id_list_text(ids).alias("ids"))


def num_anomalies(df: DataFrame, prediction_col: str = "prediction") -> DataFrame:
    """Number of rows predicted anomalous (one aggregate, nothing collected)."""
    return df.agg(F.count_if(F.col(prediction_col) > 0).alias("num_anomalies"))


BRACKET = 0.001  # relative rank error of the sketch


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """Exact discrete quantiles (smallest value whose cumulative share reaches p).

    A GK sketch brackets each wanted rank, one pass counts the values below and inside the brackets,
    and only the values inside are sorted and indexed (a distributed selection; no single task or the
    driver ever holds the column). A rank outside its bracket is selected from the whole column.
    Rank for p is ceil(p * n) (1-based), as in ``approxQuantile(..., 0.0)``.
    """
    import math

    from .indexing import select_ranks

    from pyspark import StorageLevel

    # one narrow column, read by the count and by the sort: computed once
    vals = (df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        n = vals.count()
        if n == 0:
            return [None for _ in probs]
        ranks = {p: min(n, max(1, math.ceil(p * n))) - 1 for p in probs}
        ends = [min(1.0, max(0.0, p + d)) for p in probs for d in (-2 * BRACKET, 2 * BRACKET)]
        found = vals.stat.approxQuantile("v", ends, BRACKET)
        pairs = {p: (found[2 * i], found[2 * i + 1]) for i, p in enumerate(probs)}
        v = F.col("v")
        counts = vals.agg(*[c for i, p in enumerate(probs) for c in (
            F.count_if(v < pairs[p][0]).alias(f"below{i}"), F.count_if(v.between(*pairs[p])).alias(f"inside{i}"))]).first()
        out = {}
        for i, p in enumerate(probs):
            rank = ranks[p] - counts[f"below{i}"]
            if pairs[p][0] == pairs[p][1] and 0 <= rank < counts[f"inside{i}"]:
                out[p] = pairs[p][0]
            elif 0 <= rank < counts[f"inside{i}"]:
                out[p] = select_ranks(vals.filter(v.between(*pairs[p])), "v", [rank])[rank]
            else:
                out[p] = select_ranks(vals, "v", [ranks[p]])[ranks[p]]
        return [out[p] for p in probs]
    finally:
        vals.unpersist()


def quantile(df: DataFrame, col: str, p: float, relative_error: float = 0.0) -> float | None:
    """``1 - contamination`` style threshold: exact selection when the error is 0, else GK sketch."""
    if relative_error <= 0:
        return exact_quantiles(df, col, [p])[0]
    res = df.stat.approxQuantile(col, [p], relative_error)
    return res[0] if res else None


KLL_K = 400  # rank error of a sketch of this size: below 1% (about 1.3 / k**0.9 of the rows, either way, with 99% confidence)


class RunningThreshold:
    """D7 / H11 over a stream: the ``1 - contamination`` quantile of all scores so far, kept as mergeable KLL sketches.

    ``update(batch, epoch)`` writes one small row for the micro-batch (its sketch, some kilobytes whatever its size) and returns
    the threshold over this and all earlier micro-batches, None while there are no scores. A replayed micro-batch
    overwrites its row and sees only earlier ones, so its threshold does not change.
    """

    def __init__(self, spark: SparkSession, path: str, contamination: float = 0.1, k: int = KLL_K) -> None:
        self.spark, self.path, self.p, self.k = spark, path.rstrip("/"), 1.0 - contamination, k

    def update(self, batch: DataFrame, epoch: int, score_col: str = "anomalyScore") -> float | None:
        v = F.col(score_col).cast("double")
        one = batch.filter(v.isNotNull() & ~F.isnan(v)).agg(F.kll_sketch_agg_double(v, F.lit(self.k)).alias("sketch"), F.count(F.lit(1)).alias("n"))
        one.select(F.lit(epoch).cast("long").alias("epoch"), "sketch", "n").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={epoch}")
        return self.threshold(epoch)

    def threshold(self, epoch: int | None = None) -> float | None:
        """The threshold after a micro-batch (the last one without ``epoch``)."""
        rows = self.spark.read.schema("epoch long, sketch binary, n long").parquet(self.path).filter("n > 0")
        if epoch is not None:
            rows = rows.filter(F.col("epoch") <= epoch)
        merged = rows.agg(F.kll_merge_agg_double("sketch", F.lit(self.k)).alias("s"), F.sum("n").alias("n"))
        found = merged.select(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", F.lit(self.p)))).first()
        return found[0]


def auc_binary(df: DataFrame, prediction_col: str, label_col: str) -> DataFrame:
    """D15 for 0/1 predictions: area under the ROC curve = (TPR + TNR) / 2, from one aggregate.

    For a two-valued score this equals the rank-sum (Mann-Whitney) area with mid-ranks.
    """
    pred = F.col(prediction_col) > 0
    lab = F.col(label_col) > 0
    agg = df.agg(
        F.count_if(pred & lab).alias("tp"),
        F.count_if(lab).alias("p"),
        F.count_if(~pred & ~lab).alias("tn"),
        F.count_if(~lab).alias("n"),
    )
    return agg.select(
        ((F.col("tp") / F.col("p") + F.col("tn") / F.col("n")) / 2.0).alias("auc"),
        F.col("p").alias("positives"),
        F.col("n").alias("negatives"),
    )


def auc_roc(df: DataFrame, score_col: str, label_col: str) -> float:
    """D15 for any score, ties at their mid-rank: MLlib's BinaryClassificationEvaluator without binning (a distributed sort)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    ev = BinaryClassificationEvaluator(rawPredictionCol=score_col, labelCol=label_col, metricName="areaUnderROC", numBins=0)
    return ev.evaluate(df.select(F.col(score_col).cast("double"), F.col(label_col).cast("double")))


RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("technique", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("elapsed_sec", T.DoubleType()),
        T.StructField("finished_at", T.TimestampType()),
    ]
)


def append_run_report(spark: SparkSession, path: str, technique: str, score: float, started: float) -> DataFrame:
    """A10: append one (run id, technique, score, elapsed seconds) row to a runs table and return the table."""
    import datetime as dt

    row = (uuid.uuid4().hex, technique, float(score), time.time() - started, dt.datetime.now(dt.timezone.utc))
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)
