"""Distance-threshold anomaly detection over clusters.

A fitted detector is a small table: k centroids (k x d numbers) and, per
cluster, the largest training distance. Scoring embeds that table in the plan
as an array literal, so assignment, distance and flag are built-in array
expressions inside whole-stage codegen: no Python UDF, no join, no shuffle.
A table of more than ``BLOCK_CELLS`` numbers is scored in blocks of centroids: each
row carries its nearest centroid so far past the blocks, and what a task holds of the
table is one block. Distances to given clusters and limits per cluster then come
from a join with the table.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import distance_to_values, euclidean_distance, flag_beyond, nearest_centroid_values

BLOCK_CELLS = 4 << 20  # k * d numbers of the centroid table in one expression or one broadcast block
BLOCKS_A_PASS = 4  # blocks between two written tables


def _embeds(k: int, d: int) -> bool:
    return k * d <= BLOCK_CELLS and k <= 10_000


# ----------------------------------------------------------------------------- column-level operators


def assign_nearest(df: DataFrame, vec_col: str, centroids: Sequence[Sequence[float]],
                   prediction_col: str = "prediction", dist_col: str = "dist") -> DataFrame:
    """Nearest centroid (ties to the lower index) and the distance to it (H7), for centroid tables of any size."""
    k, d = len(centroids), len(centroids[0]) if centroids else 0
    if k * d <= BLOCK_CELLS:
        found = df.withColumn("_best", nearest_centroid_values(F.col(vec_col), centroids))
    else:
        found = _assign_in_blocks(df, vec_col, centroids, max(1, BLOCK_CELLS // max(1, d)))
    return found.withColumn(prediction_col, F.col("_best.cluster")).withColumn(dist_col, F.col("_best.dist")).drop("_best")


def _assign_in_blocks(df: DataFrame, vec_col: str, centroids: Sequence[Sequence[float]], block: int) -> DataFrame:
    """``_best`` by a running minimum over blocks of centroids.

    Each block is one vectorised pass over the rows at hand; after ``BLOCKS_A_PASS`` of them the rows with their best
    so far are written, so that a task holds a bounded part of the table and a lost executor repeats a bounded part of the work.
    """
    from ..session import stored

    out = df
    for n, at in enumerate(range(0, len(centroids), block)):
        near = nearest_centroid_values(F.col(vec_col), centroids[at : at + block])
        out = out.withColumn("_near", near).withColumn("_near", F.struct((F.col("_near.cluster") + at).alias("cluster"), F.col("_near.dist").alias("dist")))
        if n == 0:
            out = out.withColumnRenamed("_near", "_best")
        else:  # an equal distance stays with the earlier block, which has the lower index
            out = out.withColumn("_best", F.when(F.col("_near.dist") < F.col("_best.dist"), F.col("_near")).otherwise(F.col("_best"))).drop("_near")
        if n % BLOCKS_A_PASS == BLOCKS_A_PASS - 1:
            out = stored(out, "nearest")
    return out


def distance_to_cluster(df: DataFrame, vec_col: str, cluster_col: str, centroids: Sequence[Sequence[float]],
                        dist_col: str = "dist") -> DataFrame:
    """C7 + H7: distance of each row to the centroid of its given cluster (0-based index)."""
    if _embeds(len(centroids), len(centroids[0]) if centroids else 0):
        return df.withColumn(dist_col, distance_to_values(F.col(vec_col), centroids, F.col(cluster_col)))
    table = _table(df.sparkSession, "cluster int, centroid array<double>", [(i, [float(v) for v in c]) for i, c in enumerate(centroids)])
    return distance_to_cluster_table(df, vec_col, cluster_col, table, dist_col)


def _table(spark, schema: str, rows: list) -> DataFrame:
    """A large parameter table, written once: plans refer to the files, not to the rows."""
    from ..session import stored

    return stored(spark.createDataFrame(rows, schema), "clusters")


def distance_to_cluster_table(df: DataFrame, vec_col: str, cluster_col: str, clusters: DataFrame,
                              dist_col: str = "dist", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """C7 as a join: rows x cluster table (cluster, centroid) on the cluster id.

    The cluster table is broadcast only after its size is checked against ``broadcast_bytes``;
    beyond that the planner's shuffle join is used.
    """
    size = clusters.agg(F.coalesce(F.sum(F.size("centroid") * 8 + 64), F.lit(0))).first()[0]
    right = F.broadcast(clusters) if size <= broadcast_bytes else clusters
    j = df.join(right, df[cluster_col] == right["cluster"], "left").drop(right["cluster"])
    return j.withColumn(dist_col, euclidean_distance(F.col(vec_col), F.col("centroid"))).drop("centroid")


def clustering_score(assigned: DataFrame, k: int, prediction_col: str = "prediction", dist_col: str = "dist") -> DataFrame:
    """Mean over k clusters of the mean point-centroid distance; an empty cluster adds 0.

    One grouped aggregate (partial aggregation, k result rows) then a global sum.
    """
    per = assigned.groupBy(prediction_col).agg(F.avg(dist_col).alias("m"))
    return per.agg((F.coalesce(F.sum("m"), F.lit(0.0)) / F.lit(float(k))).alias("score"))


def max_by_centroid(assigned: DataFrame, k: int, prediction_col: str = "prediction", dist_col: str = "dist") -> DataFrame:
    """Largest distance per cluster; clusters without rows get 0.0."""
    spark = assigned.sparkSession
    ids = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    mx = assigned.groupBy(F.col(prediction_col).cast("int").alias("cluster")).agg(F.max(dist_col).alias("max_dist"))
    return ids.join(mx, "cluster", "left").select("cluster", F.coalesce("max_dist", F.lit(0.0)).alias("max_dist"))


def flag_anomalies(assigned: DataFrame, max_dist: Sequence[float], prediction_col: str = "prediction",
                   dist_col: str = "dist") -> DataFrame:
    """anomaly = 1 when the distance is strictly greater than its cluster's training maximum."""
    if len(max_dist) <= 10_000:
        lim = F.element_at(F.array(*[F.lit(float(x)) for x in max_dist]), F.col(prediction_col) + 1)
        limited = assigned.withColumn("max_dist", lim)
    else:
        table = _table(assigned.sparkSession, "_cluster int, max_dist double", [(i, float(x)) for i, x in enumerate(max_dist)])
        limited = assigned.join(table, F.col(prediction_col) == F.col("_cluster"), "left").drop("_cluster")
    return limited.withColumn("anomaly", flag_beyond(dist_col, "max_dist"))


# ----------------------------------------------------------------------------- detector


@dataclass
class ClusterDetectorModel:
    """Fitted distance-threshold detector: centroids and per-cluster max distance (Q2: kept from fit)."""

    centroids: list[list[float]]
    max_dist: list[float]
    vec_col: str = "vec"
    prepare: PipelineModel | None = None  # feature pipeline (assembler, encoders, scaler)
    clusterer: object | None = None  # MLlib model, when fitted by MLlib
    score: float | None = None
    meta: dict = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.centroids)

    def features(self, df: DataFrame) -> DataFrame:
        out = self.prepare.transform(self._filled(df)) if self.prepare is not None else df
        if self.vec_col not in out.columns:
            raise ValueError(f"missing feature column {self.vec_col}")
        if dict(out.dtypes)[self.vec_col] != "array<double>":
            out = out.withColumn(self.vec_col, vector_to_array(self.vec_col))
        return out

    def _filled(self, df: DataFrame) -> DataFrame:
        """``df`` with NULL numbers as 0 and ``incomplete`` telling such rows."""
        nums = self.meta.get("numeric", [])
        if not nums:
            return df.withColumn("incomplete", F.lit(False))
        missing = F.lit(False)
        for c in nums:
            missing = missing | F.col(c).isNull()
        return df.withColumn("incomplete", missing).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in nums})

    def transform(self, df: DataFrame) -> DataFrame:
        """Prediction, dist, max_dist and anomaly (0/1) for every row.

        A row with a NULL number is kept: it is scored with 0 in its place, marked ``incomplete`` and
        counted as an anomaly.
        """
        out = flag_anomalies(assign_nearest(self.features(df), self.vec_col, self.centroids), self.max_dist)
        if "incomplete" not in out.columns:
            return out
        return out.withColumn("anomaly", F.when(F.col("incomplete"), F.lit(1)).otherwise(F.col("anomaly")))

    def anomalies(self, df: DataFrame) -> DataFrame:
        """Only the flagged rows."""
        return self.transform(df).filter(F.col("anomaly") > 0)

    def cluster_table(self, spark) -> DataFrame:
        rows = [(i, [float(v) for v in c], float(m)) for i, (c, m) in enumerate(zip(self.centroids, self.max_dist))]
        return spark.createDataFrame(rows, "cluster int, centroid array<double>, max_dist double")


def _max_dists(assigned: DataFrame, k: int) -> list[float]:
    rows = max_by_centroid(assigned, k).orderBy("cluster").collect()  # k rows
    return [float(r["max_dist"]) for r in rows]


def _cluster_stats(assigned: DataFrame, k: int) -> tuple[list[float], float]:
    """D4 + D5 in one aggregate pass: per-cluster (max, mean) distance -> (max list, score)."""
    rows = assigned.groupBy("prediction").agg(F.max("dist").alias("mx"), F.avg("dist").alias("m")).collect()  # <= k rows
    mx = [0.0] * k
    total = 0.0
    for r in rows:
        mx[int(r["prediction"])] = float(r["mx"])
        total += float(r["m"])
    return mx, total / k


def fit_with_centroids(train: DataFrame, vec_col: str, centroids: Sequence[Sequence[float]],
                       prepare: PipelineModel | None = None) -> ClusterDetectorModel:
    """Detector with given centroids: only the per-cluster maxima are learnt from ``train``."""
    model = ClusterDetectorModel([list(map(float, c)) for c in centroids], [], vec_col, prepare)
    assigned = assign_nearest(model.features(train), vec_col, model.centroids)
    model.max_dist = _max_dists(assigned, model.k)
    return model


def label_centroids(df: DataFrame, vec_col: str, label_col: str, decimals: int | None = 2) -> DataFrame:
    """Per-label mean vector as (cluster=label, centroid array<double>), optionally rounded.

    ``Summarizer.mean`` is one aggregate buffer per label (partial aggregation).
    """
    arr = F.col(vec_col)
    vec = array_to_vector(arr.cast("array<double>")) if dict(df.dtypes)[vec_col].startswith("array") else arr
    m = df.groupBy(F.col(label_col).alias("cluster")).agg(Summarizer.mean(vec).alias("m"))
    c = vector_to_array("m")
    if decimals is not None:
        c = F.transform(c, lambda x: F.round(x, decimals))
    return m.select("cluster", c.alias("centroid"))


# ----------------------------------------------------------------------------- MLlib pipelines


def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = False,
                     out_col: str = "features") -> list:
    """StringIndexer -> OneHotEncoder(dropLast=False) -> VectorAssembler -> [StandardScaler].

    The assembler column order is the given ordered list (Q18); categorical
    columns are a parameter that must not contain the label (Q17). Numbers must not be NULL:
    the detector fits on complete rows and fills the others when it scores.
    """
    stages: list = []
    encoded = []
    if categorical:
        idx = [f"{c}_idx" for c in categorical]
        encoded = [f"{c}_vec" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=encoded, dropLast=False, handleInvalid="keep"))
    raw = out_col + "_raw" if scale else out_col
    stages.append(VectorAssembler(inputCols=list(numeric) + encoded, outputCol=raw, handleInvalid="error"))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol=out_col, withStd=True, withMean=False))
    return stages


def fit_detector(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), k: int = 10,
                 algorithm: str = "kmeans", scale: bool = False, seed: int = 1,
                 sample_fraction: float | None = None, max_iter: int = 20) -> ClusterDetectorModel:
    """Fit a feature pipeline and a clusterer, then learn per-cluster max distances.

    ``algorithm``: kmeans | bisecting | gmm (centres = component means). With
    ``sample_fraction`` the clusterer is fitted on a seeded sample (the mixture
    model was meant for a 1% sample); the maxima always use the whole train set.
    """
    from pyspark import StorageLevel

    started = time.time()
    train = train.dropna(subset=list(numeric))  # incomplete rows teach nothing; scoring keeps and flags them
    prep = Pipeline(stages=feature_pipeline(numeric, categorical, scale, "features")).fit(train)
    # The clusterer makes many passes: keep the (narrow) feature column for the fit only. K-means over numbers alone takes them
    # in blocks that it keeps in memory itself: a round is a matrix product a block, with nothing taken apart row by row.
    blocks = algorithm == "kmeans" and not categorical
    feats = prep.transform(train).select("features").persist(StorageLevel.DISK_ONLY if blocks else StorageLevel.MEMORY_AND_DISK)
    fit_on = feats.sample(False, sample_fraction, seed) if sample_fraction else feats
    if algorithm == "kmeans":
        est = KMeans(k=k, seed=seed, featuresCol="features", maxIter=max_iter, solver="block" if blocks else "auto")
    elif algorithm == "bisecting":
        est = BisectingKMeans(k=k, seed=seed, featuresCol="features", maxIter=max_iter)
    elif algorithm == "gmm":
        est = GaussianMixture(k=k, seed=seed, featuresCol="features", maxIter=max_iter)
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    fitted = est.fit(fit_on)
    if algorithm == "gmm":
        centres = [list(map(float, g.mean.toArray())) for g in fitted.gaussians]
    else:
        centres = [list(map(float, c)) for c in fitted.clusterCenters()]
    model = ClusterDetectorModel(centres, [], "features", prep, fitted)
    assigned = assign_nearest(feats.withColumn("features", vector_to_array("features")), "features", centres)
    model.max_dist, model.score = _cluster_stats(assigned, model.k)
    feats.unpersist()
    model.meta = {"numeric": list(numeric), "algorithm": algorithm, "k": k, "seed": seed, "scale": scale, "elapsed_sec": time.time() - started}
    return model


# ----------------------------------------------------------------------------- persistence, train and score entries


def save_detector(model: ClusterDetectorModel, spark, path: str) -> None:
    """Centroid table (cluster, centroid, max_dist) as parquet, the feature pipeline, and metadata."""
    import json

    model.cluster_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/clusters")
    if model.prepare is not None:
        model.prepare.write().overwrite().save(f"{path}/prepare")
    meta = {"has_pipeline": model.prepare is not None, "vec_col": model.vec_col, "score": model.score, "meta": model.meta}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_detector(spark, path: str) -> ClusterDetectorModel:
    import json

    rows = spark.read.parquet(f"{path}/clusters").orderBy("cluster").collect()  # k rows
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    try:
        prepare = PipelineModel.load(f"{path}/prepare") if meta["has_pipeline"] else None
    except KeyError as e:
        raise ValueError(f"{path} holds no saved detector") from e
    return ClusterDetectorModel([list(r["centroid"]) for r in rows], [float(r["max_dist"]) for r in rows],
                                meta["vec_col"], prepare, None, meta.get("score"), meta.get("meta", {}))


def train_kmeans(spans: DataFrame, path: str | None = None, k: int = 10, seed: int = 1) -> ClusterDetectorModel:
    """Spans -> trace features -> K-means detector (k=10, seed 1), saved when ``path`` is given."""
    from pyspark import StorageLevel

    from ..schema import FEATURE_COLUMNS
    from .features import trace_features

    made = trace_features(spans).persist(StorageLevel.MEMORY_AND_DISK)  # apart from the fit's vectors: one method for both is too long to compile
    try:
        model = fit_detector(made, list(FEATURE_COLUMNS), k=k, algorithm="kmeans", seed=seed)
    finally:
        made.unpersist()
    if path:
        save_detector(model, spans.sparkSession, path)
    return model


def feature_vector(cols) -> "F.Column":
    return F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("double") for c in cols])


def predict_traces(requests: DataFrame, model: ClusterDetectorModel, body_col: str = "body",
                   flush_size: int = 5000) -> DataFrame:
    """JSON request arrays -> rows (A6) -> features (H6) -> flags (J10) -> id list per flush group.

    The model's vector must be the 19 trace features in schema order (as built
    by ``feature_vector``). Flush groups of ``flush_size`` rows in Id order keep
    every id list bounded. Requests that cannot be scored are told by ``sources.io.unjudged_requests``.
    """
    from ..schema import FEATURE_COLUMNS
    from ..sources.io import parse_trace_requests
    from .evaluate import anomaly_id_list
    from .features import payload_features
    from ..session import stored
    from .spans import flush_groups

    rows = parse_trace_requests(requests, body_col).filter("bad_body IS NULL")  # a body without ids has nothing to flag
    pf = payload_features(rows, "request", keep=("Id", "TraceD", "SpanD1", "SpanD2", "SpanD3", "SpanD4"))
    vec = pf.select("Id", feature_vector(FEATURE_COLUMNS).alias(model.vec_col))
    flagged = model.transform(vec).select("Id", (F.col("anomaly") > 0).alias("flagged"))
    flagged = stored(flagged, "flagged")  # a sort reads its input twice
    return anomaly_id_list(flush_groups(flagged, ["Id"], flush_size), "Id", "flagged", ["flush_group"])
