"""Isolation forest as a Spark ML Estimator / Model.

Default (no bootstrap) sampling: each tree keeps each row with probability
p ~ (psi + 10 sqrt(psi)) / n (JVM ``rand`` per tree, or an ``xxhash64`` of
``idCol`` for a partitioning-independent draw), and its group then picks exactly
psi rows uniformly; a tree that drew fewer than psi rows is redrawn with a larger
p. The result is a uniform psi-subset per tree without indexing or writing the
training table. The index-based path below is used for bootstrap (with
replacement), where thinning would change the distribution.


Training shape ("model-wise" parallelism):
  1. rows get a 0-based index (partition offsets on checkpointed rows; or sorted by ``idCol`` first for
     a reproducible order);
  2. the per-tree index sets are drawn on executors from ``spark.range(numTrees)``
     with a seed per tree (never from a shared RNG), giving numTrees * psi rows;
  3. rows join the index sets on row_idx. That side is broadcast only when
     numTrees * psi is under ``BROADCAST_SAMPLE_ROWS`` (a bound computed from the
     parameters, not the data); above it the planner shuffles;
  4. ``groupBy(tree_id).applyInPandas`` grows one tree per group; a group holds
     exactly psi rows, so memory per task is bounded by maxSamples, not by n;
  5. the node table (at most numTrees * (2 psi - 1) rows) is the model.
Scoring ("data-wise"): a vectorised ``pandas_udf`` walks all trees over each Arrow
batch using flat node arrays shipped with the function; the threshold is the
(1 - contamination) quantile of the training scores, computed in ``fit`` (Q10).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.forest import avg_path_length_value, depth_limit_value
from ..schema import NODE_SCHEMA
from .evaluate import quantile

BROADCAST_SAMPLE_ROWS = 2_000_000  # (tree_id, row_idx) pairs: ~32 MB


def _c_array(n: np.ndarray) -> np.ndarray:
    """Vectorised c(n) (H8)."""
    n = n.astype(np.float64)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + 0.5772156649) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


# ----------------------------------------------------------------------------- params


class _IForestParams(HasFeaturesCol, HasPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxSamples = Param(Params._dummy(), "maxSamples", "rows per tree: <= 1 is a fraction of n, > 1 a count",
                       TypeConverters.toFloat)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "features per tree: <= 1 fraction, > 1 count",
                        TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "height limit of a tree", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "expected share of anomalies", TypeConverters.toFloat)
    bootstrap = Param(Params._dummy(), "bootstrap", "draw rows with replacement", TypeConverters.toBoolean)
    approxQuantileRelativeError = Param(Params._dummy(), "approxQuantileRelativeError",
                                        "0 = exact threshold by distributed selection", TypeConverters.toFloat)
    scoreCol = Param(Params._dummy(), "scoreCol", "anomaly score column", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "optional ordering key for a reproducible row index",
                  TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(numTrees=100, maxSamples=256.0, maxFeatures=1.0, maxDepth=10, contamination=0.1,
                         bootstrap=False, approxQuantileRelativeError=0.0, scoreCol="anomalyScore", idCol="",
                         featuresCol="features", predictionCol="prediction", seed=1)

    def _check_schema(self, schema: T.StructType, fitting: bool) -> None:
        """Features must be a vector or numeric array; output columns must not exist yet."""
        fc = self.getOrDefault(self.featuresCol)
        if fc not in schema.names:
            raise ValueError(f"missing features column {fc}")
        dt = schema[fc].dataType
        if not isinstance(dt, (VectorUDT, T.ArrayType)):
            raise TypeError(f"features column {fc} must be a vector or array, got {dt}")
        if not fitting:
            for c in (self.getOrDefault(self.predictionCol), self.getOrDefault(self.scoreCol)):
                if c in schema.names:
                    raise ValueError(f"output column {c} already exists")


def _features_array(df: DataFrame, col: str) -> F.Column:
    dt = df.schema[col].dataType
    return vector_to_array(F.col(col)) if isinstance(dt, VectorUDT) else F.col(col).cast("array<double>")


# ----------------------------------------------------------------------------- tree growth (per group, numpy)


def grow_tree(X: np.ndarray, tree_id: int, seed: int, limit: int, max_features: float) -> list[tuple]:
    """J14 + J15 + J18: grow one isolation tree; rows of the pre-order node table.

    A node is a leaf when its depth reaches ``limit``, it holds <= 1 row, or all
    sampled features are constant on it. Otherwise a non-constant feature is drawn
    uniformly and a split value uniformly in [min, max); ``x < v`` goes left.
    """
    rng = np.random.default_rng([int(seed) & 0xFFFFFFFF, int(tree_id), 1])
    n, d = X.shape
    if max_features <= 1.0:
        m = max(1, int(max_features * d))
    else:
        m = max(1, min(int(max_features), d))
    feats = np.sort(rng.choice(d, m, replace=False)) if m < d else np.arange(d)
    nodes: list[list] = []
    stack = [(np.arange(n), 0, -1, 0)]
    while stack:
        idx, depth, parent, side = stack.pop()
        nid = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = nid
        if depth >= limit or len(idx) <= 1:
            nodes.append([nid, -1, -1.0, -1, -1, len(idx)])
            continue
        sub = X[np.ix_(idx, feats)]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        live = np.nonzero(hi > lo)[0]
        if len(live) == 0:
            nodes.append([nid, -1, -1.0, -1, -1, len(idx)])
            continue
        j = live[rng.integers(len(live))]
        f = int(feats[j])
        v = float(rng.uniform(lo[j], hi[j]))
        go_left = X[idx, f] < v
        nodes.append([nid, f, v, -2, -2, 0])
        stack.append((idx[~go_left], depth + 1, nid, 1))
        stack.append((idx[go_left], depth + 1, nid, 0))
    return [(int(tree_id), int(a), int(b), float(c), int(e), int(g), int(h)) for a, b, c, e, g, h in nodes]


# ----------------------------------------------------------------------------- scoring (vectorised)


WALK_CELLS = 1 << 15  # rows x trees that a walk holds at once


class _Forest:
    """Flat node arrays of all trees, for vectorised walks."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree_id", "id"]).reset_index(drop=True)
        self.trees = np.sort(nodes["tree_id"].unique())
        sizes = nodes.groupby("tree_id")["id"].count().reindex(self.trees).to_numpy()
        self.offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        off = np.repeat(self.offsets, sizes)
        self.feature = nodes["feature_index"].to_numpy(np.int64)
        self.value = nodes["feature_value"].to_numpy(np.float64)
        self.left = np.where(nodes["left_child"].to_numpy() >= 0, nodes["left_child"].to_numpy() + off, -1)
        self.right = np.where(nodes["right_child"].to_numpy() >= 0, nodes["right_child"].to_numpy() + off, -1)
        self.leaf_c = _c_array(nodes["num_instance"].to_numpy())
        # a leaf leads back to itself, so that a walk takes the same steps at every place
        inner, own = self.feature >= 0, np.arange(len(self.feature))
        self.column = np.where(inner, self.feature, 0)
        self.child = np.stack([np.where(inner, self.right, own), np.where(inner, self.left, own)], axis=1).ravel()
        self.depth, level, here = np.zeros(len(own)), 0, self.offsets
        while len(here := here[inner[here]]):
            level += 1
            here = np.r_[self.left[here], self.right[here]]
            self.depth[here] = level
        self.levels = level

    def _walk(self, X: np.ndarray) -> np.ndarray:
        """Path lengths of a block of rows in every tree, shape (rows, trees)."""
        pos = np.tile(self.offsets, (X.shape[0], 1))
        start, cells = (np.arange(X.shape[0]) * X.shape[1])[:, None], np.ascontiguousarray(X).ravel()
        for _ in range(self.levels):
            x = cells.take(self.column.take(pos) + start)
            pos = self.child.take(2 * pos + (x < self.value.take(pos)))
        return self.depth.take(pos) + self.leaf_c.take(pos)

    def _blocks(self, X: np.ndarray):
        """Ranges of rows with at most ``WALK_CELLS`` places in trees together: what a walk holds does not grow with the batch."""
        step = max(1, WALK_CELLS // max(1, len(self.offsets)))
        return ((lo, min(lo + step, len(X))) for lo in range(0, len(X), step))

    def path_lengths(self, X: np.ndarray) -> np.ndarray:
        """H9: path length of every row in every tree, shape (rows, trees)."""
        out = np.zeros((len(X), len(self.offsets)))
        for lo, hi in self._blocks(X):
            out[lo:hi] = self._walk(X[lo:hi])
        return out

    def mean_path_lengths(self, X: np.ndarray) -> np.ndarray:
        """The mean path length of every row."""
        out = np.zeros(len(X))
        for lo, hi in self._blocks(X):
            out[lo:hi] = self._walk(X[lo:hi]).mean(axis=1)
        return out


def _score_udf(nodes: pd.DataFrame, num_samples: int):
    forest = _Forest(nodes)
    norm = avg_path_length_value(num_samples)

    @F.pandas_udf(T.DoubleType())
    def score(feats: pd.Series) -> pd.Series:
        if len(feats) == 0:
            return pd.Series([], dtype="float64")
        X = np.stack([np.asarray(v, dtype=np.float64) for v in feats.to_numpy()])
        mean = forest.mean_path_lengths(X)
        return pd.Series(np.power(2.0, -mean / norm) if norm > 0 else np.ones(len(mean)))

    return score


def _path_udf(nodes: pd.DataFrame):
    forest = _Forest(nodes)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def paths(feats: pd.Series) -> pd.Series:
        if len(feats) == 0:
            return pd.Series([], dtype="object")
        X = np.stack([np.asarray(v, dtype=np.float64) for v in feats.to_numpy()])
        return pd.Series(list(forest.path_lengths(X)))

    return paths


# ----------------------------------------------------------------------------- estimator


def index_rows(df: DataFrame, id_col: str = "") -> tuple[DataFrame, int]:
    """(row_idx, f) with a dense 0-based index, sorted by ``id_col`` when given; and the row count."""
    from .indexing import dense_index

    idx, n = dense_index(df, [id_col] if id_col else None, "row_idx")
    return idx.select("row_idx", "f"), n


def tree_samples(spark: SparkSession, num_trees: int, n: int, psi: int, seed: int, bootstrap: bool) -> DataFrame:
    """(tree_id, row_idx) for every tree, drawn on executors with a seed per tree (Q12, Q13, Q14)."""

    def draw(batches):
        for b in batches:
            for t in b["id"].to_numpy():
                rng = np.random.default_rng([int(seed) & 0xFFFFFFFF, int(t), 0])
                if bootstrap:
                    idx = rng.integers(0, n, size=psi)  # half-open: [0, n)
                else:
                    idx = rng.choice(n, size=psi, replace=False)
                yield pd.DataFrame({"tree_id": np.full(psi, t, dtype=np.int32), "row_idx": idx.astype(np.int64)})

    return spark.range(num_trees, numPartitions=max(1, min(num_trees, spark.sparkContext.defaultParallelism))).mapInPandas(
        draw, "tree_id int, row_idx long"
    )


def sample_copies(samples: DataFrame) -> DataFrame:
    """Copies of a row per tree (> 1 only with bootstrap)."""
    return samples.groupBy("tree_id", "row_idx").agg(F.count(F.lit(1)).alias("copies"))


MAX_PSI = 1 << 20  # rows of one tree, which one task holds
MAX_NODES = 1 << 24  # rows of the node table, which the model holds


def binomial_steps(trees: int, p: float) -> list[float]:
    """P(at most k of the trees) for k = 0, 1, ... until it is 1 to within a double; a uniform draw passes as many steps as it joins trees."""
    out, total = [], 0.0
    for k in range(trees):
        log = math.lgamma(trees + 1) - math.lgamma(k + 1) - math.lgamma(trees - k + 1) + (k * math.log(p) if k else 0.0) + ((trees - k) * math.log1p(-p) if p < 1.0 else -math.inf)
        total += math.exp(log)
        out.append(min(total, 1.0))
        if k > trees * p and math.exp(log) < 2.0**-60:
            break
    return out


class IForest(Estimator, _IForestParams, MLReadable, MLWritable):
    """Isolation forest estimator."""

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", scoreCol="anomalyScore", numTrees=100,
                 maxSamples=256.0, maxFeatures=1.0, maxDepth=10, contamination=0.1, bootstrap=False,
                 approxQuantileRelativeError=0.0, seed=1, idCol=""):
        super().__init__()
        self._set(**self._input_kwargs)

    def write(self):
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls):
        return DefaultParamsReader(cls)

    def _num_samples(self, n: int) -> int:
        ms = self.getOrDefault(self.maxSamples)
        if ms <= 1.0:
            psi = int(ms * n)  # Q13: no truncation round-trip
        else:
            psi = int(ms)
            if psi > n:
                if self.isSet(self.maxSamples):
                    raise ValueError(f"maxSamples={psi} is larger than the number of rows {n}")  # Q15
                psi = n  # Q28: the default is min(256, n)
        if psi > MAX_PSI:
            raise ValueError(f"maxSamples={psi} rows a tree; one task holds a tree's rows, so at most {MAX_PSI}")
        if 2 * psi * self.getOrDefault(self.numTrees) > MAX_NODES:
            raise ValueError(f"{self.getOrDefault(self.numTrees)} trees of {psi} rows have up to {2 * psi * self.getOrDefault(self.numTrees)} nodes; the model holds at most {MAX_NODES}")
        return max(1, psi)

    def sample(self, dataset: DataFrame):
        """Indexed rows, the per-tree sample table and (n, psi)."""
        self._check_schema(dataset.schema, True)
        fc = self.getOrDefault(self.featuresCol)
        id_col = self.getOrDefault(self.idCol)
        cols = [_features_array(dataset, fc).alias("f")] + ([F.col(id_col)] if id_col else [])
        data = dataset.select(*cols)
        indexed, n = index_rows(data, id_col)
        if n == 0:
            raise ValueError("cannot fit on an empty dataset")
        psi = self._num_samples(n)
        spark = dataset.sparkSession
        samples = tree_samples(spark, self.getOrDefault(self.numTrees), n, psi, self.getOrDefault(self.seed),
                               self.getOrDefault(self.bootstrap))
        return indexed, samples, n, psi

    def _fit(self, dataset: DataFrame) -> "IForestModel":
        from pyspark import StorageLevel

        self._check_schema(dataset.schema, True)
        if self.getOrDefault(self.bootstrap):
            indexed, samples, n, psi = self.sample(dataset)
            indexed = indexed.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                small = self.getOrDefault(self.numTrees) * psi <= BROADCAST_SAMPLE_ROWS
                joined = indexed.join(F.broadcast(samples) if small else samples, "row_idx")  # C6
                return self._grow_and_threshold(joined.select("tree_id", "f", F.col("row_idx").alias("_key")),
                                                indexed, n, psi, exact_groups=True)
            finally:
                indexed.unpersist()
        fc = self.getOrDefault(self.featuresCol)
        id_col = self.getOrDefault(self.idCol)
        cols = [_features_array(dataset, fc).alias("f")] + ([F.col(id_col).alias("_key")] if id_col else [])
        # Multi-pass fit (count, per-tree draws, threshold scoring): keep the narrow rows for the fit only.
        data = dataset.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = data.count()
            if n == 0:
                raise ValueError("cannot fit on an empty dataset")
            psi = self._num_samples(n)
            return self._grow_and_threshold(None, data, n, psi, exact_groups=False)
        finally:
            data.unpersist()

    def _thin(self, data: DataFrame, n: int, psi: int, trees: list[int], factor: float) -> DataFrame:
        """(tree_id, f, _key): row r joins tree t with probability p, independently of every other row and tree; p is sized
        so that a tree gets >= psi rows except with negligible probability (10 standard deviations), and short trees are
        redrawn.

        One uniform draw a row gives how many of the trees it joins, by the binomial distribution; most rows join none
        and are done. The others take that many distinct trees, those with the smallest hashes of row and tree. Both
        together are the same as a draw for each row and tree.
        """
        seed = int(self.getOrDefault(self.seed))
        p = min(1.0, factor * (psi + 10.0 * math.sqrt(psi) + 10.0) / n)
        below = binomial_steps(len(trees), p)
        salt = F.lit(f"{seed}|{factor}")
        keyed = data if "_key" in data.columns else data.withColumn("_u", F.rand(seed))
        key = F.col("_key") if "_key" in data.columns else F.col("_u")
        u = F.pmod(F.xxhash64(key, salt), F.lit(1 << 53)) / F.lit(float(1 << 53))
        some = keyed.withColumn("_draw", u).filter(F.col("_draw") >= below[0])
        count = F.expr("0")
        for step in below:
            count = count + (F.col("_draw") >= step).cast("int")
        order = F.sort_array(F.array(*[F.struct(F.xxhash64(key, salt, F.lit(t)).alias("h"), F.lit(t).alias("t")) for t in trees]))
        picked = some.withColumn("_tree", F.explode(F.slice(order, F.lit(1), F.least(count, F.lit(len(trees))))))
        return picked.select(F.col("_tree.t").alias("tree_id"), "f", *(["_key"] if "_key" in data.columns else []))

    def thinned_rows(self, dataset: DataFrame) -> tuple[DataFrame, int, float]:
        """((tree_id, _key) of the draws before each tree picks its exact sample, rows, share of the rows a tree draws)."""
        data = dataset.select(_features_array(dataset, self.getOrDefault(self.featuresCol)).alias("f"), F.col(self.getOrDefault(self.idCol)).alias("_key"))
        n = data.count()
        psi = self._num_samples(n)
        drawn = self._thin(data, n, psi, list(range(self.getOrDefault(self.numTrees))), 1.0)
        return drawn.select("tree_id", "_key"), n, min(1.0, (psi + 10.0 * math.sqrt(psi) + 10.0) / n)

    def _grow_and_threshold(self, joined, data: DataFrame, n: int, psi: int, exact_groups: bool) -> "IForestModel":
        num_trees = self.getOrDefault(self.numTrees)
        limit = depth_limit_value(psi, self.getOrDefault(self.maxDepth))
        seed = self.getOrDefault(self.seed)
        max_features = self.getOrDefault(self.maxFeatures)

        def grow(key, pdf):
            t = int(key[0])
            if "_key" in pdf.columns:
                pdf = pdf.sort_values("_key", kind="stable")
            X = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["f"].to_numpy()])
            if not exact_groups:
                if len(X) < psi:  # short draw: report it, the driver redraws this tree
                    return pd.DataFrame([(t, -1, -1, -1.0, -1, -1, len(X))], columns=NODE_SCHEMA.names)
                rng = np.random.default_rng([int(seed) & 0xFFFFFFFF, t, 2])
                X = X[np.sort(rng.choice(len(X), psi, replace=False))]
            return pd.DataFrame(grow_tree(X, t, seed, limit, max_features), columns=NODE_SCHEMA.names)

        # One task per tree: an explicit repartition by tree_id (AQE would coalesce a
        # small shuffle into one task and grow the trees one after another).
        spread = lambda df, k: df.repartition(max(1, k), "tree_id")
        if exact_groups:
            nodes = spread(joined, num_trees).groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA).toPandas()
        else:
            todo, factor, got = list(range(num_trees)), 1.0, []
            while todo:
                thinned = spread(self._thin(data, n, psi, todo, factor), len(todo))
                part = thinned.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA).toPandas()
                short = set(part.loc[part["id"] < 0, "tree_id"].astype(int))
                short |= set(todo) - set(part["tree_id"].astype(int))  # a tree that drew no row at all
                got.append(part[~part["tree_id"].isin(short)])
                todo, factor = sorted(short), factor * 4.0
            nodes = pd.concat(got, ignore_index=True)
        # bounded: numTrees * (2 psi - 1) rows
        nodes = nodes.sort_values(["tree_id", "id"]).reset_index(drop=True)
        model = IForestModel._create(nodes, psi, None)
        self._copyValues(model)
        scored = data.select(_score_udf(nodes, psi)(F.col("f")).alias("s"))
        thr = quantile(scored, "s", 1.0 - self.getOrDefault(self.contamination),
                       self.getOrDefault(self.approxQuantileRelativeError))
        model.threshold = float(thr) if thr is not None else 1.0
        model.train_rows = n
        return model


class IForestModel(Model, _IForestParams, MLReadable, MLWritable):
    """Scores rows and flags those above the stored threshold."""

    def __init__(self):
        super().__init__()
        self.nodes: pd.DataFrame = pd.DataFrame(columns=NODE_SCHEMA.names)
        self.num_samples = 0
        self.threshold: float | None = None
        self.train_rows = 0

    @classmethod
    def _create(cls, nodes: pd.DataFrame, num_samples: int, threshold: float | None) -> "IForestModel":
        m = cls()
        m.nodes = nodes
        m.num_samples = int(num_samples)
        m.threshold = threshold
        return m

    @classmethod
    def from_nodes(cls, nodes: pd.DataFrame, num_samples: int, threshold: float | None = None, **params):
        m = cls._create(nodes, num_samples, threshold)
        m._set(**params)
        return m

    def getThreshold(self) -> float | None:
        return self.threshold

    def setThreshold(self, value: float) -> "IForestModel":
        self.threshold = float(value)
        return self

    @property
    def num_trees(self) -> int:
        return int(self.nodes["tree_id"].nunique())

    def nodes_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)

    def _score(self, dataset: DataFrame) -> DataFrame:
        fc = self.getOrDefault(self.featuresCol)
        udf = _score_udf(self.nodes, self.num_samples)
        return dataset.withColumn(self.getOrDefault(self.scoreCol), udf(_features_array(dataset, fc)))

    def path_lengths(self, dataset: DataFrame, out_col: str = "path_lengths") -> DataFrame:
        fc = self.getOrDefault(self.featuresCol)
        return dataset.withColumn(out_col, _path_udf(self.nodes)(_features_array(dataset, fc)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self._check_schema(dataset.schema, False)
        scored = self._score(dataset)
        if self.threshold is None:
            raise ValueError("the model has no threshold; call setThreshold or fit it")
        sc = F.col(self.getOrDefault(self.scoreCol))
        return scored.withColumn(self.getOrDefault(self.predictionCol), (sc > F.lit(self.threshold)).cast("double"))

    def summary(self, dataset: DataFrame) -> "IForestSummary":
        """The scored rows and what follows from them, as DataFrames."""
        return IForestSummary(self, self.transform(dataset))

    # -- persistence (A14, A15) -------------------------------------------------
    def write(self):
        return _IForestModelWriter(self)

    @classmethod
    def read(cls):
        return _IForestModelReader(cls)


class IForestSummary:
    """``predictions`` (all scored rows), ``anomalies`` (the flagged ones), ``scores`` (the score column)
    and ``totals`` (one row: rows, anomalies, mean score, threshold, trees, samples per tree); all lazy."""

    def __init__(self, model: "IForestModel", predictions: DataFrame):
        self.model, self.predictions = model, predictions

    @property
    def anomalies(self) -> DataFrame:
        return self.predictions.filter(F.col(self.model.getOrDefault(self.model.predictionCol)) > 0)

    @property
    def scores(self) -> DataFrame:
        return self.predictions.select(self.model.getOrDefault(self.model.scoreCol))

    @property
    def totals(self) -> DataFrame:
        m = self.model
        return self.predictions.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(m.getOrDefault(m.predictionCol)) > 0).alias("num_anomalies"),
            F.avg(m.getOrDefault(m.scoreCol)).alias("mean_score"),
        ).select("*", F.lit(m.threshold).alias("threshold"), F.lit(m.num_trees).alias("num_trees"),
                 F.lit(m.num_samples).alias("num_samples"))


class _IForestModelWriter(MLWriter):
    def __init__(self, instance: IForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        extra = {"num_samples": self.instance.num_samples, "threshold": self.instance.threshold,
                 "train_rows": self.instance.train_rows}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession.sparkContext, extraMetadata=extra)
        self.instance.nodes_df(self.sparkSession).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")


class _IForestModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> IForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession.sparkContext)
        spark = self.sparkSession
        nodes = spark.read.parquet(f"{path}/nodes")
        # Every tree must number its nodes 0..n-1.
        bad = (nodes.groupBy("tree_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("c"))
               .filter((F.col("lo") != 0) | (F.col("hi") != F.col("c") - 1)).count())
        if bad:
            raise ValueError(f"{bad} trees have non-contiguous node ids")
        pdf = nodes.orderBy("tree_id", "id").toPandas()
        m = IForestModel._create(pdf, meta["num_samples"], meta["threshold"])
        m.train_rows = meta.get("train_rows", 0)
        DefaultParamsReader.getAndSetParams(m, meta)
        return m


__all__ = ["IForest", "IForestModel", "grow_tree", "tree_samples", "sample_copies", "index_rows"]
