"""Lloyd's clustering on integer vectors, with bounds that are loosened by total displacement (ns-bounds).

1. Vectors are packed into blocks of ``BLOCK`` rows, written once. A block carries, for each of its
   vectors, the assigned centroid, an upper bound of the distance to it, a lower bound of the distance
   to every other centroid, and the round in which either bound was last evaluated.
2. All earlier centroids are kept (rounds x k x dimension numbers). A bound of round ``s`` is used in
   round ``t`` after loosening it by ``|c_t - c_s|``, the norm of the total displacement since then,
   which is never more than the sum of the drifts of the rounds between.
3. A vector whose loosened bounds do not prove its centroid strictly nearest has the distance to its own
   centroid evaluated again, and if that is not enough the distances to all. Distances are exact
   integers, so ties go to the smaller number exactly.
4. A block reports what its reassigned vectors add to and take from the centroids' integer sums; Spark
   adds the reports, and k x dimension sums come to the driver.

Blocks are cut by position, so copies of a vector never meet in one task. Rounds are narrow maps over
cached blocks; every ``CUT_EVERY`` rounds they are written to the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import store

BLOCK = 1024
CUT_EVERY = 16
SCALE = 1024
LIMIT = 1 << 27  # integer components stay below it, so that squared distances fit 64 bits
_STATE = "ids array<long>, x binary, own binary, up binary, up_at binary, low binary, low_at binary, moved array<struct<cluster:int,pos:int,v:long>>"
_MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("pos", pa.int32()), ("v", pa.int64())]))
_NAMES = ["ids", "x", "own", "up", "up_at", "low", "low_at", "moved"]
_MARGIN = 1e-9  # over the rounding of a few double operations


def kept_vectors(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors with exactly ``dims`` components, none null, non-finite or, scaled, beyond ``LIMIT``."""
    v = vectors[vector_col].cast("array<double>")
    limit = float(LIMIT // SCALE)
    return vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == dims) & F.forall("v", lambda c: F.coalesce(F.abs(c) < limit, F.lit(False))))


def _block_batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        x = np.floor(v * SCALE).astype("<i4")
        for at in range(0, len(x), BLOCK):
            ids = b.column(0).slice(at, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x[at : at + BLOCK].tobytes()])], names=["ids", "x"])


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centroids, int64) of integer vectors."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # every partial sum is an integer that a double holds
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    a = x.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in centroids.astype(np.int64)], axis=1)


def _own_distances(x: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> np.ndarray:
    return ((x.astype(np.int64) - centroids.astype(np.int64)[own]) ** 2).sum(1)


def displacements(history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each earlier round: how far each centroid is from where it was then; the largest of these, whose it is, and the second largest."""
    moved = np.sqrt(((history[:-1] - history[-1]).astype(np.float64) ** 2).sum(2))
    order = np.argsort(moved, axis=1)
    first = order[:, -1]
    rows = np.arange(len(moved))
    second = moved[rows, order[:, -2]] if moved.shape[1] > 1 else np.zeros(len(moved))
    return moved, first, np.stack([moved[rows, first], second], axis=1)


class Assigner:
    """One round's assignment of a block, given the centroids of all rounds so far (rounds x k x dimension)."""

    def __init__(self, history: np.ndarray) -> None:
        self.now, self.centroids = len(history) - 1, history[-1]
        if self.now:
            self.moved, self.most_by, self.most = displacements(history)
        self.rescanned = 0

    def first(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(x)
        own, up, low = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
        at = np.full(n, self.now, np.int32)
        self._scan(x, np.arange(n), own, up, low)
        return own, up, at, low, at.copy()

    def _scan(self, x: np.ndarray, rows: np.ndarray, own: np.ndarray, up: np.ndarray, low: np.ndarray) -> None:
        d = squared_distances(x[rows], self.centroids)
        best = d.argmin(axis=1)  # the smaller number of equals
        k = np.arange(len(rows))
        own[rows], up[rows] = best, np.sqrt(d[k, best].astype(np.float64))
        if d.shape[1] == 1:
            low[rows] = np.inf
        else:
            d[k, best] = np.iinfo(np.int64).max
            low[rows] = np.sqrt(d.min(axis=1).astype(np.float64))
        self.rescanned += len(rows)

    def again(self, x: np.ndarray, own: np.ndarray, up: np.ndarray, up_at: np.ndarray, low: np.ndarray, low_at: np.ndarray) -> None:
        """Updates the arrays of a block in place."""
        up_now = np.where(up_at < self.now, up + self.moved[np.minimum(up_at, self.now - 1), own], up)
        back = np.minimum(low_at, self.now - 1)
        low_now = low - self.most[back, (self.most_by[back] == own).astype(int)]
        doubt = np.flatnonzero(~(up_now * (1 + _MARGIN) + _MARGIN < low_now * (1 - _MARGIN)))
        if not len(doubt):
            return
        up[doubt] = np.sqrt(_own_distances(x[doubt], self.centroids, own[doubt]).astype(np.float64))
        up_at[doubt] = self.now
        doubt = doubt[~(up[doubt] * (1 + _MARGIN) + _MARGIN < low_now[doubt] * (1 - _MARGIN))]
        if len(doubt):
            self._scan(x, doubt, own, up, low)
            up_at[doubt] = low_at[doubt] = self.now


def _moves(x: np.ndarray, before: np.ndarray | None, own: np.ndarray, k: int) -> list[dict]:
    """What a block adds to the sums: per centroid the count (position -1) and the components."""
    dims = x.shape[1]
    total = np.zeros((k, dims + 1), np.int64)
    rows = np.arange(len(own)) if before is None else np.flatnonzero(before != own)
    wide = np.c_[np.ones(len(rows), np.int64), x[rows].astype(np.int64)]
    np.add.at(total, own[rows], wide)
    if before is not None:
        np.subtract.at(total, before[rows], wide)
    c, p = np.nonzero(total)
    return [{"cluster": i, "pos": j - 1, "v": v} for i, j, v in zip(c.tolist(), p.tolist(), total[c, p].tolist())]


def _assign_batches(batches: Iterator[pa.RecordBatch], history: np.ndarray) -> Iterator[pa.RecordBatch]:
    work, k, dims = Assigner(history), history.shape[1], history.shape[2]
    for b in batches:
        for i in range(b.num_rows):
            x = np.frombuffer(b.column(1)[i].as_buffer(), "<i4").reshape(-1, dims)
            if b.num_columns == 2:
                before, state = None, work.first(x)
            else:
                kinds = ("<i4", "<f8", "<i4", "<f8", "<i4")
                state = tuple(np.frombuffer(b.column(2 + j)[i].as_buffer(), kind).copy() for j, kind in enumerate(kinds))
                before = state[0].copy()
                work.again(x, *state)
            moved = pa.array([_moves(x, before, state[0], k)], _MOVED)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *(pa.array([s.tobytes()]) for s in state), moved], names=_NAMES)


def _row_batches(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            x = np.frombuffer(b.column(1)[i].as_buffer(), "<i4").reshape(-1, centroids.shape[1])
            own = np.frombuffer(b.column(2)[i].as_buffer(), "<i4")
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).flatten(), pa.array(own), pa.array(_own_distances(x, centroids, own))], names=["vec_id", "cluster", "distance"])


def _first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose hashed ids come first (k rows to the driver); a null id comes last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.withColumn("h", key).orderBy(F.col("h").asc_nulls_last(), "vec_id", "v").limit(k).collect()
    return np.array([[math.floor(SCALE * c) for c in r["v"]] for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, k: int, rounds: int, dims: int, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows of vec_id, cluster, distance; final centroids) after ``rounds`` rounds and one more assignment.

    Vectors of another length, with a null or non-finite component, or with a component whose scaled
    integer is ``LIMIT`` or more (its squared distance might not fit 64 bits) are left out. Fewer than ``k``
    vectors give as many centroids; none give an empty result. Repeated rows and ids stay repeated, equal
    vectors share a cluster, a null id stays null, other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dims, id_col, vector_col)
    first = _first_centroids(kept, k, seed)
    if not len(first):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), first
    blocks = store(kept.mapInArrow(partial(_block_batches, dims=dims), "ids array<long>, x binary"), "vector-blocks")
    history, sums = [first], [[0] * (dims + 1) for _ in range(len(first))]
    held: list[DataFrame] = []
    try:
        for r in range(rounds + 1):
            blocks = blocks.select("ids", "x", *_NAMES[2:7]) if r else blocks
            blocks = blocks.mapInArrow(partial(_assign_batches, history=np.stack(history)), _STATE)
            if r % CUT_EVERY == CUT_EVERY - 1:
                blocks = store(blocks, "assigned-blocks")
            held.append(blocks.persist(StorageLevel.MEMORY_AND_DISK))
            moved = blocks.select(F.explode("moved").alias("m")).groupBy("m.cluster", "m.pos").agg(F.sum(F.col("m.v").cast("decimal(38,0)")).alias("v")).collect()
            if len(held) > 1:
                held.pop(0).unpersist()
            if r == rounds:
                break
            for m in moved:
                sums[m["cluster"]][m["pos"] + 1] += int(m["v"])
            history.append(np.array([[s // n for s in rest] if n else old for (n, *rest), old in zip(sums, history[-1].tolist())], np.int64))
        rows = store(blocks.select(*_NAMES[:3]).mapInArrow(partial(_row_batches, centroids=history[-1]), "vec_id long, cluster int, distance long"), "clustered")
    finally:
        for df in held:
            df.unpersist()
    return rows, history[-1]


def clustering_report(vectors: DataFrame, k: int, rounds: int, dims: int, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256; cases as in ``cluster_vectors``.

    Sums beyond 64 bits are given as the largest long.
    """
    rows, centroids = cluster_vectors(vectors, k, rounds, dims, seed, id_col, vector_col)
    most = (1 << 63) - 1
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    facts = [(i, min(most, inertia.get(i, 0)), min(most, sum(inertia.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    about = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
