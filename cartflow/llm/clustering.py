"""Exact k-means on integer vectors with ns-bounds.

Every vector carries an upper bound of the distance to its centroid and a lower bound of the distance to each other
one, together with the round in which each was measured. The centroids of all rounds are kept, so that a bound is
loosened by how far its centroid is now from where it stood when the bound was measured: the norm of the total
displacement, never more than the sum of the drifts of the rounds between. Only centroids whose loosened bound does
not exceed the upper bound are measured again, in integers. A round is one pass over the stored vectors without a
shuffle, and one aggregate with a row per centroid and task.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; components
are cut to +-2^27 after scaling, so that a squared distance fits into a long; equal distances go to the centroid of the
smaller number; a centroid without vectors stays where it is; rows without an id are assigned and averaged like others
but never chosen as a first centroid; rows that repeat an id count each, and among equal hashes the smaller vector comes
first; with fewer rows with an id than `k` there are so many centroids; without any there are no rows; sums of
distances beyond a long are null; columns other than `vec_id` and `embedding` are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import materialize, ship_package

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
LIMIT = 1 << 27
# Bounds are square roots in floating point: they are widened by far more than these can err.
SLACK = 1e-9


def quantised(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * x) of the components of usable vectors."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), wide.alias("x"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = rows.where((F.size("x") == size) & ~F.exists("x", odd))
    cut = lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * scale))).cast("int")
    return usable.select("vec_id", F.transform("x", cut).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The vectors of the k smallest hashes of their ids, in this order."""
    place = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").select(place.alias("place"), "v").orderBy("place", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Lists of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(len(column), -1)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid, or to one of their own each."""
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


class Assignment:
    """The assignment of one round, given the centroids of all rounds so far: `history[round, centroid, component]`."""

    def __init__(self, history: np.ndarray):
        self.history, self.now = history, len(history) - 1
        moved = np.sqrt(((history - history[-1]).astype(float) ** 2).sum(2))
        # moved[round, centroid]: from its place then to its place now.
        self.moved = moved * (1 + SLACK)
        self.measured = 0  # distances computed, for tests

    def distances(self, vectors: np.ndarray, centroid: int) -> np.ndarray:
        self.measured += len(vectors)
        return squared(vectors, self.history[-1, centroid])

    def first(self, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """cluster, squared distance, lower bounds and their rounds, with everything measured."""
        found = np.stack([self.distances(vectors, j) for j in range(self.history.shape[1])], 1)
        cluster = found.argmin(1)
        low = np.sqrt(found.astype(float)) * (1 - SLACK)
        return cluster, found[np.arange(len(found)), cluster], low, np.full(found.shape, self.now, np.int32)

    def next(self, vectors: np.ndarray, state: tuple[np.ndarray, ...], last: bool) -> tuple[np.ndarray, ...]:
        """The same from the state of the round before. Rows whose bounds still separate stay as they are, with the
        distance of an earlier round; in the `last` one all own distances are measured."""
        cluster, distance, low, when = (x.copy() for x in state)
        rows, numbers = np.arange(len(vectors)), np.arange(self.history.shape[1])
        reach = np.sqrt(distance.astype(float)) * (1 + SLACK) + self.moved[when[rows, cluster], cluster]
        loose = low - self.moved[when, numbers[None]]
        loose[rows, cluster] = np.inf
        stale = rows if last else np.flatnonzero(loose.min(1) <= reach)
        for j in np.unique(cluster[stale]):
            mine = stale[cluster[stale] == j]
            distance[mine] = self.distances(vectors[mine], j)
            low[mine, j], when[mine, j] = np.sqrt(distance[mine].astype(float)) * (1 - SLACK), self.now
        reach = np.sqrt(distance.astype(float)) * (1 + SLACK)
        for j in numbers:
            # `reach` shrinks as nearer centroids are found, so later ones have less to measure.
            at = stale[loose[stale, j] <= reach[stale]]
            found = self.distances(vectors[at], j)
            low[at, j], when[at, j] = np.sqrt(found.astype(float)) * (1 - SLACK), self.now
            nearer = (found < distance[at]) | ((found == distance[at]) & (j < cluster[at]))
            at, found = at[nearer], found[nearer]
            distance[at], cluster[at], reach[at] = found, j, np.sqrt(found.astype(float)) * (1 + SLACK)
        return cluster, distance, low, when


STATE = "vec_id bigint, v array<int>, cluster int, distance bigint, low array<double>, seen array<int>"


def assigned(state: DataFrame, history: np.ndarray, last: bool = False) -> DataFrame:
    """The vectors with the state of this round. No shuffle; what is sent along is rounds x centroids."""
    ship_package(state.sparkSession)

    def lists(values: np.ndarray) -> pa.Array:
        ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))

    def run(batches):
        step = Assignment(history)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch["v"], np.int64)
            if step.now == 0:
                found = step.first(vectors)
            else:
                bounds = matrix(batch["low"], float), matrix(batch["seen"], np.int32)
                found = step.next(vectors, (batch["cluster"].to_numpy(), batch["distance"].to_numpy(), *bounds), last)
            cluster, distance, low, when = found
            columns = [batch["vec_id"], lists(vectors.astype(np.int32)), pa.array(cluster.astype(np.int32))]
            columns += [pa.array(distance), lists(low), lists(when.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "distance", "low", "seen"])

    return state.mapInArrow(run, STATE)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means; one row per centroid comes back."""
    size = centroids.shape[1]
    sums = [F.sum(F.element_at("v", i + 1).cast("bigint")).alias(f"s{i}") for i in range(size)]
    new = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return new


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The stored final state of every vector, and the final centroids, from (vec_id, v) of vectors of one length."""
    stored = materialize(vectors, "vectors")
    centroids = first_centroids(stored, k)
    history = centroids[None]
    if not len(centroids):
        return stored.sparkSession.createDataFrame([], STATE), centroids
    state = materialize(assigned(stored, history), "assigned")
    for left in range(rounds - 1, -1, -1):
        history = np.concatenate([history, moved_centroids(state, history[-1])[None]])
        state = materialize(assigned(state, history, left == 0), "assigned")
    return state, history[-1]


def total(distance: str) -> Column:
    return F.sum(F.col(distance).cast("decimal(38,0)"))


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per vector."""
    state, centroids = fit(vectors, k, rounds)
    sums = {r["cluster"]: int(r["n"]) for r in state.groupBy("cluster").agg(total("distance").alias("n")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    whole = fits(sum(sums.values()))
    named = [
        (j, fits(sums[j]), whole, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j in sums
    ]
    facts = state.sparkSession.createDataFrame(
        named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    # One row per centroid.
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
