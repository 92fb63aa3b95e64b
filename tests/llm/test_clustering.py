"""Clustering with ns-bounds against plain rounds over all pairs, and against SQL."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartflow.llm import clustering, queries
from compare import connect, differences


def plain(ids, vectors, k, rounds):
    """Cluster and squared distance of each vector, the centroids, by measuring everything."""
    place = [hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in ids]
    centroids = vectors[sorted(range(len(ids)), key=lambda i: place[i])[:k]].copy()
    for n in range(rounds + 1):
        apart = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
        cluster = apart.argmin(1)
        for j in range(len(centroids)):
            if n < rounds and (cluster == j).any():
                centroids[j] = vectors[cluster == j].sum(0) // (cluster == j).sum()
    return cluster, apart.min(1), centroids


def frame(spark, vectors, scale=clustering.SCALE):
    rows = [(i, [float(x) / scale for x in v]) for i, v in enumerate(vectors.tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_the_query_equals_sql(spark, sample):
    found = queries.op11_ns_bounds(spark, sample)
    assert differences(found, queries.ORACLE_SQL["op11_ns_bounds"], connect(sample)) == []


@pytest.mark.parametrize("k, rounds, spread", [(16, 3, 40), (5, 8, 2), (1, 2, 9), (16, 0, 9)])
def test_random_vectors_with_ties(spark, k, rounds, spread):
    random = np.random.default_rng(k + rounds)
    middle = random.integers(-3 * spread, 3 * spread, (6, 64))
    vectors = middle[random.integers(0, 6, 600)] + random.integers(-spread, spread + 1, (600, 64))
    vectors[:50] = vectors[0]
    found = clustering.clusters(clustering.quantised(frame(spark, vectors)), k, rounds).toPandas().sort_values("vec_id")
    cluster, distance, centroids = plain(range(600), vectors, k, rounds)
    assert found.cluster.tolist() == cluster.tolist() and found.distance.tolist() == distance.tolist()
    assert set(found.inertia) == {distance.sum()}
    for j, rows in found.groupby("cluster"):
        assert set(rows.cluster_inertia) == {distance[cluster == j].sum()}
        digest = hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()
        assert set(rows.centroid_sha256) == {digest}


def test_bounds_spare_distances_and_use_the_total_displacement():
    random = np.random.default_rng(4)
    middle = random.integers(-400, 400, (8, 64))
    vectors = np.repeat(middle, 100, 0) + random.integers(-20, 21, (800, 64))
    step = clustering.Assignment(middle[None])
    state = step.first(vectors)
    assert step.measured == 800 * 8
    # There and back again: the total displacement is nothing, whatever the way was.
    history = np.stack([middle, middle + 5_000, middle])
    step = clustering.Assignment(history)
    after = step.next(vectors, state, False)
    assert step.measured == 0
    assert (after[0] == state[0]).all()
    step.next(vectors, state, True)
    assert step.measured == 800


def test_odd_vectors(spark):
    good = [0.5] * 64
    rows = [
        (1, good), (1, good), (None, [0.25] * 64), (2, None), (3, []), (4, [0.5] * 63), (5, [None, *good[1:]]),
        (6, [float("nan"), *good[1:]]), (7, [float("-inf"), *good[1:]]), (8, [3.0e38, *good[1:]]), (9, [-0.001] * 64),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    table = table.withColumn("cluster", F.lit("clash"))
    found = clustering.clusters(clustering.quantised(table)).collect()
    assert sorted(str(r.vec_id) for r in found) == ["1", "1", "8", "9", "None"]
    assert len({r.cluster for r in found if r.vec_id == 1}) == 1
    assert clustering.clusters(clustering.quantised(table.limit(0))).count() == 0
    assert clustering.clusters(clustering.quantised(table.where("vec_id = 2"))).count() == 0
