"""Clusters and maps from vectors alone are those of the matrix of distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import clustering, comparison


def drawn(spark, n=60, seed=6):
    x = np.random.default_rng(seed).random((n, 3)) * 10
    x[5] = x[6] = x[7]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "participant int, v array<double>").repartition(3), x


def many(spark, n=5_001):
    """Three groups of vectors far from each other, by the rest of the id."""
    noise = lambda k: (F.col("id") * k % 997) / 1_000
    return spark.range(n).select(F.col("id").alias("participant"), F.array(F.col("id") % 3 * 40 + noise(7), F.pow(F.col("id") % 3, 2) * 30 + noise(389), noise(641)).alias("v"))


def whole_parts(rows) -> bool:
    return len({(int(r.participant) % 3, r.label) for r in rows}) == 3 == len({r.label for r in rows})


def test_ward_from_vectors(spark):
    for n in (1, 2, 3, 60):
        vectors, x = drawn(spark, max(n, 8))
        vectors, x = vectors.where(F.col("participant") < n), x[:n]
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        assert [m[2] for m in clustering.ward(x)] == pytest.approx([m[2] for m in clustering.linkage(d)], abs=1e-9)
        for k in (None, 4):
            got = {r.participant: (r.label, pytest.approx(r.silhouette)) for r in clustering.hierarchical_vectors(vectors, k, 6).collect()}
            want = {r.participant: (r.label, r.silhouette) for r in clustering.hierarchical(comparison.distances(vectors), k, most_k=6).collect()}
            assert want == got or n == 1


def test_participant_clusters_of_many(spark):
    rows = clustering.hierarchical_vectors(many(spark), most_k=6).collect()
    assert len(rows) == 5_001 and whole_parts(rows) and rows[0].silhouette > 0.9


def test_similarity_map_of_many(spark):
    for n in (0, 1, 2, 60):
        vectors = drawn(spark, max(n, 8))[0].where(F.col("participant") < n)
        got = {r.participant: (r.x, r.y) for r in clustering.vector_map(vectors).collect()}
        want = {r.participant: (pytest.approx(r.x, abs=1e-6), pytest.approx(r.y, abs=1e-6)) for r in clustering.classical_mds(comparison.distances(vectors)).collect()}
        assert got == want or n == 1 and got == {"0": (0, 0)}
    assert clustering.vector_map(many(spark)).count() == 5_001


def test_participant_kmeans_of_many(spark):
    rows = clustering.kmeans(many(spark), 3).collect()
    assert len(rows) == 5_001 and whole_parts(rows)
    x = np.array([r.v for r in many(spark, 90).orderBy("participant").collect()])
    labels = [np.arange(90) % 3, np.arange(90) // 45, np.minimum(np.arange(90), 1), np.zeros(90, int), np.arange(90)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert clustering.silhouettes(spark, x, labels) == pytest.approx([*[clustering.silhouette(d, lab) for lab in labels[:3]], -1, -1])
