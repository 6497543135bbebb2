"""Comparisons of more participants than a matrix of distances would hold, and what they give by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import comparison


def many(spark, n=5_001):
    """Vectors of n participants, exact in binary, of which the first two are alike."""
    at = F.greatest(F.col("id"), F.lit(1))
    return spark.range(n).select(F.col("id").alias("participant"), F.array(*[(at * k % 1_024 + 1) / 8 for k in (7, 389, 641)]).alias("v"))


def plain(metric, x):
    if metric == "aitchison":
        logs = np.log(np.maximum(x, 1e-10))
        x = logs - logs.mean(1, keepdims=True)
    if metric == "cosine":
        lengths = np.linalg.norm(x, axis=1)
        return 1 - x @ x.T / np.where(np.outer(lengths, lengths) == 0, np.inf, np.outer(lengths, lengths))
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def check_distances(spark, metric):
    x = np.random.default_rng(3).random((40, 3)) * 50
    x[7], x[8] = 0, x[9]
    vectors = spark.createDataFrame([(f"p{i:02d}", v.tolist()) for i, v in enumerate(x)] + [(None, [1.0, 2.0, 3.0])], "participant string, v array<double>").repartition(5)
    got = {(r.a, r.b): r.d for r in comparison.distances(vectors, metric).collect()}
    want = plain(metric, x)
    assert len(got) == 40 * 39 // 2 and all(got[f"p{i:02d}", f"p{j:02d}"] == pytest.approx(want[i, j], abs=1e-7) for i in range(40) for j in range(i + 1, 40))
    out = comparison.distances(many(spark), metric).agg(F.count("d").alias("n"), F.min("d").alias("low"), F.min(F.col("b") - F.col("a")).alias("step"), F.max(F.col("b") - F.col("a")).alias("far")).first()
    assert (out.n, out.step, out.far) == (5_001 * 5_000 // 2, 1, 5_000) and out.low == pytest.approx(0, abs=1e-12)


def test_aitchison_distances_of_many(spark):
    check_distances(spark, "aitchison")


def test_cosine_distances_of_many(spark):
    check_distances(spark, "cosine")


def test_participant_distances_of_many(spark):
    check_distances(spark, "euclidean")


def test_distances_of_odd_vectors(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 2.0]), ("b", [1.0, None]), ("c", None), ("d", [1.0]), ("e", [4.0, 6.0])]
    vectors = spark.createDataFrame(rows, "participant string, v array<double>")
    got = sorted((r.a, r.b, r.d) for r in comparison.distances(vectors).where("d is not null").collect())
    assert [g[:2] for g in got] == [("a", "e")] * 2 and sorted(g[2] for g in got) == pytest.approx([17**0.5, 5])
    assert comparison.distances(vectors).count() == 14 and comparison.distances(vectors.limit(0)).count() == 0


def test_distance_summary(spark):
    rows = [("a", [0.0, 0.0]), ("b", [3.0, 4.0]), ("c", [3.0, 4.0]), ("d", [0.0, 0.0]), ("e", [6.0, 8.0]), ("f", [1.0, None]), (None, [9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "participant string, v array<double>").repartition(3)
    assert comparison.distance_summary(vectors).first()[:1] == (15,) and comparison.distance_summary(vectors).first().closest_b == "d"
    vectors = vectors.where("participant <> 'f'")
    for metric in ("euclidean", "cosine"):
        for some in (vectors, vectors.where("participant <> 'e'"), vectors.where("participant = 'a'")):
            assert comparison.distance_summary(some, metric).collect() == comparison.summarise(comparison.distances(some, metric)).collect()


def test_distance_summary_of_many(spark):
    out = comparison.distance_summary(many(spark)).first()
    x = np.array([r.v for r in many(spark).orderBy("participant").collect()])
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T))[np.triu_indices(len(x), 1)]
    assert (out.n_pairs, out.closest_a, out.closest_b) == (5_001 * 5_000 // 2, 0, 1)
    assert (out.mean, out.median, out.min, out.max) == (pytest.approx(d.mean()), pytest.approx(np.median(d)), 0, pytest.approx(d.max()))


def test_group_distances(spark):
    x = np.random.default_rng(4).random((30, 3))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "participant int, v array<double>")
    member = [(None if i % 10 == 9 else "gh"[i % 2] if i % 10 < 6 else "one" + str(i), i) for i in range(28)] + [("h", 0), ("h", 1), ("h", 99), ("none", 98)]
    groups = spark.createDataFrame(member, "group string, participant int")
    want: dict = {}
    for k, (g, i) in enumerate(member):
        for h, j in member[k + 1 :]:
            if g and h and i != j and max(i, j) < 30:
                want.setdefault((min(g, h), max(g, h)), []).append(plain("euclidean", x[[i, j]])[0, 1])
    got = {(r.group_a, r.group_b): (r.n_pairs, r["mean"]) for r in comparison.group_distances(vectors, groups).where("group_a is not null").collect()}
    assert all(got[k] == (len(v), pytest.approx(np.mean(v))) for k, v in want.items())
    assert {k for k in got if k not in want} == {(g, g) for g in {m[0] for m in member if m[0]}} - set(want) and got["none", "none"] == (0, 0)


def test_group_distances_of_many(spark):
    v = many(spark)
    groups = v.select(F.concat(F.lit("g"), F.col("participant") % 3).alias("group"), "participant")
    got = comparison.group_distances(v, groups).collect()
    assert len(got) == 6 and sum(r.n_pairs for r in got) == 5_001 * 5_000 // 2 and sum(r.n_pairs for r in got if r.kind == "within") == 3 * 1_667 * 1_666 // 2
    effect = comparison.effect_size(comparison.group_distances(v, groups)).first().effect_size
    assert effect == pytest.approx(np.mean([r["mean"] for r in got if r.kind == "between"]) / np.mean([r["mean"] for r in got if r.kind == "within"]))
    whole = comparison.distance_summary(v).first()
    assert sum(r.n_pairs * r["mean"] for r in got) / whole.n_pairs == pytest.approx(whole["mean"])


def shuffles(x, codes, n):
    """Effects of the shuffles of the legacy generator, by the matrix of distances."""
    d, old, k = plain("euclidean", x), np.random.RandomState(42), max(codes) + 1

    def effect(labels):
        hot = np.eye(k)[labels]
        sums, sizes = hot.T @ d @ hot, hot.sum(0)
        pairs, upper = sizes * (sizes - 1), np.triu_indices(k, 1)
        return (sums[upper] / np.outer(sizes, sizes)[upper]).mean() / (np.diag(sums)[pairs > 0] / pairs[pairs > 0]).mean()

    return effect(codes), [effect(old.permutation(codes)) for _ in range(n)]


def test_permutation_test(spark):
    x = np.random.default_rng(5).random((60, 3))
    names = sorted((["big"] * 31 + ["c", "d", "alone"] * 5 + ["e"] * 12 + ["f", "g"])[:60])
    names[0] = "a single one"
    names.sort()
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "participant int, v array<double>").repartition(3)
    groups = spark.createDataFrame([(g, i) for i, g in enumerate(names)] + [(None, 3), ("big", 999)], "group string, participant int")
    out = comparison.permutation_test(vectors, groups, n=50).first()
    observed, drawn = shuffles(x, np.unique(names, return_inverse=True)[1], 50)
    assert (out.observed, out.n, out.null_mean, out.null_sd) == (pytest.approx(observed), 50, pytest.approx(np.mean(drawn)), pytest.approx(np.std(drawn, ddof=1)))
    assert out.p == pytest.approx(np.mean(np.array(drawn) >= observed))


def test_permutation_test_of_many(spark):
    v = many(spark)
    groups = v.select(F.concat(F.lit("g"), F.when(F.col("participant") < 3_000, F.lit(0)).otherwise(F.col("participant") % 30)).alias("group"), "participant")
    out = comparison.permutation_test(v, groups, n=12).first()
    assert out.n == 12 and out.observed == pytest.approx(comparison.effect_size(comparison.group_distances(v, groups)).first().effect_size)
    assert out.null_mean == pytest.approx(1, abs=0.05)
