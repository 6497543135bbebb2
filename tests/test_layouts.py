"""Layouts, density clusters, exact transport, cross-model tables, and small operators by hand."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators import bayes, clustering, comparison, layouts, scores
from textloom.operators import providers as P
from textloom.plans import pipelines as L
from textloom.sources import readers


@pytest.mark.parametrize(("n", "m"), [(4, 4), (2, 3), (3, 2), (1, 4), (5, 5)])
def test_exact_wasserstein(n, m):
    rng = np.random.default_rng(n * 10 + m)
    for _ in range(5):
        x, y = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))
        size = np.lcm(n, m)
        a, b = np.repeat(x, size // n, 0), np.repeat(y, size // m, 0)
        cost = ((a[:, None] - b[None]) ** 2).sum(-1)
        want = min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(size))) / size
        assert V.exact_wasserstein(x, y) == pytest.approx(np.sqrt(want))
    assert V.exact_wasserstein(x, x) == pytest.approx(0, abs=1e-6)


def test_exact_sample_distances(spark):
    rows = spark.createDataFrame([("a", [[1.0, 2.0, 3.0], [2.0, 2.0, 2.0]]), ("b", [[3.0, 1.0, 1.0]]), ("c", [[3.0, 1.0, 1.0]])], "participant string, rows array<array<double>>")
    d = {(r.a, r.b): r.d for r in comparison.sample_distances(rows, 3, exact=True).collect()}
    assert d["b", "c"] == pytest.approx(0, abs=1e-6) and d["a", "b"] == pytest.approx(d["a", "c"]) and d["a", "b"] > 0


def blobs():
    rng = np.random.default_rng(6)
    return np.concatenate([rng.normal(c, 0.05, (12, 2)) for c in ((0, 0), (1, 1), (0, 1))] + [np.array([[5.0, 5.0], [-4.0, 3.0]])])


def test_density_clusters(spark):
    x = blobs()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    labels, sure = clustering.density_labels(d, 4)
    assert [set(labels[12 * k : 12 * k + 12].tolist()) for k in range(3)] == [{0}, {1}, {2}] and labels[36:].tolist() == [-1, -1]
    assert sure[:36].min() > 0 and sure.max() <= 1 and sure[36:].max() == 0
    assert clustering.density_labels(d[:3, :3], 4)[0].tolist() == [-1] * 3
    same, _ = clustering.density_labels(np.zeros((8, 8)), 2)
    assert len(same) == 8
    pairs = spark.createDataFrame([(f"p{i:02d}", f"p{j:02d}", float(d[i, j])) for i in range(38) for j in range(i)], "b string, a string, d double")
    rows = clustering.hdbscan(pairs, 4).collect()
    assert {r.label for r in rows} == {-1, 0, 1, 2} and rows[0].silhouette > 0.8


def test_layouts(spark):
    nodes = spark.createDataFrame([(f"{k}{i}", w + f" {i}") for k, w in (("a", "heavy rainfall"), ("b", "city transport"), ("c", "zoo keepers quit")) for i in range(4)], "id string, label string")
    placed = layouts.semantic_layout(nodes)
    at = {r.id: np.array([r.x, r.y]) for r in placed.collect()}
    assert all(0 <= v <= 1 for p in at.values() for v in p) and np.hypot(*(at["a0"] - at["a1"])) < np.hypot(*(at["a0"] - at["b0"]))
    crowd = spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.5, 0.5), ("c", 0.51, 0.5), ("d", 0.0, 0.0), ("e", 1.0, 1.0)], "id string, x double, y double")
    xy = np.array([(r.x, r.y) for r in layouts.repel(crowd, 0.1, 200).collect()])
    gaps = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))[np.triu_indices(5, 1)]
    assert gaps.min() > 0.08 and xy.min() == 0 and xy.max() == 1
    found = {r.id: r.region for r in layouts.regions(placed, 3).collect()}
    assert found["a0"] == found["a3"] != found["b0"] and len(layouts.regions(placed, 3, "agglomerative").select("region").distinct().collect()) == 4
    assert layouts.repel(crowd.limit(0)).count() == 0 and layouts.regions(crowd.limit(2), 3).select("region").distinct().count() == 1
    out = L.named_regions(nodes, P.RuleProvider())
    assert out["positions"].count() == 12 and {r.name[:4] for r in out["regions"].collect()} <= {"heav", "city", "zoo "}


def test_across_models(spark):
    long = spark.createDataFrame([("m1", "x", 1.0), ("m1", "x", 3.0), ("m2", "x", 2.0), ("m2", "y", 5.0), ("m3", "y", 9.0)], "model string, condition string, alpha double")
    got = {r.condition: (r.m1, r.m2, r.spread, r.best) for r in scores.across_models(long, ["condition"], ["m1", "m2"], "alpha").collect()}
    assert got == {"x": (2.0, 2.0, 0.0, "m1"), "y": (None, 5.0, 0.0, "m2")}


def test_model_summary(spark):
    rel = spark.createDataFrame([("m", "0-100", "v2", "d", 0.9, 0.1), ("m", "1-5", "v2", "d", 0.7, 0.3), ("n", "1-5", "v1", "d", 0.5, 0.2)], "model string, scale string, prompt string, dimension string, alpha double, avg_cv double")
    rho = spark.createDataFrame([("m", 0.8), ("m", 0.6)], "model string, rho double")
    res = spark.createDataFrame([("m", "0-100", "v2", "d", 4.0, 1.0), ("m", "1-5", "v2", "d", 2.0, 30.0)], "model string, scale string, prompt string, dimension string, entropy_bits double, ceiling_pct double")
    eff = spark.createDataFrame([("m", "0-100", "v2", 0.85, 120.4)], "model string, scale string, prompt string, quality_index double, mean_time_ms double")
    got = {r.model: r for r in scores.model_summary(rel, rho, res, eff, ["d"], "0-100", "v2", "1-5").collect()}
    m = got["m"]
    assert (m.alpha_d, m.cv_d, m.alpha_min_all, m.alpha_max_all, m.mean_rho, m.quality_index, m.time_ms_per_entity, m.entropy_d, m.ceiling_pct_d) == (0.9, 0.1, 0.7, 0.9, 0.7, 0.85, 120.0, 4.0, 30.0)
    assert got["n"].alpha_d is None and got["n"].mean_rho is None


def test_elbow_and_leaves(spark):
    x = blobs()[:36]
    vectors = spark.createDataFrame([(f"p{i:02d}", v.tolist()) for i, v in enumerate(x)], "participant string, v array<double>")
    rows = {r.k: r for r in clustering.elbow(vectors, 5).collect()}
    assert max(rows.values(), key=lambda r: r.silhouette).k == 3 and rows[3].inertia < rows[2].inertia
    order = clustering.leaf_order(comparison.distances(vectors))
    assert sorted(order) == [f"p{i:02d}" for i in range(36)] and [int(p[1:]) // 12 for p in order].count(0) == 12
    assert sum(a // 12 != b // 12 for a, b in zip([int(p[1:]) for p in order], [int(p[1:]) for p in order][1:], strict=False)) == 2


def test_distances_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(comparison, "MOST_PARTICIPANTS", 3)
    vectors = spark.createDataFrame([(str(i), [float(i)]) for i in range(4)], "participant string, v array<double>")
    with pytest.raises(ValueError):
        comparison.distances(vectors)
    assert comparison.distances(vectors.limit(3)).count() == 3


def test_average_ranks_over_ranges(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 400, 3_000)
    rows = spark.createDataFrame([("k", int(v), i) for i, v in enumerate(x)] + [("k", None, -1), (None, 3, -2)], "k string, v int, i int").repartition(7)
    got = {r.i: r["rank"] for r in scores.average_rank(rows, ["k"], "v").collect()}
    order = np.sort(x)
    assert all(got[i] == (np.searchsorted(order, v) + 1 + np.searchsorted(order, v, "right")) / 2 for i, v in enumerate(x)) and got[-1] is None and got[-2] is None


def test_marginal_contrasts(spark):
    rows = []
    for draw in range(200):
        rows += [("d", 0, draw, "theta", f"e{e}", 0.1 * e) for e in range(3)] + [("d", 0, draw, "group", g, v + 0.001 * draw) for g, v in (("a", 0.0), ("b", 1.0))]
    draws = spark.createDataFrame(rows, "dimension string, chain int, draw int, param string, idx string, value double")
    got = bayes.marginal_contrasts(draws, 0, 100, 1.0).collect()
    want = [np.mean([100 / (1 + np.exp(-(0.1 * e + v + 0.0995))) for e in range(3)]) for v in (0.0, 1.0)]
    assert len(got) == 1 and any(abs(abs(x) - (want[1] - want[0])) < 0.2 for x in got[0] if isinstance(x, float))


def test_row_numbers_and_columns(spark, tmp_path):
    spark.createDataFrame([(f"text {i}",) for i in range(50)], "text string").coalesce(1).write.csv(str(tmp_path / "t"), header=True)
    rows = readers.texts(spark, str(tmp_path / "t")).collect()
    assert {r.text_id: r.text for r in rows} == {str(i + 1): f"text {i}" for i in range(50)}
    with pytest.raises(ValueError):
        readers.pick_columns(["text", "id"], key="other")
    assert readers.pick_columns(["text", "id"]) == ("text", "id") and F.lit(1) is not None


def beta_data(spark, shift):
    rng = np.random.default_rng(5)
    rows = []
    for e in range(6):
        for k in range(8):
            group = "ab"[k % 2]
            centre = 1 / (1 + np.exp(-(0.2 * e - 0.5 + shift * (group == "b") + 0.1 * rng.normal())))
            rows += [("d", f"e{e}", f"p{k}", group, float(y)) for y in np.clip(rng.beta(centre * 40, (1 - centre) * 40, 6), 1e-4, 1 - 1e-4)]
    return spark.createDataFrame(rows, "dimension string, entity string, participant string, group string, y double")


def test_model_comparison(spark):
    options = {"chains": 2, "draws": 300, "tune": 300}
    apart = bayes.compare_models(beta_data(spark, 1.0), **options).first()
    alike = bayes.compare_models(beta_data(spark, 0.0), **options).first()
    assert apart.difference > 50 and abs(alike.difference) < 10 and apart.se_full > 0


def test_offsets(spark):
    draws = bayes.sample(beta_data(spark, 0.5), chains=2, draws=200, tune=300, offsets=True)
    params = {r.param: r.m for r in draws.groupBy("param").agg(F.avg("value").alias("m")).collect()}
    assert set(params) == {"theta", "group", "kappa", "sigma_entity", "sigma_group", "sigma_participant"} and 0 < params["sigma_participant"] < 0.6
    assert "sigma_participant" not in {r.param for r in bayes.sample(beta_data(spark, 0.5), 1, 20, 20).select("param").distinct().collect()}
