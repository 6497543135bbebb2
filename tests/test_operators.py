"""Operators without SQL against brute force, planted effects and invariants."""

import inspect
import math
import os
import random
import sys
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import rules as R
from textloom.functions import vectors as V
from textloom.operators import agreement, bayes, clustering, comparison, figurative, graphs, keyed, scores, similarity
from textloom.plans import relationship_queries, score_queries
from textloom.streaming import windows as stream

sys.path.insert(0, os.path.dirname(__file__))
import oracle  # noqa: E402


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_decision_rules(spark):
    cases = {"We decided to move": True, "We might move on": False, "Launch it now": True, "It rained today again": False, "no": False, "": False, None: False, "reduce all costs": True}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", R.is_decision(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == cases
    assert value(spark, R.strip_causes(F.lit("cut the budget because sales fell"))) == "cut the budget"
    assert value(spark, R.strip_causes(F.lit(" act  On account of  rain "))) == "act"
    assert not value(spark, R.is_factor(F.lit("build the big dam"), F.lit("build the big dam now")))
    assert value(spark, R.is_factor(F.lit("floods damaged homes"), F.lit("build a dam")))


def test_wording(spark):
    got = [value(spark, R.bayes_factor_wording(F.lit(x))) for x in (150.0, 5.0, 0.5, 0.001, float("nan"))]
    assert got == ["extreme evidence for H1 (groups differ)", "moderate evidence for H1", "anecdotal evidence for H0 (no difference)", "extreme evidence for H0", "undefined"]
    assert value(spark, R.alpha_wording(F.lit(0.7))) == "fair"
    assert value(spark, R.object_text(F.lit('<think>x</think>```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(spark, R.object_text(F.lit('"{\\"a\\": 1}"'))) == '{"a": 1}'


@pytest.mark.parametrize(("x", "y"), [([1.0, 5.0, 2.0], [2.0, 2.0, 9.0]), ([1.0, 2.0], [0.0, 4.0, 5.0])])
def test_wasserstein(spark, x, y):
    grid = sorted(x + y)
    want = sum((b - a) * abs(sum(v <= a for v in x) / len(x) - sum(v <= a for v in y) / len(y)) for a, b in zip(grid, grid[1:], strict=False))
    got = value(spark, V.wasserstein_1d(F.array(*map(F.lit, x)), F.array(*map(F.lit, y))))
    assert got == pytest.approx(want)


def test_t_quantile(spark):
    known = {1: 12.7062, 10: 2.2281, 30: 2.0423, 31: 2.0395, 60: 2.0003, 1000: 1.9623}
    rows = spark.createDataFrame([(k,) for k in known], "df int").select("df", scores.t_quantile(F.col("df")).alias("t")).collect()
    assert all(r.t == pytest.approx(known[r.df], abs=2e-4) for r in rows)


def test_ranks_within_hot_key(spark):
    rows = spark.range(5_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    ranked = keyed.rank_within(rows, "k", ["id"], "r")
    assert ranked.where("k = 0").select("r").distinct().count() == 1_667 and ranked.where("k = 0").agg(F.max("r")).first()[0] == 1_666
    assert ranked.where("k <> 0").agg(F.max("r")).first()[0] == 0


def test_hot_groups_are_split(spark):
    """A hot key's rows reach several tasks: adaptive execution sees two plain shuffles."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 200_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pay"))
        joined = keyed.join_groups(rows, rows.groupBy("k").agg(F.min("id").alias("low")), ["k"])
        counted = joined.select("k", "pay", F.spark_partition_id().alias("p")).toPandas()
        assert len(counted) == 200_000 and counted[counted.k == 7].p.nunique() > 2
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_null_keys_match_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    groups = spark.createDataFrame([(None, 5), ("a", 6)], "k string, v int")
    assert {(r.id, r.v) for r in keyed.join_groups(rows, groups, ["k"], "left").collect()} == {(1, None), (2, 6)}
    assert keyed.join_groups(rows, groups, ["k"]).count() == 1


def random_graph(spark, n=25, m=40, seed=2):
    rng = random.Random(seed)
    edges = sorted({tuple(rng.sample(range(n), 2)) for _ in range(m)})
    return edges, spark.createDataFrame([(i,) for i in range(n)], "id int"), spark.createDataFrame([(a, b, 1 + (a + b) % 3) for a, b in edges], "source int, target int, weight int")


def test_components(spark):
    edges, nodes, rows = random_graph(spark, 40, 25)
    root = list(range(40))
    for _ in range(40):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.id: r.component for r in graphs.components(nodes, rows).collect()} == dict(enumerate(root))
    chain = spark.range(300).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert graphs.components(spark.range(301), chain).agg(F.max("component")).first()[0] == 0


def test_pagerank(spark):
    edges, nodes, rows = random_graph(spark)
    n, total = 25, {a: sum(1 + (x + y) % 3 for x, y in edges if x == a) for a, _ in edges}
    rank = np.full(n, 1 / n)
    for _ in range(300):
        new = np.full(n, 0.15 / n + 0.85 * sum(rank[i] for i in range(n) if i not in total) / n)
        for a, b in edges:
            new[b] += 0.85 * rank[a] * (1 + (a + b) % 3) / total[a]
        rank = new
    got = {r.id: r["rank"] for r in graphs.pagerank(nodes, rows, tolerance=1e-9).collect()}
    assert np.allclose([got[i] for i in range(n)], rank) and sum(got.values()) == pytest.approx(1)
    assert graphs.pagerank(nodes.limit(0), rows.limit(0)).count() == 0
    alone = graphs.pagerank(nodes, rows.limit(0)).collect()
    assert all(r["rank"] == pytest.approx(1 / n) for r in alone) and len(alone) == nodes.count()


def test_pagerank_converges(spark):
    """A long cycle with a chord forgets its start slowly; the tolerance isn't multiplied by the number of nodes."""
    pairs = [(i, (i + 1) % 8) for i in range(8)] + [(8, 0), (0, 9)]
    n, m = 10, np.zeros((10, 10))
    for a, b in pairs:
        m[b, a] = 1 / sum(x == a for x, _ in pairs)
    m[:, 9] = 1 / n
    want = np.linalg.solve(np.eye(n) - 0.85 * m, np.full(n, 0.15 / n))
    edges, nodes = spark.createDataFrame([(a, b, 1) for a, b in pairs], "source int, target int, weight int"), spark.range(n)
    got = {r.id: r["rank"] for r in graphs.pagerank(nodes, edges, tolerance=1e-3).collect()}
    assert np.allclose([got[i] for i in range(n)], want, rtol=0, atol=6e-3)
    with pytest.raises(RuntimeError):
        graphs.pagerank(nodes, edges, tolerance=1e-3, at_once=2, most_rounds=2)


def test_registered_pagerank_is_converged(spark, tmp_path):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("e", "a"), ("a", "f")]
    spark.createDataFrame([(i, "t", 0, a, b, "leads to", None, None) for i, (a, b) in enumerate(pairs)], "rel_id long, text_id string, window_index int, source string, target string, type string, description string, group_name string").write.parquet(f"{tmp_path}/relationships.parquet")
    ids, m = "abcdef", np.zeros((6, 6))
    for a, b in pairs:
        m[ids.index(b), ids.index(a)] = 1 / sum(x == a for x, _ in pairs)
    m[:, 5] = 1 / 6
    want = np.linalg.solve(np.eye(6) - 0.85 * m, np.full(6, 0.15 / 6))
    got = {r.id: r["rank"] for r in relationship_queries.graph_pagerank(spark, str(tmp_path)).collect()}
    assert np.allclose([got[i] for i in ids], want, rtol=0, atol=1e-5)


def test_betweenness(spark):
    edges, nodes, rows = random_graph(spark, 12, 26)
    following = {i: [b for a, b in edges if a == i] for i in range(12)}
    score = dict.fromkeys(range(12), 0.0)
    for s, t in permutations(range(12), 2):
        paths, level = [], [[s]]
        while level and not paths:
            level = [p + [w] for p in level for w in following[p[-1]] if w not in p]
            paths = [p for p in level if p[-1] == t]
        for p in paths:
            for v in p[1:-1]:
                score[v] += 1 / len(paths)
    got = {r.id: r.betweenness for r in graphs.betweenness(nodes, rows).collect()}
    assert all(got[i] == pytest.approx(score[i] / (11 * 10)) for i in range(12))


def test_betweenness_of_relationships(spark, tmp_path):
    pairs = [("A", "b"), ("B ", "c"), ("c", "d")]
    spark.createDataFrame([(i, "t", 0, a, b, "leads to", None, None) for i, (a, b) in enumerate(pairs)], "rel_id long, text_id string, window_index int, source string, target string, type string, description string, group_name string").write.parquet(f"{tmp_path}/relationships.parquet")
    got = {r.id: r.betweenness for r in relationship_queries.relationship_betweenness(spark, str(tmp_path)).collect()}
    assert got == {"a": 0, "b": pytest.approx(2 / 6), "c": pytest.approx(2 / 6), "d": 0}


def test_similar_pairs_are_all_found(spark):
    rng = random.Random(9)
    base = ["water supply", "school meals", "night bus", "town charter", "tree planting"]
    labels = {w[: rng.randrange(3, len(w) + 1)] + rng.choice(["", "s", " x"]) for w in base for _ in range(12)} | {"a", ""}
    rows = spark.createDataFrame([(x,) for x in sorted(labels)] * 2 + [(None,)], "label string")
    for t in (0.5, 0.8):
        got = {(r.a, r.b) for r in similarity.similar_pairs(similarity.embed(rows), t).collect()}
        assert got == {(a, b) for a, b in combinations(sorted(labels), 2) if similarity.gram_cosine(a, b) >= t - 1e-9}


def test_dense_pairs(spark):
    x = np.random.default_rng(3).normal(size=(120, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in combinations(range(120), 2) if unit[i] @ unit[j] >= 0.7}
    assert {(r.a, r.b) for r in similarity.dense_pairs(rows, 0.7, "id", "v", block=50).collect()} == want


def test_nearest_of_every_query(spark):
    x = np.random.default_rng(4).normal(size=(150, 5))
    x[7], x[8] = x[50], 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    length = np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((y := x / np.where(length > 0, length, 1)) @ y.T, 12)
    want = {(q, i) for q in (0, 50, 100) for i in sorted(range(150), key=lambda i: (-s[q, i], i))[:10]}
    assert {(r.query, r.id) for r in similarity.nearest(rows.where("id % 50 = 0"), rows, "id", "v", block=2).collect()} == want


def test_wide_scores_have_every_run(spark, tmp_path):
    lines = [(1, 1, 1, r, float(q), 0.0, 0.0) for r, q in enumerate([1, 2, 3, 20, 30, 40, 50], 1)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    row = score_queries.wide_scores(spark, str(tmp_path)).first()
    assert (row.quantity_run7, row.quantity_median) == (50, 20)


def test_complete_link(spark):
    pairs = {("a", "b"): 0.95, ("b", "c"): 0.9, ("a", "c"): 0.5, ("c", "d"): 0.86}
    assert sorted(similarity.complete_link({k: v for k, v in pairs.items() if v >= 0.8}, list("abcd"), 0.8)) == [["a", "b"], ["c", "d"]]
    labels = spark.createDataFrame([(x,) for x in "abcde"], "label string")
    rows = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a string, b string, similarity double")
    got = {(r.cluster, r.label, r.avg_similarity, r.size) for r in similarity.cluster(labels, rows, 0.8).collect()}
    assert got == {("a", "a", 0.95, 2), ("a", "b", 0.95, 2), ("c", "c", 0.86, 2), ("c", "d", 0.86, 2), ("e", "e", 1.0, 1)}
    names = similarity.canonical(similarity.cluster(labels, rows, 0.8), spark.createDataFrame([("b", 5), ("d", 1), ("c", 1)], "label string, count int"))
    assert {(r.raw, r.canonical) for r in names.collect()} == {("a", "b"), ("b", "b"), ("c", "c"), ("d", "c"), ("e", "e")}


def test_leaders():
    same = lambda a, b: 1.0 if a[0] == b[0] else 0.0
    assert similarity.leaders(["a1", "b1", "a2", "b2"], [1, 1, 3, 1], same, 0.9) == [(2, [0, 2]), (1, [1, 3])]


def test_relevant_windows(spark):
    rows = spark.createDataFrame([("t", "d", 0, 0.9), ("t", "d", 1, 0.9), ("t", "d", 2, 0.6), ("t", "d", 3, 0.55), ("t", "e", 0, 0.1), ("t", "e", 1, 0.2)], "text_id string, decision string, window_index int, similarity double")
    got = {(r.decision, r.window_index) for r in similarity.relevant_windows(rows, 3, 0.5).collect()}
    assert got == {("d", 1), ("d", 0), ("d", 2), ("e", 1)}


@pytest.mark.parametrize(("text", "window", "want"), [
    ("a flood of tears", "It was a flood of tears.", ("exact", 7, 23)), ("a flood", "a flood, a flood", ("ambiguous", None, None)), ("aa", "aaa", ("ambiguous", None, None)),
    ("“A  Flood”", "Like a flood—yes", ("normalized_exact", 5, 12)), ("a flood of teats", "It was a flood of tears.", ("approximate", None, None)), ("quite else", "It was a flood", ("missing", None, None)),
    ("", "x", ("missing", None, None)), (None, None, ("missing", None, None)), ("it’s", "IT'S so", ("normalized_exact", 0, 4)),
])
def test_align(spark, text, window, want):
    row = spark.createDataFrame([(text, window)], "instance_text string, window_text string")
    r = figurative.align(row).first()
    assert (r.alignment_status, r.start_char, r.end_char) == want


def test_canonicalise(spark):
    w = ["One. It felt like a storm. Three.", "It felt like a storm. Three. Four.", "Other. It felt like a storm. End."]
    rows = [("t", 0, w[0], "It felt like a storm", "simile", 0.5), ("t", 1, w[1], "It felt like a storm", "Simile", 0.8), ("t", 0, w[0], "it felt like a storm", "simile", 0.9), ("t", 5, w[2], "It felt like a storm", "simile", 0.4), ("t", 5, w[2], "nowhere to be seen", "simile", 0.4)]
    df = spark.createDataFrame(rows, "text_id string, window_index int, window_text string, instance_text string, type string, confidence double")
    got = {(r.window_index, r.confidence, r.alignment_status, tuple(r.supporting_window_indices)) for r in figurative.canonicalise(figurative.align(df), 3, 1).collect()}
    assert got == {(0, 0.9, "normalized_exact", (0, 1)), (5, 0.4, "exact", (5,)), (5, 0.4, "missing", (5,))}


def test_shared_overlap():
    assert figurative.shared_overlap("abcab", "abx") == 2 and figurative.shared_overlap("", "a") == 0 and figurative.shared_overlap("aaa", "aaaa") == 3


def planted(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{g}{p}", f"e{e}", d, float(np.clip(rng.normal(m, 3), 0, 100))) for g, means in (("a", (80, 20, 20)), ("b", (20, 80, 20))) for p in range(5) for e in range(10) for d, m in zip("xyz", means, strict=True)]
    groups = spark.createDataFrame([(g, f"{g}{p}") for g in "ab" for p in range(5)], "group string, participant string")
    return spark.createDataFrame(rows, "participant string, entity string, dimension string, score double"), groups


def test_comparison(spark):
    s, groups = planted(spark)
    v = comparison.centroids(s, list("xyz"))
    out = comparison.permutation_test(v, groups, n=300).first()
    effect = comparison.effect_size(comparison.group_distances(v, groups)).first().effect_size
    assert effect > 5 and out.observed == pytest.approx(effect) and out.p < 0.05
    labels = {r.participant: r.label for r in clustering.hierarchical(comparison.distances(v)).collect()}
    assert len(set(labels.values())) == 2 and len({labels[f"a{p}"] for p in range(5)}) == 1
    assert {r.label for r in clustering.kmeans(v, 2).collect()} == {0, 1}
    _, loadings = clustering.pca(v, 3)
    ratios = [r.ratio for r in loadings.where("dimension = 0").orderBy("component").collect()]
    assert sum(ratios) == pytest.approx(1) and ratios[0] > 0.5
    place = {r.participant: (r.x, r.y) for r in clustering.classical_mds(comparison.distances(v)).collect()}
    for r in comparison.distances(v).collect():
        assert math.dist(place[r.a], place[r.b]) == pytest.approx(r.d, abs=3)


def test_agreement(spark):
    rows = [(f"u{u}", f"r{r}", float(10 * u)) for u in range(6) for r in range(3)]
    perfect = spark.createDataFrame(rows, "unit string, rater string, value double")
    assert agreement.krippendorff_alpha(perfect).first().alpha == pytest.approx(1)
    rng = random.Random(2)
    noisy = spark.createDataFrame([("d", f"p{p}", f"e{e}", r, float(e * 10 + rng.gauss(0, 5))) for p in range(4) for e in range(8) for r in range(3)], "dimension string, participant string, entity string, run int, score double")
    out = agreement.agreement(noisy, "participant", 200).first()
    assert out.ci_low <= out.alpha <= out.ci_high + 0.02 and out.n_units == 8
    assert agreement.krippendorff_alpha(perfect.limit(1)).first().alpha is None


def test_posterior(spark):
    rng = np.random.default_rng(4)
    rows = [("d", e, g, float(100 * rng.beta(m * 20, (1 - m) * 20))) for e, m in (("low", 0.25), ("high", 0.75)) for g in "ab" for _ in range(60)]
    data = bayes.prepare(spark.createDataFrame(rows, 'dimension string, entity string, `group` string, score double'), 0, 100)
    draws = bayes.sample(data, 2, 400, 400).cache()
    mean = {r.idx: r["mean"] for r in bayes.hdi(draws.where("param = 'theta'")).collect()}
    assert mean["high"] - mean["low"] == pytest.approx(2.2, abs=0.4)
    assert bayes.rhat(draws.where("param = 'kappa'")).first().rhat < 1.2
    shares = bayes.icc(draws).first()
    assert shares.entity_share + shares.group_share + shares.run_share == pytest.approx(1)
    assert bayes.diagnostics(draws).first().min_ess > 1
    c = bayes.contrasts(draws).first()
    assert c.low < 0.3 and c.high > -0.3


def test_streams(spark, tmp_path):
    texts = spark.createDataFrame([("a", "One. Two. Three. Four."), ("b", " ")], "text_id string, text string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    texts.write.parquet(str(tmp_path / "in"))
    q = stream.append_results(stream.window_stream(stream.text_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = {(r.text_id, r.window_index, r.window_text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0, "One. Two. Three."), ("a", 1, "Two. Three. Four.")}


def test_carried_stream(spark, tmp_path):
    rows = spark.createDataFrame([("t", 0, ["A"]), ("t", 1, ["b"]), ("t", 2, [])], "text_id string, window_index int, entities array<string>")
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.carried_entities(live, timeout_ms=None).writeStream.format("memory").queryName("carried").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120)
    assert {r.window_index: list(r.carried) for r in spark.table("carried").collect()} == {0: [], 1: ["A"], 2: ["A", "b"]}


@pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables")
def test_replicates_of_registered_queries(spark, monkeypatch):
    """As many as the reference takes by default."""
    class Stop(Exception):
        pass

    seen = {}
    for module, name, call in ((bayes, "sample", "posterior_draws"), (agreement, "bootstrap_alpha", "alpha_interval"), (agreement, "bootstrap_mean", "mean_interval"), (comparison, "permutation_test", "permutation_test"), (comparison, "sample_distances", "sample_distances")):
        signature = inspect.signature(getattr(module, name))

        def stop(*args, signature=signature, name=name, **more):
            bound = signature.bind(*args, **more)
            bound.apply_defaults()
            seen[name] = bound.arguments
            raise Stop

        with monkeypatch.context() as m, pytest.raises(Stop):
            m.setattr(module, name, stop)
            getattr(score_queries, call)(spark, oracle.FOLDER)
    assert [seen["sample"][x] for x in ("chains", "draws", "tune")] == [4, 2000, 1000]
    assert [seen[x]["n"] for x in ("bootstrap_alpha", "bootstrap_mean", "permutation_test")] == [1000, 10_000, 1000]
    assert seen["sample_distances"]["n_directions"] == 100


def test_complete_link_by_brute_force():
    rng = np.random.default_rng(12)
    for n in (2, 6, 15):
        names = [f"n{i:02d}" for i in range(n)]
        pairs = {(a, b): round(float(rng.random()), 2) for a, b in combinations(names, 2)}
        pairs = {k: v for k, v in pairs.items() if v >= 0.4}
        clusters = [[x] for x in names]
        likeness = lambda x, y: min(pairs.get((min(a, b), max(a, b)), 0.0) for a in x for b in y)
        while True:
            options = [(-likeness(x, y), x[0], y[0], i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j]
            s, _, _, i, j = min(options, default=(0, 0, 0, 0, 0))
            if -s < 0.4:
                break
            clusters[i] += clusters.pop(j)
        assert sorted(similarity.complete_link(pairs, names, 0.4)) == sorted(sorted(c) for c in clusters)


def test_rounds_leave_one_table(spark, tmp_path, monkeypatch):
    from textloom.plans import storage

    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path / "shared"))
    edges, nodes, rows = random_graph(spark)
    first = {r.id: r.component for r in graphs.components(nodes, rows).collect()}
    assert len(first) == nodes.count() and len([x for x in os.listdir(tmp_path / "shared") if x.startswith("rounds-")]) == 1
