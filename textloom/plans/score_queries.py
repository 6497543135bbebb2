"""Queries on scores, agreement, comparison and posteriors, with their SQL.

The star schema stands for a study: order lines are runs; an order or part is an entity, a supplier a participant, a nation a
group; quantity, discount and tax are dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators import agreement as A
from textloom.operators import bayes as B
from textloom.operators import clustering as K
from textloom.operators import comparison as C
from textloom.operators import scores as S
from textloom.plans.storage import materialise
from textloom.sources.tables import table

DIMENSIONS = ["quantity", "discount", "tax"]
RUNS = 7


def _long(spark: SparkSession, folder: str) -> DataFrame:
    """(entity, participant, run, dimension, score): three dimensions of every order line."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    dim = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("score"))
    each = F.array(dim("quantity", F.col("l_quantity")), dim("discount", F.round(F.col("l_discount") * 500, 0)), dim("tax", F.round(F.col("l_tax") * 600, 0)))
    return l.select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("participant"), F.col("l_orderkey").alias("text_id"), F.col("l_linenumber").alias("run"), F.inline(each))


_LONG = """
long as (
    select l_partkey as entity, l_suppkey as participant, l_orderkey as text_id, l_linenumber as run, unnest([
        {'dimension': 'quantity', 'score': l_quantity}, {'dimension': 'discount', 'score': round(l_discount * 500, 0)}, {'dimension': 'tax', 'score': round(l_tax * 600, 0)}], recursive := true)
    from lineitem
)"""


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def run_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every order's quantities; unrounded digits could fall either way, so they are compared at one place."""
    s = S.run_statistics(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_quantity").alias("score")), ["entity"], 0, 100)
    return s.select("entity", "n", "median", "mode")


def run_means(spark: SparkSession, folder: str) -> DataFrame:
    s = S.run_statistics(_long(spark, folder), ["dimension", "participant"], 0, 100)
    return s.select("dimension", "participant", "n", "mean", "median", "std", "ci_low", "ci_high", "cv")


def justifications(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", F.col("event_id").alias("run"), F.col("value").alias("score"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("justification"))
    return S.representative_justification(rows, ["user_id"])


def dataset_statistics(spark: SparkSession, folder: str) -> DataFrame:
    means = _long(spark, folder).groupBy("dimension", "entity").agg(F.avg("score").alias("mean"))
    return _rounded(S.dataset_statistics(means))


def primary_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    means = _long(spark, folder).groupBy("dimension", "entity").agg(F.avg("score").alias("mean"))
    return S.primary_dimension(means, ["entity"], DIMENSIONS)


def wide_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All seven runs of an order, and medians over them."""
    runs = _long(spark, folder).groupBy("text_id", "dimension", "run").agg(F.max("score").alias("score")).withColumn("justification", F.lit(""))
    w = S.to_wide(runs, ["text_id"], DIMENSIONS, RUNS)
    return w.select("text_id", *[f"{d}_run{r}" for d in DIMENSIONS for r in range(1, RUNS + 1)], *[f"{d}_median" for d in DIMENSIONS])


def _fractions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_type", "user_id", F.least(F.col("value") / 50, F.lit(1.0)).alias("x"))


_FRACTIONS = "f as (select event_type, user_id, least(value / 50, 1.0) as x from events)"


def descriptives(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.descriptives(_fractions(spark, folder), ["event_type"], "x"), 5)


def reliability(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.reliability(_long(spark, folder), ["dimension"], "entity"), 5)


def resolution(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.resolution(_fractions(spark, folder), ["event_type"], "x"))


def quintiles(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.bin_shares(_fractions(spark, folder), ["event_type"], "x"))


def average_ranks(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").withColumn("level", F.round(F.col("c_acctbal") / 100))
    return S.average_rank(c, ["c_nationkey"], "level").select("c_custkey", F.col("rank").cast("double").alias("rank"))


def empirical_cdf(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.empirical_cdf(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity"))


def pareto_frontier(spark: SparkSession, folder: str) -> DataFrame:
    return S.pareto_frontier(table(spark, folder, "part"), ["p_brand"], "p_size", "p_retailprice").select("p_brand", "p_size", "p_retailprice")


def spearman(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.spearman(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 5)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.avg("l_quantity").alias("q"))
    wide = p.groupBy("l_partkey").agg(F.max(F.when(F.col("l_returnflag") == "A", F.col("q"))).alias("base"), F.max(F.when(F.col("l_returnflag") == "N", F.col("q"))).alias("variant"))
    return wide.where("base is not null and variant is not null").select((F.col("l_partkey") % 5).alias("k"), F.round("base", 4).alias("base"), F.round("variant", 4).alias("variant"))


_PAIRS = """
p as (select l_partkey, l_returnflag, avg(l_quantity) as q from lineitem group by 1, 2),
pairs as (select l_partkey % 5 as k, round(base, 4) as base, round(variant, 4) as variant from (
    select l_partkey, max(q) filter (where l_returnflag = 'A') as base, max(q) filter (where l_returnflag = 'N') as variant from p group by 1) where base is not null and variant is not null)"""


def variant_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.variant_metrics(_pairs(spark, folder), ["k"], "base", "variant"), 9)


def wilcoxon(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.wilcoxon(_pairs(spark, folder), ["k"], "base", "variant"), 5)


def friedman(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_quantity"), 2).alias("q"))
    return _rounded(S.friedman(rows, "l_suppkey", "l_returnflag", "q"), 4)


def holm(spark: SparkSession, folder: str) -> DataFrame:
    tests = table(spark, folder, "nation").select("n_nationkey", ((F.col("n_nationkey") * 7 % 25 + 1) / 500).alias("p"))
    return _rounded(S.holm_bonferroni(tests))


def interaction(spark: SparkSession, folder: str) -> DataFrame:
    cells = table(spark, folder, "lineitem").where("l_returnflag in ('A', 'N')")
    return _rounded(S.interaction(cells, "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", ("A", "N"), ("F", "O")))


def alpha_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(A.krippendorff_alpha(A.run_level(_long(spark, folder)), ["dimension"]))


def alpha_participants(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(A.krippendorff_alpha(A.participant_level(_long(spark, folder)), ["dimension"]))


def alpha_sample_variance(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(A.krippendorff_alpha(A.run_level(_long(spark, folder)), ["dimension"], variant="sample_var"))


def alpha_interval(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "events").select(F.lit("value").alias("dimension"), F.col("user_id").alias("entity"), F.col("event_type").alias("participant"), F.col("event_id").alias("run"), F.col("value").alias("score"))
    return A.agreement(s, "participant")


def mean_interval(spark: SparkSession, folder: str) -> DataFrame:
    return A.bootstrap_mean(table(spark, folder, "supplier"), ["s_nationkey"], "s_acctbal")


def _centroids(spark: SparkSession, folder: str) -> DataFrame:
    return C.centroids(_long(spark, folder), DIMENSIONS)


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    return table(spark, folder, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("group"), F.col("s_suppkey").alias("participant"))


_CENTROIDS = _LONG + """, c as (select participant, avg(score) filter (where dimension = 'quantity') as q, avg(score) filter (where dimension = 'discount') as d, avg(score) filter (where dimension = 'tax') as t from long group by 1),
v as (select participant, [q, d, t] as v from c), gr as (select n_name as "group", s_suppkey as participant from supplier join nation on s_nationkey = n_nationkey)"""
_DISTANCES = _CENTROIDS + ", e as (select a.participant as a, b.participant as b, list_distance(a.v, b.v) as d from v a join v b on a.participant < b.participant)"
_CLR = """, logs as (select participant, list_transform(v, lambda x: ln(greatest(x, 1e-10) / list_sum(list_transform(v, lambda y: greatest(y, 1e-10))))) as l from v),
clr as (select participant, list_transform(l, lambda x: x - list_avg(l)) as v from logs)"""


def participant_centroids(spark: SparkSession, folder: str) -> DataFrame:
    v = _centroids(spark, folder)
    return v.select("participant", *[F.round(F.col("v")[i], 6).alias(d) for i, d in enumerate(DIMENSIONS)])


def participant_distances(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(C.distances(materialise(_centroids(spark, folder))))


def cosine_distances(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(C.distances(materialise(_centroids(spark, folder)), "cosine"))


def aitchison_distances(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(C.distances(materialise(_centroids(spark, folder)), "aitchison"))


def log_ratios(spark: SparkSession, folder: str) -> DataFrame:
    v = _centroids(spark, folder).select("participant", V.clr(F.col("v")).alias("c"), V.ilr(F.col("v"), 3).alias("i"))
    return v.select("participant", *[F.round(F.col("c")[k], 6).alias(f"clr{k}") for k in range(3)], *[F.round(F.col("i")[k], 6).alias(f"ilr{k}") for k in range(2)])


def ternary_points(spark: SparkSession, folder: str) -> DataFrame:
    v = _centroids(spark, folder).select("participant", V.ternary(*[F.col("v")[i] for i in range(3)]).alias("p"))
    return _rounded(v.select("participant", "p.x", "p.y"))


def distance_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(C.distance_summary(materialise(_centroids(spark, folder))))


def group_distances(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(C.group_distances(materialise(_centroids(spark, folder)), _groups(spark, folder)))


def group_effect(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(C.effect_size(C.group_distances(materialise(_centroids(spark, folder)), _groups(spark, folder))))


def group_centroids(spark: SparkSession, folder: str) -> DataFrame:
    g = C.group_centroids(_centroids(spark, folder), _groups(spark, folder), 3)
    return g.select("group", *[F.round(F.col("v")[i], 6).alias(d) for i, d in enumerate(DIMENSIONS)])


def permutation_test(spark: SparkSession, folder: str) -> DataFrame:
    return C.permutation_test(_centroids(spark, folder), _groups(spark, folder))


def sample_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Nations by their suppliers' centroids, by the sliced Wasserstein distance."""
    rows = _centroids(spark, folder).join(_groups(spark, folder), "participant").groupBy(F.col("group").alias("participant")).agg(F.collect_list("v").alias("rows"))
    return C.sample_distances(materialise(rows), 3)


def common_parts(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem")  # noqa: E741
    return C.common_entities(l, "l_returnflag", "l_partkey")


def aligned_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = _long(spark, folder).join(_groups(spark, folder), "participant").drop("participant").withColumnRenamed("group", "participant")
    return C.aligned(s).groupBy("participant", "dimension").agg(F.count(F.lit(1)).alias("cells"), F.count_if("present").alias("present"), F.round(F.avg("score"), 6).alias("mean"))


def ellipses(spark: SparkSession, folder: str) -> DataFrame:
    v = _centroids(spark, folder).join(_groups(spark, folder), "participant")
    return _rounded(C.confidence_ellipse(v, ["group"], F.col("v")[0], F.col("v")[1]), 4)


def shrinkage(spark: SparkSession, folder: str) -> DataFrame:
    """Parts' raw means, and the same drawn half way to a fixed score."""
    raw = _long(spark, folder).groupBy("dimension", "entity").agg(F.avg("score").alias("raw_mean"))
    return _rounded(B.shrinkage(raw, raw.select("dimension", "entity", (F.col("raw_mean") / 2 + 12).alias("mean"))), 5)


def bayes_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Differences of line quantities from a reference, by return flag; flags stand for pairs of groups."""
    rows = table(spark, folder, "lineitem").select("l_returnflag", ((F.col("l_quantity") - 20) / 10).alias("value"))
    return _rounded(B.bayes_factor(rows, ["l_returnflag"], 1.0), 5)


def quality_indices(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return rows.groupBy("l_linenumber").agg(F.round(S.quality_index(rows, "l_discount", "l_tax"), 6).alias("quality")).toDF("k", "quality")


def participant_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return K.hierarchical_vectors(_centroids(spark, folder), most_k=6).select("participant", "label")


def participant_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return K.kmeans(_centroids(spark, folder), 4).select("participant", "label")


def principal_components(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(K.pca(_centroids(spark, folder))[1])


def similarity_map(spark: SparkSession, folder: str) -> DataFrame:
    return K.vector_map(materialise(_centroids(spark, folder)))


def beta_observations(spark: SparkSession, folder: str) -> DataFrame:
    return B.prepare(_long(spark, folder), 0, 60).groupBy("dimension", "participant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("mean_y"), F.round(F.min("y"), 6).alias("min_y"))


def posterior_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled: 4 chains of 2,000 draws, after 1,000 of warm-up, of brands' order quantities by nation of the supplier."""
    l, p, s = (table(spark, folder, t) for t in ("lineitem", "part", "supplier"))
    rows = l.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey)
    scores = rows.select(F.lit("quantity").alias("dimension"), F.col("p_brand").alias("entity"), (F.col("s_nationkey") % 3).cast("string").alias("group"), F.col("l_quantity").alias("score"))
    return B.rhat(materialise(B.sample(B.prepare(scores, 0, 51), 4, 2000, 1000)))


def _draws(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines read as draws: chain by line status, draw by order, group by return flag."""
    l = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f) for f in ("A", "N", "R")]).where("A is not null and N is not null and R is not null")  # noqa: E741
    rows = l.select((F.col("l_orderkey") % 2).cast("int").alias("chain"), F.col("l_orderkey").alias("draw"), F.explode(F.create_map(*[x for f in ("A", "N", "R") for x in (F.lit(f), F.col(f))])).alias("idx", "value"))
    return rows.select(F.lit("q").alias("dimension"), "chain", "draw", F.lit("group").alias("param"), "idx", (F.col("value") / 50 - 0.5).alias("value"))


_DRAWS = """
o as (select l_orderkey, max(l_quantity) filter (where l_returnflag = 'A') as "A", max(l_quantity) filter (where l_returnflag = 'N') as "N", max(l_quantity) filter (where l_returnflag = 'R') as "R" from lineitem group by 1),
draws as (select (l_orderkey % 2)::int as chain, l_orderkey as draw, idx, q / 50 - 0.5 as value from (unpivot (select * from o where "A" is not null and "N" is not null and "R" is not null) on "A", "N", "R" into name idx value q))"""


def posterior_hdi(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(B.hdi(_draws(spark, folder)).select("idx", "mean", "sd", "hdi_low", "hdi_high"))


def posterior_contrasts(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(B.contrasts(_draws(spark, folder)).drop("dimension"))


def posterior_rhat(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(B.rhat(_draws(spark, folder)).select("idx", "rhat"))


def queries() -> dict:
    found = [
        run_statistics, run_means, justifications, dataset_statistics, primary_dimensions, wide_scores, descriptives, reliability, resolution, quintiles, average_ranks, empirical_cdf, pareto_frontier, spearman,
        variant_metrics, wilcoxon, friedman, holm, interaction, alpha_runs, alpha_participants, alpha_sample_variance, alpha_interval, mean_interval, participant_centroids, participant_distances, cosine_distances,
        aitchison_distances, log_ratios, ternary_points, distance_summary, group_distances, group_effect, group_centroids, permutation_test, sample_distances, common_parts, aligned_scores, ellipses,
        shrinkage, bayes_factors, quality_indices, participant_clusters, participant_kmeans, principal_components, similarity_map, beta_observations, posterior_draws, posterior_hdi, posterior_contrasts, posterior_rhat,
    ]
    return {f.__name__: f for f in found}


def _alpha_sql(units: str, variant: str = "pooled") -> str:
    expected = "2 * (sum(s2) - sum(s1) * sum(s1) / sum(n)) / sum(n)" if variant == "pooled" else "(sum(s2) - sum(s1) * sum(s1) / sum(n)) / (sum(n) - 1)"
    return f"""with {_LONG}, units as ({units}), a as (select dimension, count(*) filter (where n >= 2) as n_units,
        1 - (sum(2 * (n * s2 - s1 * s1)) filter (where n >= 2) / sum(n * (n - 1)) filter (where n >= 2)) / ({expected}) as alpha from units group by 1)
        select dimension, round(alpha, 6) as alpha, n_units, case when alpha >= 0.9 then 'excellent' when alpha >= 0.8 then 'good' when alpha >= 0.67 then 'fair' when alpha >= 0.5 then 'moderate' else 'poor' end as interpretation from a"""


def oracle_sql() -> dict[str, str]:
    t = ", ".join(map(str, S.T_975))
    tq = f"case when n - 1 <= 30 then ([{t}])[(n - 1)::int] else z + (z**3 + z) / 4 / (n - 1) + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (n - 1)**2 + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (n - 1)**3 end"
    runs = "select dimension, participant, entity, count(*) as n, sum(score) as s1, sum(score * score) as s2 from long group by 1, 2, 3"
    people = "select dimension, entity, count(*) as n, sum(m) as s1, sum(m * m) as s2 from (select dimension, entity, participant, avg(score) as m from long group by 1, 2, 3) group by 1, 2"
    ranks = "rank() over (partition by {k} order by {v}) + (count(*) over (partition by {k}, {v}) - 1) / 2"
    dist = "select a, b, round(d, 6) as d from e"
    grouped = _DISTANCES + """, named as (select e.d, x."group" as ga, y."group" as gb from e join gr x on x.participant = a join gr y on y.participant = b),
        stats as (select 'within' as kind, g."group" as group_a, g."group" as group_b, coalesce(n_pairs, 0) as n_pairs, coalesce(mean, 0.0) as mean from (select distinct "group" from gr) g
            left join (select ga, count(*) as n_pairs, avg(d) as mean from named where ga = gb group by 1) w on w.ga = g."group"
            union all select 'between', least(ga, gb), greatest(ga, gb), count(*), avg(d) from named where ga <> gb group by all)"""
    ks = "select k, max(abs(fa - fb)) as ks from (select k, v, sum(a) over w / sum(a) over (partition by k) as fa, sum(b) over w / sum(b) over (partition by k) as fb from (select k, v, sum(a) as a, sum(b) as b from (select k, base as v, 1 as a, 0 as b from pairs union all select k, variant, 0, 1 from pairs) group by 1, 2) window w as (partition by k order by v)) group by 1"
    return {
        "run_statistics": """with c as (select l_orderkey as entity, l_quantity as score, count(*) as times from lineitem group by 1, 2), m as (select *, max(times) over (partition by entity) as most from c),
            mode as (select entity, round(quantile_cont(score, 0.5), 2) as mode from m where times = most group by 1)
            select l_orderkey as entity, count(*) as n, round(quantile_cont(l_quantity, 0.5), 2) as median, any_value(mode.mode) as mode from lineitem join mode on entity = l_orderkey group by 1""",
        "run_means": f"""with {_LONG}, s as (select dimension, participant, count(*) as n, avg(score) as mean, quantile_cont(score, 0.5) as median, coalesce(stddev_samp(score), 0) as std, 1.959963984540054::double as z from long group by 1, 2),
            c as (select *, case when n > 1 then ({tq}) * std / sqrt(n) else 0 end as margin from s)
            select dimension, participant, n, """ + ", ".join(f"round(({x})::decimal(30, 13), 2)::double as {name}" for name, x in (("mean", "mean"), ("median", "median"), ("std", "std"), ("ci_low", "greatest(0, mean - margin)"), ("ci_high", "least(100, mean + margin)")))
            + ", round((case when mean > 0 then std / mean else 0 end)::decimal(30, 13), 4)::double as cv from c",
        "justifications": """with e as (select user_id, event_id, event_type, abs(value - avg(value) over (partition by user_id)) as d from events)
            select user_id, coalesce(arg_min(event_type, (d, event_id)) filter (where event_type <> 'view'), '') as justification from e group by 1""",
        "dataset_statistics": f"""with {_LONG}, m as (select dimension, entity, avg(score) as mean from long group by 1, 2) select dimension, count(*) as n, round(avg(mean), 6) as mean, round(quantile_cont(mean, 0.5), 6) as median,
            round(stddev_samp(mean), 6) as std, round(min(mean), 6) as min, round(max(mean), 6) as max from m group by 1""",
        "primary_dimensions": f"""with {_LONG}, m as (select dimension, entity, avg(score) as mean from long group by 1, 2)
            select entity, dimension as primary_dimension from m qualify row_number() over (partition by entity order by mean desc, list_position(['quantity', 'discount', 'tax'], dimension)) = 1""",
        "wide_scores": f"with {_LONG}, r as (select text_id, dimension, run, max(score) as score from long group by 1, 2, 3) select text_id, "
            + ", ".join(f"max(score) filter (where dimension = '{d}' and run = {r}) as {d}_run{r}" for d in DIMENSIONS for r in range(1, RUNS + 1)) + ", "
            + ", ".join(f"round(quantile_cont(score, 0.5) filter (where dimension = '{d}'), 2) as {d}_median" for d in DIMENSIONS) + " from r group by 1",
        "descriptives": f"""with {_FRACTIONS}, m as (select event_type, avg(x) as a, stddev_pop(x) as s from f group by 1) select f.event_type, count(*) as n, round(avg(x), 5) as mean, round(stddev_samp(x), 5) as sd, round(quantile_cont(x, 0.5), 5) as median,
            round(avg(((x - a) / s) ** 3), 5) as skew, round(avg(((x - a) / s) ** 4) - 3, 5) as kurtosis, round(100 * avg((x <= 0.05)::int), 5) as floor_pct, round(100 * avg((x >= 0.95)::int), 5) as ceiling_pct from f join m using (event_type) group by 1""",
        "reliability": f"""with {_LONG}, p as (select dimension, entity, avg(score) as m, coalesce(stddev_samp(score), 0) as s from long group by 1, 2)
            select dimension, round(avg(case when m > 0 then s / m else 0 end), 5) as mean_cv, round(stddev_samp(m) / avg(s), 5) as snr from p group by 1""",
        "resolution": f"""with {_FRACTIONS}, b as (select event_type, least(floor(x * 20), 19)::int as bin, count(*) as c from f where x between 0 and 1 group by 1, 2), p as (select event_type, c / sum(c) over (partition by event_type) as p from b)
            select event_type, any_value(levels) as levels, round(-sum(p * log2(p)), 6) as entropy from p join (select event_type, count(distinct x) as levels from f group by 1) using (event_type) group by 1""",
        "quintiles": f"with {_FRACTIONS}, b as (select event_type, least(floor(x * 5), 4)::int as bin, count(*) as c from f where x between 0 and 1 group by 1, 2) select event_type, bin, round(c / sum(c) over (partition by event_type), 6) as share from b",
        "average_ranks": f"with c as (select c_custkey, c_nationkey, round(c_acctbal / 100) as level from customer) select c_custkey, {ranks.format(k='c_nationkey', v='level')} as rank from c",
        "empirical_cdf": "with c as (select l_returnflag, l_quantity, count(*) as c from lineitem group by 1, 2) select l_returnflag, l_quantity, round(sum(c) over (partition by l_returnflag order by l_quantity) / sum(c) over (partition by l_returnflag), 6) as cdf from c",
        "pareto_frontier": """with b as (select p_brand, p_size, max(p_retailprice) as p_retailprice from part group by 1, 2), w as (select *, max(p_retailprice) over (partition by p_brand order by p_size rows between unbounded preceding and 1 preceding) as before from b)
            select p_brand, p_size, p_retailprice from w where before is null or p_retailprice > before""",
        "spearman": f"with r as (select l_returnflag, {ranks.format(k='l_returnflag', v='l_quantity')} as x, {ranks.format(k='l_returnflag', v='l_extendedprice')} as y from lineitem) select l_returnflag, count(*) as n, round(corr(x, y), 5) as rho from r group by 1",
        "variant_metrics": f"""with {_PAIRS}, r as (select k, {ranks.format(k='k', v='base')} as x, {ranks.format(k='k', v='variant')} as y from pairs), ks as ({ks})
            select k, count(*) as n, round(avg(variant - base), 9) as mean_delta, round(quantile_cont(variant - base, 0.5), 9) as median_delta, round(avg(abs(variant - base)), 9) as mae, round(sqrt(avg((variant - base) ** 2)), 9) as rmse,
            round(corr(base, variant), 9) as pearson, any_value(round(rho, 9)) as spearman, any_value(round(ks.ks, 9)) as ks from pairs join (select k, corr(x, y) as rho from r group by 1) using (k) join ks using (k) group by 1""",
        "wilcoxon": f"""with {_PAIRS}, d as (select k, base - variant as d, abs(base - variant) as a from pairs where base <> variant), r as (select *, {ranks.format(k='k', v='a')} as r from d),
            ties as (select k, sum(c ** 3 - c) as ties from (select k, a, count(*) as c from d group by 1, 2) group by 1), s as (select k, count(*) as n, sum(case when d > 0 then r else 0 end) as up, sum(r) as total from r group by 1),
            w as (select k, n, least(up, total - up) as w, ties from s join ties using (k)),
            zs as (select *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) as z from w), ts as (select *, 1 / (1 + 0.2316419 * abs(z)) as t from zs)
            select k, n, w, round(z, 5) as z, round(2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))), 5) as p, round(1 - 2 * w / (n * (n + 1) / 2), 5) as r from ts""",
        "friedman": f"""with q as (select l_suppkey, l_returnflag, round(avg(l_quantity), 2) as q from lineitem group by 1, 2), w as (select *, count(*) over (partition by l_suppkey) as c from q), r as (select *, {ranks.format(k='l_suppkey', v='q')} as r from w where c = 3),
            s as (select l_returnflag, sum(r) as s, count(*) as b from r group by 1), ties as (select sum(c ** 3 - c) as t from (select count(*) as c from r group by l_suppkey, q))
            select any_value(b)::bigint as blocks, 3 as treatments, round((12 * sum(s * s) / (any_value(b) * 12) - 12 * any_value(b)) / (1 - any_value(t) / (any_value(b) * 24)), 4) as statistic, 2 as df from s, ties""",
        "holm": """with t as (select n_nationkey, (n_nationkey * 7 % 25 + 1) / 500 as p from nation), r as (select *, row_number() over (order by p, n_nationkey) as k from t)
            select n_nationkey, round(p, 6) as p, round(least(1.0, max(p * (26 - k)) over (order by k)), 6) as p_adjusted from r""",
        "interaction": """with c as (select l_suppkey, avg(l_quantity) filter (where l_returnflag = 'A' and l_linestatus = 'F') as af, avg(l_quantity) filter (where l_returnflag = 'A' and l_linestatus = 'O') as ao,
            avg(l_quantity) filter (where l_returnflag = 'N' and l_linestatus = 'F') as nf, avg(l_quantity) filter (where l_returnflag = 'N' and l_linestatus = 'O') as no from lineitem group by 1)
            select l_suppkey, round((no - ao) - (nf - af), 6) as contrast from c where no is not null and ao is not null and nf is not null and af is not null""",
        "alpha_runs": _alpha_sql(runs),
        "alpha_participants": _alpha_sql(people),
        "alpha_sample_variance": _alpha_sql(runs, "sample"),
        "participant_centroids": f"with {_CENTROIDS} select participant, round(q, 6) as quantity, round(d, 6) as discount, round(t, 6) as tax from c",
        "participant_distances": f"with {_DISTANCES} {dist}",
        "cosine_distances": f"with {_CENTROIDS} select a.participant as a, b.participant as b, round(1 - list_cosine_similarity(a.v, b.v), 6) as d from v a join v b on a.participant < b.participant",
        "aitchison_distances": f"with {_CENTROIDS}{_CLR} select a.participant as a, b.participant as b, round(list_distance(a.v, b.v), 6) as d from clr a join clr b on a.participant < b.participant",
        "log_ratios": f"""with {_CENTROIDS}{_CLR} select participant, round(v[1], 6) as clr0, round(v[2], 6) as clr1, round(v[3], 6) as clr2, round(sqrt(0.5) * (v[1] - v[2]), 6) as ilr0, round(sqrt(2 / 3) * ((v[1] + v[2]) / 2 - v[3]), 6) as ilr1 from clr""",
        "ternary_points": f"with {_CENTROIDS} select participant, round((d + t / 2) / (q + d + t), 6) as x, round(t * sqrt(3) / 2 / (q + d + t), 6) as y from c",
        "distance_summary": f"""with {_DISTANCES} select count(*) as n_pairs, round(avg(d), 6) as mean, round(quantile_cont(d, 0.5), 6) as median, round(min(d), 6) as min, round(max(d), 6) as max,
            arg_min(a, (d, a, b)) as closest_a, arg_min(b, (d, a, b)) as closest_b, arg_min(a, (-d, a, b)) as farthest_a, arg_min(b, (-d, a, b)) as farthest_b from e""",
        "group_distances": f"with {grouped} select kind, group_a, group_b, n_pairs, round(mean, 6) as mean from stats",
        "group_effect": f"with {grouped} select round(avg(mean) filter (where kind = 'between') / avg(mean) filter (where kind = 'within' and n_pairs > 0), 6) as effect_size from stats",
        "group_centroids": f'with {_CENTROIDS} select "group", round(avg(q), 6) as quantity, round(avg(d), 6) as discount, round(avg(t), 6) as tax from c join gr using (participant) group by 1',
        "common_parts": "select l_partkey from lineitem group by 1 having count(distinct l_returnflag) = (select count(distinct l_returnflag) from lineitem)",
        "aligned_scores": f"""with {_CENTROIDS}, s as (select "group" as participant, entity, dimension, avg(score) as score from long join gr using (participant) group by all), cells as (select distinct entity, dimension from s), p as (select distinct participant from s)
            select p.participant, c.dimension, count(*) as cells, count(s.score) as present, round(avg(coalesce(s.score, 0)), 6) as mean from cells c cross join p left join s on s.participant = p.participant and s.entity = c.entity and s.dimension = c.dimension group by 1, 2""",
        "ellipses": f"""with {_CENTROIDS}, s as (select "group", avg(q) as cx, avg(d) as cy, var_samp(q) as a, var_samp(d) as b, covar_samp(q, d) as c, count(*) as n from c join gr using (participant) group by 1)
            select "group", round(cx, 4) as cx, round(cy, 4) as cy, round(sqrt(5.991 * ((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c ** 2))), 4) as major, round(sqrt(5.991 * greatest(0, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c ** 2))), 4) as minor,
                round(degrees(atan2((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c ** 2) - a, c)), 4) as angle from s where n > 1""",
        "shrinkage": f"""with {_LONG}, r as (select dimension, entity, avg(score) as raw_mean from long group by 1, 2), g as (select *, raw_mean / 2 + 12 as mean, avg(raw_mean) over (partition by dimension) as grand from r)
            select dimension, entity, round(raw_mean, 5) as raw_mean, round(mean, 5) as mean, round(grand, 5) as grand,
                round(case when abs(raw_mean - grand) <= 1 then 0 else least(greatest(100 * (1 - abs(mean - grand) / abs(raw_mean - grand)), 0), 100) end, 5) as shrinkage_pct from g""",
        "bayes_factors": """with d as (select l_returnflag, (l_quantity - 20) / 10 as v from lineitem), h as (select l_returnflag, stddev_samp(v) * pow(count(*), -0.2) as h from d group by 1),
            p as (select l_returnflag, avg(exp(-(v / h) * (v / h) / 2) / (h * sqrt(2 * pi()))) as post from d join h using (l_returnflag) group by 1), b as (select l_returnflag, 1 / sqrt(2 * pi()) / post as bf from p)
            select l_returnflag, round(bf, 5) as bf10, case when bf >= 100 then 'extreme evidence for H1 (groups differ)' when bf >= 30 then 'very strong evidence for H1' when bf >= 10 then 'strong evidence for H1' when bf >= 3 then 'moderate evidence for H1'
                when bf >= 1 then 'anecdotal evidence for H1' when bf >= 1 / 3 then 'anecdotal evidence for H0 (no difference)' when bf >= 1 / 10 then 'moderate evidence for H0' when bf >= 1 / 30 then 'strong evidence for H0'
                when bf >= 1 / 100 then 'very strong evidence for H0' else 'extreme evidence for H0' end as interpretation from b""",
        "quality_indices": "select l_linenumber as k, round(sqrt(greatest(avg(l_discount) * avg(l_tax), 0)), 6) as quality from lineitem group by 1",
        "beta_observations": f"""with {_LONG}, y as (select *, least(greatest((least(greatest(score / 60, 0), 1) * (n - 1) + 0.5) / n, 1e-6), 1 - 1e-6) as y from (select *, count(*) over (partition by dimension) as n from long))
            select dimension, participant, count(*) as n, round(avg(y), 6) as mean_y, round(min(y), 6) as min_y from y group by 1, 2""",
        "posterior_hdi": f"""with {_DRAWS}, r as (select idx, value, row_number() over (partition by idx order by value) as r, count(*) over (partition by idx) as n from draws),
            s as (select x.idx, x.value as low, y.value as high from r x join r y on y.idx = x.idx and y.r = x.r + floor(x.n * 0.94)::int qualify row_number() over (partition by x.idx order by y.value - x.value, x.value) = 1)
            select idx, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(any_value(low), 6) as hdi_low, round(any_value(high), 6) as hdi_high from draws join s using (idx) group by 1""",
        "posterior_contrasts": f"""with {_DRAWS}, d as (select a.idx as a, b.idx as b, b.value - a.value as d from draws a join draws b on a.chain = b.chain and a.draw = b.draw and a.idx < b.idx)
            select a, b, round(avg(d), 6) as mean, round(avg((d > 0)::int), 6) as p_positive, round(avg((abs(d) <= 0.1)::int), 6) as p_rope, round(quantile_cont(d, 0.03), 6) as low, round(quantile_cont(d, 0.97), 6) as high from d group by 1, 2""",
        "posterior_rhat": f"""with {_DRAWS}, c as (select idx, chain, avg(value) as m, var_samp(value) as v, count(*) as n from draws group by 1, 2), s as (select idx, avg(v) as w, coalesce(var_samp(m), 0) as b, avg(n) as n from c group by 1)
            select idx, round(sqrt(((n - 1) / n * w + b) / w), 6) as rhat from s""",
    }
