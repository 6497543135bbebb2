"""Scores of entities over runs: statistics per entity and dimension, over data sets and over experiment conditions.

Long form: text_id, entity, window_index, group, dimension, run, score, justification. Wide form: one row per entity with
columns {dimension}_run1.., {dimension}_mean and so on. Missing scores are null, never NaN.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.vectors import scale_fraction
from textloom.operators.keyed import join_groups, running_total

# 97.5 % quantiles of Student's t for 1 to 30 degrees of freedom.
T_975 = [
    12.706204736, 4.30265273, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852,
    2.20098516, 2.17881283, 2.160368656, 2.144786688, 2.131449546, 2.119905299, 2.109815578, 2.10092204, 2.093024054, 2.085963447,
    2.079613845, 2.073873068, 2.06865761, 2.063898562, 2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
]


def t_quantile(df: Column) -> Column:
    """97.5 % quantile of Student's t: by table up to 30 degrees of freedom, beyond by the expansion around the normal."""
    z = 1.959963984540054
    tail = (
        F.lit(z) + (z**3 + z) / 4 / df + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / F.pow(df, 2)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / F.pow(df, 3)
    )
    table = F.array(*[F.lit(t) for t in T_975])
    return F.when(df.between(1, len(T_975)), F.get(table, (df - 1).cast("int"))).otherwise(tail)


def run_statistics(scores: DataFrame, keys: Sequence[str], scale_min: float = 0, scale_max: float = 100) -> DataFrame:
    """Per key: n, mean, median, mode (median of all tied modes), std (0 for one score), ci_low and ci_high (95 %, clamped to
    the scale; the score itself for one), cv (0 where the mean isn't positive). Null scores don't count; keys without any
    score have none. Rounded to 2 places, cv to 4."""
    known = scores.where("score is not null")
    by_value = known.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("times"))
    modes = by_value.withColumn("most", F.max("times").over(Window.partitionBy(*keys))).where("times = most")
    mode = modes.groupBy(*keys).agg(F.percentile("score", F.lit(0.5)).alias("mode"))
    s = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.percentile("score", F.lit(0.5)).alias("median"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"),
    ).join(mode, list(keys))
    margin = F.when(F.col("n") > 1, t_quantile(F.col("n") - 1) * F.col("std") / F.sqrt("n")).otherwise(0.0)
    low = F.when(F.col("n") > 1, F.greatest(F.lit(float(scale_min)), F.col("mean") - margin)).otherwise(F.col("mean"))
    high = F.when(F.col("n") > 1, F.least(F.lit(float(scale_max)), F.col("mean") + margin)).otherwise(F.col("mean"))
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0)
    return s.select(
        *keys, "n", *[F.round(c, 2).alias(c) for c in ("mean", "median", "mode", "std")], F.round(low, 2).alias("ci_low"), F.round(high, 2).alias("ci_high"), F.round(cv, 4).alias("cv"),
    )


def representative_justification(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the non-blank justification whose score is closest to the mean, the first run on ties; '' if there is none."""
    mean = F.avg("score").over(Window.partitionBy(*keys))
    near = scores.withColumn("_d", F.abs(F.col("score") - mean))
    said = F.trim(F.coalesce("justification", F.lit(""))) != ""
    return near.groupBy(*keys).agg(F.coalesce(F.min_by("justification", F.when(said, F.struct("_d", "run"))), F.lit("")).alias("justification"))


def dataset_statistics(means: DataFrame) -> DataFrame:
    """Per dimension over the entities' means: n, mean, median, std (sample), min, max. `means`: dimension, mean."""
    return means.groupBy("dimension").agg(
        F.count("mean").alias("n"), F.avg("mean").alias("mean"), F.percentile("mean", F.lit(0.5)).alias("median"),
        F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("std"), F.min("mean").alias("min"), F.max("mean").alias("max"),
    )


def primary_dimension(means: DataFrame, keys: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """Per key the dimension of the highest mean; the one listed first on ties."""
    place = F.array_position(F.array(*[F.lit(d) for d in dimensions]), F.col("dimension"))
    return means.groupBy(*keys).agg(F.max_by("dimension", F.struct("mean", -place)).alias("primary_dimension"))


def dimensions_of(columns: Sequence[str]) -> list[str]:
    return [c.removesuffix("_mean") for c in columns if c.endswith("_mean")]


def to_long(wide: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Wide to long, one row per dimension and run: keys, dimension, run, score. Scores that can't be read are null; with
    `strict` they raise an error."""
    runs = [(m[1], int(m[2]), c) for c in wide.columns if (m := re.fullmatch(r"(.+)_run(\d+)", c))]
    read = lambda c: F.coalesce(F.col(c).try_cast("double"), F.raise_error(F.concat(F.lit(f"{c} has no score: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("double")) if strict else F.col(c).try_cast("double")
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(r).alias("run"), read(c).alias("score")) for d, r, c in runs])
    return wide.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


def to_wide(scores: DataFrame, keys: Sequence[str], dimensions: Sequence[str], runs: int, scale_min: float = 0, scale_max: float = 100) -> DataFrame:
    """Long to wide: per dimension the runs and statistics. Dimensions are given, so the pivot needs no extra pass."""
    stats = run_statistics(scores, [*keys, "dimension"], scale_min, scale_max)
    spoken = representative_justification(scores, [*keys, "dimension"])
    names = ["mean", "median", "mode", "std", "ci_low", "ci_high", "cv"]
    pick = lambda c, d: F.max(F.when(F.col("dimension") == d, F.col(c)))
    of_stats = stats.join(spoken, [*keys, "dimension"]).groupBy(*keys).agg(*[pick(c, d).alias(f"{d}_{c}") for d in dimensions for c in [*names, "justification"]])
    of_runs = scores.groupBy(*keys).agg(*[F.max(F.when((F.col("dimension") == d) & (F.col("run") == r), F.col("score"))).alias(f"{d}_run{r}") for d in dimensions for r in range(1, runs + 1)])
    order = [*keys, *[f"{d}_{c}" for d in dimensions for c in [*[f"run{r}" for r in range(1, runs + 1)], *names, "justification"]]]
    return of_runs.join(of_stats, list(keys)).select(*order)


def with_fraction(scores: DataFrame, low: float, high: float) -> DataFrame:
    return scores.withColumn("fraction", scale_fraction(F.col("score"), low, high, clamp=False))


def descriptives(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: n, mean, sd (sample), median, skew and excess kurtosis (population), floor_pct (<= 0.05) and ceiling_pct
    (>= 0.95) in percent."""
    v = F.col(value)
    return values.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.percentile(v, F.lit(0.5)).alias("median"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"),
        (100 * F.avg((v <= 0.05).cast("double"))).alias("floor_pct"), (100 * F.avg((v >= 0.95).cast("double"))).alias("ceiling_pct"),
    )


def reliability(scores: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """Per key: mean_cv of the runs and snr, the spread of entity means over the mean spread within; infinite if none."""
    per = scores.where("score is not null").groupBy(*keys, entity).agg(F.avg("score").alias("m"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("s"))
    total = per.groupBy(*keys).agg(F.avg(F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0)).alias("mean_cv"), F.stddev_samp("m").alias("between"), F.avg("s").alias("within"))
    return total.select(*keys, "mean_cv", F.when(F.col("within") > 0, F.col("between") / F.col("within")).otherwise(F.lit(float("inf"))).alias("snr"))


def bin_of(value: Column, n: int) -> Column:
    """Equal bins of [0, 1], numbered from 0; the last one is closed at 1; null outside."""
    return F.when(value.between(0, 1), F.least(F.floor(value * n), F.lit(n - 1)).cast("int"))


def resolution(values: DataFrame, keys: Sequence[str], value: str, bins: int = 20) -> DataFrame:
    """Per key: distinct levels and the Shannon entropy, in bits, over equal bins of [0, 1]."""
    counts = values.where(F.col(value).between(0, 1)).groupBy(*keys, bin_of(F.col(value), bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy(*keys) if keys else Window.partitionBy())
    entropy = counts.withColumn("p", share).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    levels = values.groupBy(*keys).agg(F.count_distinct(value).alias("levels"))
    return levels.join(entropy, list(keys)) if keys else levels.join(entropy)


def bin_shares(values: DataFrame, keys: Sequence[str], value: str, bins: int = 5) -> DataFrame:
    """Per key and bin the share of values in it."""
    counts = values.where(F.col(value).between(0, 1)).groupBy(*keys, bin_of(F.col(value), bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return counts.select(*keys, "bin", (F.col("c") / F.sum("c").over(Window.partitionBy(*keys))).alias("share"))


def average_rank(values: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Rank from 1 within each key, ties share the mean of their ranks; null values and rows with a null key have none.

    Rows shrink to distinct values, whose counts are summed up range by range; rows meet their value's rank in a join that
    splits hot keys."""
    known = values.where(" and ".join(f"`{c}` is not null" for c in (*keys, value)))
    counts = running_total(known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), keys, value, "_c", "_below")
    ranks = counts.select(*keys, value, (F.col("_below") + (F.col("_c") + 1) / 2).alias(name))
    return join_groups(values.drop(name), ranks, [*keys, value], "left")


def empirical_cdf(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key with the share of rows up to them. Rows shrink to distinct values before any window."""
    known = values.where(" and ".join(f"`{c}` is not null" for c in (*keys, value)))
    counts = running_total(known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")), keys, value, "c", "_below")
    whole = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return join_groups(counts, whole, keys).select(*keys, value, ((F.col("_below") + F.col("c")) / F.col("_n")).alias("cdf"))


def pareto_frontier(points: DataFrame, keys: Sequence[str], cost: str, quality: str) -> DataFrame:
    """Points of higher quality than any cheaper one; at equal cost the best stays."""
    best = points.groupBy(*keys, cost).agg(F.max(quality).alias(quality))
    before = F.max(quality).over(Window.partitionBy(*keys).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(quality) > F.col("_before"))).drop("_before")


def spearman(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per key: n and the correlation of average ranks; rows with a null don't count."""
    known = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(known, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def kolmogorov_smirnov(long: DataFrame, keys: Sequence[str], value: str, side: str) -> DataFrame:
    """Per key the largest gap between the distributions of the rows with side = 0 and side = 1."""
    counts = long.groupBy(*keys, value).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    upto, whole = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    gap = F.abs(F.sum("a").over(upto) / F.sum("a").over(whole) - F.sum("b").over(upto) / F.sum("b").over(whole))
    return counts.withColumn("_gap", gap).groupBy(*keys).agg(F.max("_gap").alias("ks"))


def variant_metrics(pairs: DataFrame, keys: Sequence[str], base: str, variant: str) -> DataFrame:
    """Per key: n, mean_delta, median_delta, mae, rmse, pearson, spearman, ks of a variant against its baseline."""
    d = F.col(variant) - F.col(base)
    plain = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), F.percentile(d, F.lit(0.5)).alias("median_delta"),
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr(base, variant).alias("pearson"),
    )
    end = lambda c, i: F.struct(F.col(c).alias("v"), F.lit(i).alias("side"))
    sides = pairs.select(*keys, F.inline(F.array(end(base, 0), end(variant, 1))))
    rho = spearman(pairs, keys, base, variant).select(*keys, F.col("rho").alias("spearman"))
    return plain.join(rho, list(keys)).join(kolmogorov_smirnov(sides, keys, "v", "side"), list(keys))


def holm_bonferroni(tests: DataFrame, p: str = "p") -> DataFrame:
    """Step-down adjusted p-values: the running maximum of p times the number of hypotheses left, at most 1. One family per
    call: its tests are few."""
    order = Window.partitionBy().orderBy(p, *[c for c in tests.columns if c != p])
    ranked = tests.withColumns({"_rank": F.row_number().over(order), "_m": F.count(F.lit(1)).over(Window.partitionBy())})
    raised = F.max(F.col(p) * (F.col("_m") - F.col("_rank") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), raised)).drop("_rank", "_m")


def friedman(ratings: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """One row: blocks, treatments, statistic, df, over blocks rated under all treatments; with correction for ties."""
    t = ratings.select(treatment).distinct().count()
    whole = ratings.where(F.col(value).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(block))).where(F.col("_n") == t)
    ranked = average_rank(whole, [block], value, "_r")
    ties = ranked.groupBy(block, value).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    sums = ranked.groupBy(treatment).agg(F.sum("_r").alias("s"), F.count(F.lit(1)).alias("blocks"))
    squares = sums.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("blocks").alias("blocks")).join(F.broadcast(ties))
    raw = 12 * F.col("ss") / (F.col("blocks") * t * (t + 1)) - 3 * F.col("blocks") * (t + 1)
    corrected = raw / (1 - F.col("ties") / (F.col("blocks") * (t**3 - t)))
    return squares.select("blocks", F.lit(t).alias("treatments"), corrected.alias("statistic"), F.lit(t - 1).alias("df"))


def wilcoxon(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per key: n of non-zero differences, w (the smaller rank sum), z and two-sided p by the normal approximation with ties,
    and the rank-biserial r = 1 - 2w / (n (n + 1) / 2)."""
    d = pairs.select(*keys, (F.col(x) - F.col(y)).alias("d")).where("d is not null and d <> 0").withColumn("a", F.abs("d"))
    ranked = average_rank(d, keys, "a", "r")
    ties = ranked.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    s = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum("r").alias("all")).join(ties, list(keys))
    w = F.least("up", F.col("all") - F.col("up"))
    sigma = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48)
    z = (w - F.col("n") * (F.col("n") + 1) / 4) / sigma
    return s.select(*keys, "n", w.alias("w"), z.alias("z"), (2 * normal_cdf(z)).alias("p"), (1 - 2 * w / (F.col("n") * (F.col("n") + 1) / 2)).alias("r"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, to 7.5e-8 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def across_models(long: DataFrame, keys: Sequence[str], models: Sequence[str], value: str, model: str = "model") -> DataFrame:
    """One row per key: the mean value of each model as a column of its name, their spread, and the model with the highest, the
    first listed on ties; null where a model has none."""
    means = {m: F.avg(F.when(F.col(model) == m, F.col(value))) for m in models}
    wide = long.where(F.col(model).isin(list(models))).groupBy(*keys).agg(*[c.alias(m) for m, c in means.items()])
    top = F.greatest(*[F.col(f"`{m}`") for m in models]) if len(models) > 1 else F.col(f"`{models[0]}`")
    low = F.least(*[F.col(f"`{m}`") for m in models]) if len(models) > 1 else top
    return wide.select("*", (top - low).alias("spread"), F.coalesce(*[F.when(F.col(f"`{m}`") == top, F.lit(m)) for m in models]).alias("best"))


def model_summary(
    reliability: DataFrame, correlations: DataFrame, resolution: DataFrame, efficiency: DataFrame, dimensions: Sequence[str],
    scale: str, prompt: str, coarse_scale: str,
) -> DataFrame:
    """One row per model: alpha and cv of each dimension under the stated scale and prompt, least and largest alpha of all
    conditions, mean, least and largest rank correlation, quality index and time, entropy of each dimension, and the share at
    the ceiling of the coarse scale. What a model has no row for is null.

    reliability: model, scale, prompt, dimension, alpha, avg_cv; correlations: model, rho; resolution: model, scale, prompt,
    dimension, entropy_bits, ceiling_pct; efficiency: model, scale, prompt, quality_index, mean_time_ms."""
    here = (F.col("scale") == scale) & (F.col("prompt") == prompt)
    of = lambda d, c, when: F.max(F.when(when & (F.col("dimension") == d), F.col(c)))
    told = reliability.groupBy("model").agg(
        *[of(d, "alpha", here).alias(f"alpha_{d}") for d in dimensions], *[of(d, "avg_cv", here).alias(f"cv_{d}") for d in dimensions],
        F.min("alpha").alias("alpha_min_all"), F.max("alpha").alias("alpha_max_all"),
    )
    ranks = correlations.groupBy("model").agg(F.round(F.avg("rho"), 4).alias("mean_rho"), F.round(F.min("rho"), 4).alias("min_rho"), F.round(F.max("rho"), 4).alias("max_rho"))
    fast = efficiency.where(here).groupBy("model").agg(F.round(F.max("quality_index"), 4).alias("quality_index"), F.round(F.max("mean_time_ms")).alias("time_ms_per_entity"))
    coarse = (F.col("scale") == coarse_scale) & (F.col("prompt") == prompt)
    levels = resolution.groupBy("model").agg(*[of(d, "entropy_bits", here).alias(f"entropy_{d}") for d in dimensions], *[of(d, "ceiling_pct", coarse).alias(f"ceiling_pct_{d}") for d in dimensions])
    return told.join(ranks, "model", "left").join(fast, "model", "left").join(levels, "model", "left")


def quality_index(table: DataFrame, alpha: str, rho: str) -> Column:
    """sqrt(mean alpha * mean rho) of the aggregated columns."""
    return F.sqrt(F.greatest(F.avg(alpha) * F.avg(rho), F.lit(0.0)))


def interaction(cells: DataFrame, entity: str, a: str, b: str, value: str, levels_a: tuple, levels_b: tuple) -> DataFrame:
    """Per entity the difference of differences between two levels each of the factors a and b; entities with all four
    cells only."""
    cell = lambda i, j: F.avg(F.when((F.col(a) == levels_a[i]) & (F.col(b) == levels_b[j]), F.col(value)))
    each = cells.groupBy(entity).agg(((cell(1, 1) - cell(0, 1)) - (cell(1, 0) - cell(0, 0))).alias("contrast"))
    return each.where("contrast is not null")
