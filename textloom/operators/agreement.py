"""Agreement of raters: Krippendorff's alpha for interval data and its bootstrap interval.

Ratings are long: keys, unit, rater, value. The squared differences of a unit follow from its count, sum and sum of squares,
so one aggregation by unit and one over units suffice, and a bootstrap resamples three numbers per unit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.rules import alpha_wording


def unit_moments(ratings: DataFrame, keys: Sequence[str], unit: str = "unit", value: str = "value") -> DataFrame:
    """Per unit: n, s1, s2 of the known values. NaN counts as missing."""
    known = ratings.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2"))


def _alpha(variant: str) -> Column:
    """From sums over units. pooled: observed is the mean squared difference over all ordered pairs within units, expected is
    twice the population variance. sample_variance: unordered pairs, expected is the sample variance."""
    many = F.col("n") >= 2
    squares = F.sum(F.when(many, 2 * (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1"))))
    pairs = F.sum(F.when(many, F.col("n") * (F.col("n") - 1)))
    n, s1, s2 = F.sum("n"), F.sum("s1"), F.sum("s2")
    variance = (s2 - s1 * s1 / n) / (n if variant == "pooled" else n - 1)
    expected = 2 * variance if variant == "pooled" else variance
    return F.when(F.count_if(many) >= 2, F.when(F.abs(expected) < 1e-12, 1.0).otherwise(1 - squares / pairs / expected))


def krippendorff_alpha(ratings: DataFrame, keys: Sequence[str] = (), unit: str = "unit", value: str = "value", variant: str = "pooled") -> DataFrame:
    """Per key: alpha, n_units (with two values or more) and the wording. Null alpha with fewer than two such units."""
    units = unit_moments(ratings, keys, unit, value)
    out = units.groupBy(*keys).agg(_alpha(variant).alias("alpha"), F.count_if(F.col("n") >= 2).alias("n_units"))
    return out.withColumn("interpretation", alpha_wording(F.col("alpha")))


def run_level(scores: DataFrame, dimension: str = "dimension") -> DataFrame:
    """Ratings with runs as raters of (participant, entity) units."""
    return scores.select(dimension, F.struct("participant", "entity").alias("unit"), F.col("run").alias("rater"), F.col("score").alias("value"))


def participant_level(scores: DataFrame, dimension: str = "dimension") -> DataFrame:
    """Ratings with participants as raters of entities, by their mean score."""
    means = scores.groupBy(dimension, "participant", "entity").agg(F.avg("score").alias("value"))
    return means.select(dimension, F.col("entity").alias("unit"), F.col("participant").alias("rater"), "value")


MOST_UNITS = 1_000_000


def bootstrap_alpha(ratings: DataFrame, keys: Sequence[str] = (), unit: str = "unit", value: str = "value", n: int = 1000, confidence: float = 0.95, seed: int = 42, most_units: int = MOST_UNITS) -> DataFrame:
    """Per key: ci_low and ci_high of alpha over n resamples of the units. Replicates run in parallel tasks, each with the
    three moments of every unit, which are broadcast behind a check of their number."""
    import numpy as np

    units = unit_moments(ratings, keys, unit, value)
    if units.limit(most_units + 1).count() > most_units:
        raise ValueError(f"the bootstrap holds at most {most_units} units in memory")
    spark = ratings.sparkSession
    table = units.select(F.to_json(F.struct(F.lit("").alias("_"), *keys)).alias("key"), *keys, F.xxhash64(unit).alias("u"), "n", "s1", "s2").orderBy("key", "u").toPandas()
    moments = {key: part[["n", "s1", "s2"]].to_numpy(float) for key, part in table.groupby("key")}
    held = spark.sparkContext.broadcast(moments)

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for replicate in batch["id"]:
                for key, m in held.value.items():
                    d = m[np.random.default_rng([seed, int(replicate)]).integers(0, len(m), len(m))]
                    many = d[d[:, 0] >= 2]
                    total, s1, s2 = d.sum(0)
                    expected = 2 * (s2 / total - (s1 / total) ** 2)
                    if len(many) < 2:
                        continue
                    observed = (2 * (many[:, 0] * many[:, 2] - many[:, 1] ** 2)).sum() / (many[:, 0] * (many[:, 0] - 1)).sum()
                    rows.append((key, 1.0 if abs(expected) < 1e-12 else 1 - observed / expected))
            yield pd.DataFrame(rows, columns=["key", "alpha"])

    drawn = spark.range(0, n, 1, spark.sparkContext.defaultParallelism).mapInPandas(resample, "key string, alpha double")
    tail = (1 - confidence) / 2
    bounds = drawn.groupBy("key").agg(F.percentile("alpha", F.lit(tail)).alias("ci_low"), F.percentile("alpha", F.lit(1 - tail)).alias("ci_high"))
    names = units.select(F.to_json(F.struct(F.lit("").alias("_"), *keys)).alias("key"), *keys).distinct()
    return names.join(bounds, "key").drop("key")


def agreement(scores: DataFrame, mode: str = "run", n_bootstrap: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """One row per dimension: alpha, interval, units, wording. mode: run or participant."""
    ratings = run_level(scores) if mode == "run" else participant_level(scores)
    alpha = krippendorff_alpha(ratings, ["dimension"])
    bounds = bootstrap_alpha(ratings, ["dimension"], n=n_bootstrap, confidence=confidence, seed=seed)
    return alpha.join(bounds, "dimension", "left").withColumn("mode", F.lit(mode))


def bootstrap_mean(values: DataFrame, keys: Sequence[str], value: str, n: int = 10_000, confidence: float = 0.95, seed: int = 42, most: int = MOST_UNITS) -> DataFrame:
    """Per key: mean and percentile interval over n resamples; for paired data give the differences as values. A key's values
    are gathered in one task, behind a check of their number."""
    import numpy as np

    if values.groupBy(*keys).count().where(F.col("count") > most).limit(1).count():
        raise ValueError(f"the bootstrap holds at most {most} values of a key in memory")
    tail = 100 * (1 - confidence) / 2

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].dropna().to_numpy(float))
        rng = np.random.default_rng(seed)
        means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(n)]) if len(x) else np.array([np.nan])
        first = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([first | {"mean": x.mean() if len(x) else None, "ci_low": np.percentile(means, tail), "ci_high": np.percentile(means, 100 - tail)}])

    kinds = ", ".join(f"{k} {values.schema[k].dataType.simpleString()}" for k in keys)
    return values.select(*keys, value).groupBy(*keys).applyInPandas(resample, f"{kinds}, mean double, ci_low double, ci_high double")
