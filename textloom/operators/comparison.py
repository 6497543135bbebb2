"""Participants compared by their scores: centroids, pairwise distances, groups, permutation test.

Participants are few (a study's people), their scores may be many: scores shrink to one vector per participant in one
aggregation, everything after works on those.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators import allpairs
from textloom.plans.storage import broadcast_object, broadcast_value, materialise


def centroids(scores: DataFrame, dimensions: Sequence[str], participant: str = "participant", dimension: str = "dimension", score: str = "score") -> DataFrame:
    """(participant, v): mean score per dimension in the order given; dimensions without a score are 0."""
    means = [F.coalesce(F.avg(F.when(F.col(dimension) == d, F.col(score))), F.lit(0.0)) for d in dimensions]
    return scores.where(F.col(participant).isNotNull()).groupBy(participant).agg(F.array(*means).alias("v"))


def subset(rows: DataFrame, participants: Sequence[str], participant: str = "participant") -> DataFrame:
    """Rows of the participants asked for, with their place in the request as `place`."""
    if not participants:
        raise ValueError("no participants")
    wanted = F.array(*[F.lit(p) for p in participants])
    return rows.withColumn("place", F.array_position(wanted, F.col(participant)) - 1).where("place >= 0")


#: Set to a number, more participants than that raise; by default there is no bound.
MOST_PARTICIPANTS: int | None = None


def bounded(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The rows, counted where a bound is set: as many as pairs may be made of, or an error."""
    most = MOST_PARTICIPANTS if most is None else most
    if most is not None and rows.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} participants")
    return rows


def distances(vectors: DataFrame, metric: str = "euclidean", key: str = "participant") -> DataFrame:
    """(a, b, d) of every pair a < b, made in tiles by tasks with about as many pairs each. metric: euclidean, cosine, aitchison."""
    return allpairs.pairs(bounded(vectors), metric, key)


def sample_distances(samples: DataFrame, n_dimensions: int, key: str = "participant", n_directions: int = 100, seed: int = 42, exact: bool = False) -> DataFrame:
    """(a, b, d) by the sliced, or the exact, Wasserstein distance between participants' centred log-ratio rows. samples: key, rows
    (array of vectors, one per entity)."""
    samples = bounded(samples)
    ways = V.random_directions(n_dimensions, n_directions, seed)
    logs = samples.select(key, F.transform("rows", V.clr).alias("rows"))
    left, right = logs.select(F.col(key).alias("a"), F.col("rows").alias("x")), logs.select(F.col(key).alias("b"), F.col("rows").alias("y"))
    if exact:

        @F.pandas_udf("double")
        def distance(xs: pd.Series, ys: pd.Series) -> pd.Series:
            import numpy as np

            return pd.Series([V.exact_wasserstein(np.stack(x), np.stack(y)) if len(x) and len(y) else None for x, y in zip(xs, ys, strict=True)], dtype="Float64")

        return left.join(right, F.col("a") < F.col("b")).select("a", "b", distance("x", "y").alias("d"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", V.sliced_wasserstein(F.col("x"), F.col("y"), ways).alias("d"))


def distance_summary(vectors: DataFrame, metric: str = "euclidean") -> DataFrame:
    """What summarise tells, of all pairs, from the vectors: no table of pairs is made."""
    return allpairs.summary(bounded(vectors), metric)


def summarise(pairs: DataFrame) -> DataFrame:
    """One row: n_pairs, mean, median, min, max, and the closest and farthest pair, the first in order on ties."""
    place = F.struct("d", "a", "b")
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("d").alias("mean"), F.percentile("d", F.lit(0.5)).alias("median"), F.min("d").alias("min"), F.max("d").alias("max"),
        F.min(place).alias("_near"), F.min(F.struct((-F.col("d")).alias("d"), "a", "b")).alias("_far"),
    ).select("n_pairs", "mean", "median", "min", "max", F.col("_near.a").alias("closest_a"), F.col("_near.b").alias("closest_b"), F.col("_far.a").alias("farthest_a"), F.col("_far.b").alias("farthest_b"))


def excluded(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Participants in no group."""
    return vectors.select("participant").join(groups, "participant", "left_anti")


def group_distances(vectors: DataFrame, groups: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Rows (kind, group_a, group_b, n_pairs, mean): kind within for each group (mean 0 for fewer than two members), between
    for each pair of groups. groups: (group, participant)."""
    bounded(vectors.join(groups.select("participant").distinct(), "participant", "left_semi"))
    named = materialise(allpairs.by_group(vectors, groups, metric))
    mean = F.sum("total") / F.nullif(F.sum("known"), F.lit(0))
    within = named.where("ga = gb").groupBy(F.col("ga").alias("group_a")).agg(F.sum("n").alias("n_pairs"), mean.alias("mean"))
    every = groups.select(F.col("group").alias("group_a")).distinct().join(within, "group_a", "left")
    inner = every.select(F.lit("within").alias("kind"), "group_a", F.col("group_a").alias("group_b"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce("mean", F.lit(0.0)).alias("mean"))
    outer = named.where("ga <> gb").groupBy(F.lit("between").alias("kind"), F.least("ga", "gb").alias("group_a"), F.greatest("ga", "gb").alias("group_b")).agg(F.sum("n").alias("n_pairs"), mean.alias("mean"))
    return inner.unionByName(outer)


def group_centroids(vectors: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    joined = vectors.join(groups, "participant")
    return joined.groupBy("group").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(n)]).alias("v"))


def effect_size(stats: DataFrame) -> DataFrame:
    """One row: mean between distance over mean within distance of groups with pairs; null if that is not positive."""
    within = F.avg(F.when((F.col("kind") == "within") & (F.col("n_pairs") > 0), F.col("mean")))
    between = F.avg(F.when(F.col("kind") == "between", F.col("mean")))
    return stats.agg(F.when(within > 0, between / within).alias("effect_size"))


def permutation_test(vectors: DataFrame, groups: DataFrame, metric: str = "euclidean", n: int = 1000, seed: int = 42) -> DataFrame:
    """One row: observed effect size, p (share of shuffles at least as large, no correction), n, mean and sd of the shuffled
    effects. Shuffles come from one legacy seeded generator and run in parallel tasks, which draw them from its states.

    Shuffles keep the groups' sizes. So the mean distance between groups is a sum over all pairs by weights of their members, less
    the sums within groups. What runs over all pairs, the weights and groups of at least an eighth of the members, is multiplied
    for a task's shuffles at once, tile by tile; sums within smaller groups are taken from their members alone.
    """
    import numpy as np

    spark = vectors.sparkSession
    named = groups.where(F.col("group").isNotNull()).select(F.col("participant").alias("_member"), "group")
    ids, points = allpairs.collected(bounded(vectors.join(named, F.col("participant") == F.col("_member"))).select(F.struct("group", "participant").alias("k"), "v"), metric, "k")
    codes = pd.factorize(pd.Series(ids.field("group").to_pylist() if len(ids) else [], dtype=object))[0].astype(np.int64)
    held = broadcast_object(spark, (points, codes))

    def effects(points: allpairs.Points, codes, orders: list) -> list[float]:
        m, sizes = len(codes), np.bincount(codes)
        k, pairs = len(sizes), sizes * (sizes - 1.0)
        if not (pairs > 0).any():
            return [float("nan")] * len(orders)
        whole = points.tile(slice(None), slice(None)) if m <= 4_000 else None
        tile = (lambda a, b: whole[a, b]) if whole is not None else points.tile
        large = np.flatnonzero((sizes >= m / 8) & (pairs > 0))
        columns = np.stack([c for labels in orders for c in (1 / sizes[labels], *((labels == g) * 1.0 for g in large))], axis=1)
        sums = np.zeros(columns.shape[1])
        for first, end in points.rows(0, m):
            d = tile(slice(first, end), slice(first, None))
            own, later = columns[first:end], columns[end:]
            inside = d[:, : end - first] * ~np.eye(end - first, dtype=bool)
            sums += (own * (inside @ own + 2 * (d[:, end - first :] @ later))).sum(0)
        out = []
        for labels, (weighted, *of_large) in zip(orders, sums.reshape(len(orders), -1).tolist(), strict=True):
            within = np.zeros(k)
            within[large] = of_large
            place = np.split(np.argsort(labels, kind="stable"), np.cumsum(sizes)[:-1])
            for g in np.flatnonzero((sizes < m / 8) & (pairs > 0)):
                members = place[g]
                for at in range(0, len(members), 256):
                    rows, rest = members[at : at + 256], members[at:]
                    d = whole[np.ix_(rows, rest)] if whole is not None else points.tile(rows, rest)
                    within[g] += 2 * d.sum() - d[:, : len(rows)].sum() - np.diagonal(d).sum()
            alike = (within[pairs > 0] / pairs[pairs > 0]).mean()
            between = (weighted - (within / sizes**2).sum()) / (k * (k - 1)) if k > 1 else float("nan")
            out.append(float(between / alike) if alike > 0 else float("nan"))
        return out

    observed = effects(points, codes, [codes])[0] if len(codes) else float("nan")
    old, states, at_once = np.random.RandomState(seed), [], max(1, -(-n // max(1, spark.sparkContext.defaultParallelism)))
    at_once = max(1, min(at_once, 8_000_000 // max(1, len(codes))))
    for i in range(n):
        if i % at_once == 0:
            states.append((min(at_once, n - i), old.get_state()))
        old.permutation(codes)

    def shuffled(chunk) -> list[tuple[float]]:
        points, codes = broadcast_value(held)
        again = np.random.RandomState()
        again.set_state(chunk[1])
        orders = [again.permutation(codes) for _ in range(chunk[0])]
        return [(e,) for e in effects(points, codes, orders)] if len(codes) else [(float("nan"),)] * chunk[0]

    drawn = spark.createDataFrame(spark.sparkContext.parallelize(states, max(1, len(states))).flatMap(shuffled), "effect double")
    return drawn.agg(
        F.lit(observed).alias("observed"), F.avg((F.col("effect") >= observed).cast("double")).alias("p"), F.count(F.lit(1)).alias("n"), F.avg("effect").alias("null_mean"), F.stddev_samp("effect").alias("null_sd"),
    )


def aligned(scores: DataFrame, fill: float = 0.0) -> DataFrame:
    """Every participant with every entity and dimension: score or `fill`, and whether it was there. Participants are a small
    list, so theirs is the broadcast side."""
    cells = scores.select("entity", "dimension").distinct()
    people = F.broadcast(bounded(materialise(scores.select("participant").distinct())))
    full = cells.join(people).join(scores.groupBy("participant", "entity", "dimension").agg(F.avg("score").alias("score")), ["participant", "entity", "dimension"], "left")
    return full.select("participant", "entity", "dimension", F.coalesce("score", F.lit(fill)).alias("score"), F.col("score").isNotNull().alias("present"))


def common_entities(scores: DataFrame, condition: str, entity: str = "entity") -> DataFrame:
    """Entities that occur under every condition."""
    n = scores.select(condition).distinct().agg(F.count(F.lit(1)).alias("_n"))
    return scores.groupBy(entity).agg(F.count_distinct(condition).alias("_c")).join(F.broadcast(n)).where("_c = _n").select(entity)


def confidence_ellipse(points: DataFrame, keys: Sequence[str], x: Column, y: Column, chi2: float = 5.991) -> DataFrame:
    """Per key the 95 % ellipse of two coordinates: centre, half-axes, angle in degrees; from the covariance in closed form."""
    s = points.groupBy(*keys).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("a"), F.var_samp(y).alias("b"), F.covar_samp(x, y).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    mid, half = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.pow("c", 2))
    axis = lambda v: F.sqrt(chi2 * F.greatest(v, F.lit(0.0)))
    return s.select(*keys, "cx", "cy", axis(mid + half).alias("major"), axis(mid - half).alias("minor"), F.degrees(F.atan2(mid + half - F.col("a"), F.col("c"))).alias("angle"))


def first_group(rows: DataFrame, group: str, participant: str, seq: str) -> DataFrame:
    """(group, participant) from a column: a participant's first value wins."""
    known = rows.where(F.col(group).isNotNull() & F.col(participant).isNotNull())
    return known.groupBy(F.col(participant).alias("participant")).agg(F.min_by(group, seq).alias("group"))


def silhouette(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean silhouette of labelled points by given distances (a, b, d); single members score 0."""
    both = pairs.select("a", "b", "d").union(pairs.select("b", "a", "d"))
    l = labels.select("id", "label")  # noqa: E741
    named = both.join(l.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(l.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    per = named.groupBy("a", "la", "lb").agg(F.avg("d").alias("m"))
    own = F.max(F.when(F.col("la") == F.col("lb"), F.col("m")))
    other = F.min(F.when(F.col("la") != F.col("lb"), F.col("m")))
    score = per.groupBy("a").agg(own.alias("i"), other.alias("o"))
    value = F.when(F.col("i").isNull() | F.col("o").isNull(), 0.0).otherwise((F.col("o") - F.col("i")) / F.nullif(F.greatest("i", "o"), F.lit(0.0)))
    return score.agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("silhouette"))


