"""Vector functions on array<double> columns, by higher-order functions; meant for up to a few hundred dimensions.

Null vectors give null. Vectors of different lengths are padded with nulls by zip_with and give null as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(_sum(F.transform(x, lambda a: a * a)))


def mean(x: Column) -> Column:
    return _sum(x) / F.size(x)


def cosine_similarity(x: Column, y: Column) -> Column:
    """0 where either vector has no length."""
    lengths = norm(x) * norm(y)
    return F.when(lengths == 0, 0.0).otherwise(dot(x, y) / lengths)


def cosine_distance(x: Column, y: Column) -> Column:
    return 1 - cosine_similarity(x, y)


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def clr(x: Column) -> Column:
    """Centred log-ratio: clipped to 1e-10, closed to sum 1, log less its mean."""
    clipped = F.transform(x, lambda a: F.greatest(a, F.lit(TINY)))
    logs = F.transform(F.array(clipped), lambda c: F.transform(F.array(_sum(c)), lambda s: F.transform(c, lambda a: F.log(a / s)))[0])[0]
    return F.transform(F.array(logs), lambda v: F.transform(F.array(mean(v)), lambda m: F.transform(v, lambda a: a - m))[0])[0]


def ilr(x: Column, dimensions: int) -> Column:
    """Isometric log-ratio with D - 1 coordinates: sqrt(i / (i + 1)) * ln(geometric mean of the first i parts / part i + 1)."""
    clipped = F.transform(x, lambda a: F.greatest(a, F.lit(TINY)))
    logs = F.transform(clipped, lambda a: F.log(a))
    parts = [F.lit(math.sqrt(i / (i + 1))) * (_sum(F.slice(logs, 1, i)) / i - logs[i]) for i in range(1, dimensions)]
    return F.array(*parts)


def aitchison(x: Column, y: Column) -> Column:
    return euclidean(clr(x), clr(y))


def wasserstein_1d(x: Column, y: Column) -> Column:
    """Area between the distribution functions of two samples of any sizes.

    For equal sizes this is the mean gap of the sorted values. Otherwise each sample is laid out on the common refinement:
    x repeated |y| times, y repeated |x| times.
    """

    def spread(v: Column, times: Column) -> Column:
        return F.flatten(F.transform(F.array_sort(v), lambda a: F.array_repeat(a, times)))

    same = F.size(x) == F.size(y)
    left = F.when(same, F.array_sort(x)).otherwise(spread(x, F.size(y)))
    right = F.when(same, F.array_sort(y)).otherwise(spread(y, F.size(x)))
    gaps = F.zip_with(left, right, lambda a, b: F.abs(a - b))
    return _sum(gaps) / F.size(left)


def sliced_wasserstein(x: Column, y: Column, directions: list[list[float]]) -> Column:
    """Mean over fixed directions of the 1-d distance between projections; x and y are arrays of vectors."""

    def projected(rows: Column, way: list[float]) -> Column:
        return F.transform(rows, lambda v: sum((v[i] * F.lit(w) for i, w in enumerate(way)), F.lit(0.0)))

    each = [wasserstein_1d(projected(x, w), projected(y, w)) for w in directions]
    return sum(each, F.lit(0.0)) / len(each)


def random_directions(dimensions: int, n: int = 100, seed: int = 42) -> list[list[float]]:
    """n unit vectors from a seeded generator."""
    import numpy as np

    draws = np.random.default_rng(seed).standard_normal((n, dimensions))
    return (draws / np.linalg.norm(draws, axis=1, keepdims=True)).tolist()


def ternary(a: Column, b: Column, c: Column, equal_if_zero: bool = True) -> Column:
    """struct<x, y> of barycentric shares in a triangle with corners (0,0), (1,0), (1/2, sqrt(3)/2)."""
    total = a + b + c
    share = lambda v: F.when(total > 0, v / total).otherwise(F.lit(1 / 3 if equal_if_zero else 0.0))
    return F.struct((share(b) + share(c) / 2).alias("x"), (share(c) * (math.sqrt(3) / 2)).alias("y"))


def scale_fraction(value: Column, low: Column | float, high: Column | float, clamp: bool = True) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    raw = (value - low) / (high - low)
    return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))) if clamp else raw


def transport(cost, supply, demand) -> float:
    """The least total cost of bringing whole units from rows to columns, as many as both have in all (successive shortest
    paths under prices that keep all reduced costs from below zero)."""
    import numpy as np

    cost, left, need = np.asarray(cost, float), np.array(supply, np.int64), np.array(demand, np.int64)
    n, m = cost.shape
    flow, row_price, column_price = np.zeros((n, m), np.int64), np.zeros(n), np.zeros(m)
    column_price = cost.min(0) if n else column_price
    while left.any():
        dist = np.concatenate([np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)])
        before, done = np.full(n + m, -1), np.zeros(n + m, bool)
        while True:
            x = int(np.where(done, np.inf, dist).argmin())
            done[x] = True
            if x >= n and need[x - n]:
                break
            if x < n:
                new, where = dist[x] + np.maximum(cost[x] - row_price[x] - column_price, 0), np.arange(n, n + m)
            else:
                where = np.flatnonzero(flow[:, x - n])
                new = np.full(len(where), dist[x])
            better = (new < dist[where]) & ~done[where]
            dist[where[better]], before[where[better]] = new[better], x
        path = [x]
        while before[path[-1]] >= 0:
            path.append(int(before[path[-1]]))
        steps = [(a, b - n, 1) if a < n else (b, a - n, -1) for b, a in zip(path, path[1:], strict=False)]
        units = min([left[path[-1]], need[x - n], *[flow[i, j] for i, j, way in steps if way < 0]])
        for i, j, way in steps:
            flow[i, j] += way * units
        left[path[-1]] -= units
        need[x - n] -= units
        shift = np.where(done, dist[x] - dist, 0.0)
        row_price, column_price = row_price + shift[:n], column_price - shift[n:]
    return float((flow * cost).sum())


def exact_wasserstein(x, y) -> float:
    """The 2-Wasserstein distance of two samples whose points weigh the same."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    cost = np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T)
    return float(np.sqrt(transport(cost, np.full(len(x), len(y)), np.full(len(y), len(x))) / (len(x) * len(y))))


def marker_size(fraction: Column, base: float = 100.0) -> Column:
    return F.lit(base) * (F.lit(0.15) + F.lit(2.35) * F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)))


def inverse_logit(value: Column, low: float, high: float) -> Column:
    return F.lit(low) + F.lit(high - low) / (1 + F.exp(-value))


def squeeze(fraction: Column, n: Column) -> Column:
    """Into the open interval (0, 1): (x (n - 1) + 1/2) / n, kept 1e-6 away from both ends."""
    return F.when(fraction.isNotNull(), F.least(F.greatest((fraction * (n - 1) + 0.5) / n, F.lit(1e-6)), F.lit(1 - 1e-6)))
