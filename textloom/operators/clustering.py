"""Clustering and projections of participants: their scores are reduced to vectors in Spark, which are collected and finished with
numpy. What runs over all pairs of vectors is made in tiles by tasks. Given distances are held as a matrix, behind a check of
its size; from vectors nothing is held but the vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import allpairs

MOST = 5_000


def matrix(vectors: DataFrame, key: str = "participant") -> tuple[list, np.ndarray]:
    ids, points = allpairs.collected(vectors, key=key)
    return ids.to_pylist(), points.x.T


def square(pairs: DataFrame, most: int = MOST) -> tuple[list, np.ndarray]:
    """Ids and symmetric matrix of pairs (a, b, d)."""
    ids = [r.id for r in pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().orderBy("id").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"at most {most} participants")
    at, d = {x: i for i, x in enumerate(ids)}, np.zeros((len(ids), len(ids)))
    for r in pairs.collect():
        d[at[r.a], at[r.b]] = d[at[r.b], at[r.a]] = r.d
    return ids, d


def linkage(d: np.ndarray, method: str = "ward") -> list[tuple[int, int, float, int]]:
    """Merges (cluster, cluster, height, size) by the Lance-Williams recurrence; new clusters are numbered from n on. method:
    ward, complete, single, average."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, sizes, merges = list(range(n)), [1] * n, []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(np.where(np.outer(alive, alive), d, np.inf)), d.shape))
        h, a, b = d[i, j], sizes[i], sizes[j]
        merges.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(h), a + b))
        others = alive.copy()
        others[[i, j]] = False
        x, y, c = d[i, others], d[j, others], np.array(sizes)[others]
        if method == "ward":
            new = np.sqrt(np.maximum(0, ((a + c) * x**2 + (b + c) * y**2 - c * h**2) / (a + b + c)))
        else:
            new = {"complete": np.maximum(x, y), "single": np.minimum(x, y), "average": (a * x + b * y) / (a + b)}[method]
        d[i, others] = d[others, i] = new
        alive[j], sizes[i], ids[i] = False, a + b, n + step
    return merges


def cut(merges: list[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """Labels 0.. of k clusters, numbered by first appearance."""
    parent = list(range(n + len(merges)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, (a, b, *_) in enumerate(merges[: n - k]):
        parent[root(a)] = parent[root(b)] = n + step
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(root(i), len(seen)) for i in range(n)])


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    values = []
    for i in range(len(d)):
        own = labels == labels[i]
        if own.sum() == 1:
            values.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels.tolist()) - {labels[i]})
        values.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(values))


def silhouettes(spark: SparkSession, x: np.ndarray, labelled: list[np.ndarray]) -> list[float]:
    """The silhouette by each of the labels of the rows of x, by Euclidean distances made in tiles; -1 where all are alike or all differ."""
    n = len(x)
    points = allpairs.Points(np.ascontiguousarray(x.T), np.arange(n), None, False)
    counts = [len(set(lab.tolist())) for lab in labelled]
    used = [np.unique(lab, return_inverse=True)[1] for lab, c in zip(labelled, counts, strict=True) if 1 < c < n]
    held = spark.sparkContext.broadcast(used)

    def sums(points: allpairs.Points, first: int, last: int) -> list[float]:
        total, labels = np.zeros(len(held.value)), held.value
        hot = np.concatenate([np.eye(lab.max() + 1)[lab] for lab in labels], axis=1)
        step = max(1, allpairs.TILE // len(points))
        for at in range(first, last, step):
            rows, start = np.arange(at, min(at + step, last)), 0
            near = points.tile(rows, slice(None)) @ hot
            for k, lab in enumerate(labels):
                sizes = np.bincount(lab)
                own, mean = lab[rows], near[:, start : start + len(sizes)]
                start += len(sizes)
                here = np.arange(len(rows)), own
                a = mean[here] / np.maximum(sizes[own] - 1, 1)
                mean = mean / sizes
                mean[here] = np.inf
                b = mean.min(1)
                most = np.maximum(a, b)
                total[k] += np.where((sizes[own] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0.0).sum()
        return total.tolist()

    if not used:
        return [-1.0] * len(labelled)
    parts = max(1, min(n, max(spark.sparkContext.defaultParallelism, n * n // allpairs.TASK)))
    even = [(n * k // parts, n * (k + 1) // parts) for k in range(parts)]
    found = iter(np.sum(allpairs.over_spans(spark, points, sums, even), axis=0) / n)
    return [float(next(found)) if 1 < c < n else -1.0 for c in counts]


def _table(spark, ids: list, labels: np.ndarray, quality: float) -> DataFrame:
    return spark.createDataFrame([(str(i), int(x), float(quality)) for i, x in zip(ids, labels, strict=True)], "participant string, label int, silhouette double")


def hierarchical(pairs: DataFrame, n_clusters: int | None = None, method: str = "ward", most_k: int = 10) -> DataFrame:
    """(participant, label, silhouette) from given distances; without n_clusters the k in 2..most_k of the best silhouette."""
    ids, d = square(pairs)
    merges = linkage(d, method)
    ks = [n_clusters] if n_clusters else range(2, max(2, min(most_k, len(ids) - 1)) + 1)
    scored = [(silhouette(d, lab) if 1 < len(set(lab.tolist())) < len(ids) else -1.0, lab) for lab in (cut(merges, len(ids), min(k, len(ids))) for k in ks)]
    quality, labels = max(scored, key=lambda x: x[0])
    return _table(pairs.sparkSession, ids, labels, quality)


def ward(x: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges as by linkage(.., "ward") on Euclidean distances of the rows of x, lowest first, each told by a row of either cluster.

    Chains of nearest neighbours: two clusters that are each other's nearest merge at once, which leaves the order of heights to a
    sort. By Ward's heights that is the same tree, from centres and sizes alone.
    """
    n = len(x)
    c, size, leaf = np.array(x.T, float, order="C"), np.ones(n), np.arange(n)
    alive, chain, merges = n, [], []
    while alive > 1:
        if not chain:
            chain.append(0)
        tip = chain[-1]
        apart = np.zeros(alive)
        for row in c:
            gap = row[:alive] - row[tip]
            gap *= gap
            apart += gap
        apart *= 2 * size[tip] * size[:alive] / (size[tip] + size[:alive])
        apart[tip] = np.inf
        near = int(apart.argmin())
        if len(chain) < 2 or apart[near] < apart[chain[-2]]:
            chain.append(near)
            continue
        near = chain[-2]
        del chain[-2:]
        both = size[tip] + size[near]
        merges.append((int(leaf[tip]), int(leaf[near]), float(np.sqrt(apart[near])), int(both)))
        i, j = sorted((tip, near))
        c[:, i] = (c[:, tip] * size[tip] + c[:, near] * size[near]) / both
        size[i] = both
        alive -= 1
        c[:, j], size[j], leaf[j] = c[:, alive], size[alive], leaf[alive]
        chain = [j if k == alive else k for k in chain]
    return sorted(merges, key=lambda m: m[2])


def hierarchical_vectors(vectors: DataFrame, n_clusters: int | None = None, most_k: int = 10) -> DataFrame:
    """What hierarchical gives by Ward's method from the Euclidean distances of the vectors, without a matrix of them."""
    ids, x = matrix(vectors)
    merges, n = ward(x), len(ids)
    ks = [n_clusters] if n_clusters else range(2, max(2, min(most_k, n - 1)) + 1)
    labelled = [cut(merges, n, min(k, n)) for k in ks]
    quality, labels = max(zip(silhouettes(vectors.sparkSession, x, labelled), labelled, strict=True), key=lambda q: q[0])
    return _table(vectors.sparkSession, ids, labels, quality)


def density_labels(d: np.ndarray, min_cluster_size: int = 3, min_samples: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels by density (-1 for none) and how surely each point belongs, 0..1 (HDBSCAN).

    Points are linked by the larger of their distance and both distances to the `min_samples`-th neighbour. Cutting the
    minimum spanning tree from its longest edge on, a part splits where both sides have `min_cluster_size` points and else
    sheds the smaller side. Of nested parts those that persist longest in all are the clusters; the whole isn't one.
    """
    n = len(d)
    labels, sure = np.full(n, -1), np.zeros(n)
    if n < 2 * min_cluster_size:
        return labels, sure
    core = np.partition(d, min(n - 1, min_samples or min_cluster_size), axis=1)[:, min(n - 1, min_samples or min_cluster_size)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    edges, inside, best, source = [], np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (reach[at] < best)
        best[closer], source[closer] = reach[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((float(best[at]), int(source[at]), at))
    members, root = {i: [i] for i in range(n)}, list(range(n))
    tree: dict[int, tuple[float, int, int]] = {}
    for length, a, b in sorted(edges):
        left, right = root[a], root[b]
        new = n + len(tree)
        tree[new], members[new] = (length, left, right), members[left] + members[right]
        for x in members[new]:
            root[x] = new
    top = n + n - 2
    born, part_of, inner, leaves_at = {top: 0.0}, {}, {top: []}, {top: {}}
    todo = [(top, top)]
    while todo:
        node, owner = todo.pop()
        if node < n:
            continue
        length, left, right = tree[node]
        level = 1 / length if length > 0 else np.inf
        big = [x for x in (left, right) if len(members[x]) >= min_cluster_size]
        for x in (left, right):
            if len(big) == 2:
                born[x], part_of[x], inner[x], leaves_at[x] = level, owner, [], {}
                inner[owner].append(x)
                todo.append((x, x))
            elif x in big:
                todo.append((x, owner))
            else:
                leaves_at[owner].update(dict.fromkeys(members[x], level))
    finite = [v for part in leaves_at.values() for v in part.values() if np.isfinite(v)]
    cap = max([*finite, *[b for b in born.values() if np.isfinite(b)], 1.0])
    lasting = {c: sum(min(v, cap) - born[c] for v in leaves_at[c].values()) + sum((min(born[x], cap) - born[c]) * len(members[x]) for x in inner[c]) for c in born}
    chosen, worth = set(), {}
    for c in sorted(born, key=lambda c: len(members[c])):
        below = sum(worth[x] for x in inner[c])
        if c != top and lasting[c] >= below:
            worth[c] = lasting[c]
            chosen -= {x for x in chosen if set(members[x]) <= set(members[c])}
            chosen.add(c)
        else:
            worth[c] = below
    for k, c in enumerate(sorted(chosen, key=lambda c: min(members[c]))):
        left_at = {p: v for x in born if set(members[x]) <= set(members[c]) for p, v in leaves_at[x].items()}
        most = max((min(v, cap) for v in left_at.values()), default=cap)
        for p, v in left_at.items():
            labels[p], sure[p] = k, min(v, most) / most if most > 0 else 1.0
    return labels, sure


def hdbscan(pairs: DataFrame, min_cluster_size: int = 3, min_samples: int | None = None) -> DataFrame:
    """(participant, label, probability, silhouette) from given distances; label -1 is noise, which the silhouette leaves out;
    null with fewer than two clusters."""
    ids, d = square(pairs)
    labels, sure = density_labels(d, min_cluster_size, min_samples)
    kept = labels >= 0
    quality = silhouette(d[kept][:, kept], labels[kept]) if len(set(labels[kept].tolist())) > 1 else None
    rows = [(str(i), int(x), float(p), quality) for i, x, p in zip(ids, labels, sure, strict=True)]
    return pairs.sparkSession.createDataFrame(rows, "participant string, label int, probability double, silhouette double")


def kmeans(vectors: DataFrame, n_clusters: int | None = None, most_k: int = 10, seed: int = 42, starts: int = 10) -> DataFrame:
    """(participant, label, silhouette): Lloyd's algorithm from k-means++ starts; without n_clusters the best silhouette."""
    ids, x = matrix(vectors)
    ks = [n_clusters] if n_clusters else range(2, max(2, min(most_k, len(ids) - 1)) + 1)
    labelled = [_lloyd(x, k, seed, starts)[0] for k in ks]
    quality, labels = max(zip(silhouettes(vectors.sparkSession, x, labelled), labelled, strict=True), key=lambda q: q[0])
    return _table(vectors.sparkSession, ids, labels, quality)


def _lloyd(x: np.ndarray, k: int, seed: int, starts: int) -> tuple[np.ndarray, float]:
    rng, best = np.random.default_rng(seed), (np.zeros(len(x), int), np.inf)
    for _ in range(starts):
        centres = [x[rng.integers(len(x))]]
        while len(centres) < k:
            far = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() else x[rng.integers(len(x))])
        c = np.array(centres)
        for _ in range(300):
            labels = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            new = np.array([x[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        inertia = ((x - c[labels]) ** 2).sum()
        if inertia < best[1]:
            best = labels, inertia
    return best


def elbow(vectors: DataFrame, most_k: int = 10, seed: int = 42) -> DataFrame:
    """Per k: inertia, silhouette, Calinski-Harabasz index."""
    ids, x = matrix(vectors)
    rows = []
    for k in range(2, max(2, min(most_k, len(ids) - 1)) + 1):
        labels, inertia = _lloyd(x, k, seed, 10)
        between = ((x - x.mean(0)) ** 2).sum() - inertia
        rows.append((k, float(inertia), silhouettes(vectors.sparkSession, x, [labels])[0], float(between / (k - 1) / (inertia / (len(ids) - k))) if inertia > 0 and len(ids) > k else None))
    return vectors.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, calinski_harabasz double")


def pca(vectors: DataFrame, n_components: int = 2, use_clr: bool = False, standardise: bool = True, key: str = "participant") -> tuple[DataFrame, DataFrame]:
    """(projections: key, component, value; loadings: component, dimension, loading, ratio, cumulative).

    Only the d x d covariance reaches the driver, from one aggregation over any number of rows. Population deviations; the
    largest loading of a component is positive.
    """
    from textloom.functions.vectors import clr

    spark = vectors.sparkSession
    v = vectors.select(key, (clr(F.col("v")) if use_clr else F.col("v")).alias("v"))
    n = len(v.first().v)
    ks = range(n)
    s = v.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("v")[i]).alias(f"m{i}") for i in ks], *[F.covar_pop(F.col("v")[i], F.col("v")[j]).alias(f"c{i}_{j}") for i in ks for j in range(i, n)]).first()
    mean = np.array([s[f"m{i}"] for i in ks])
    cov = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] for j in ks] for i in ks], float)
    scale = np.sqrt(np.diag(cov)) if standardise else np.ones(n)
    scale[scale == 0] = 1
    values, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-values)[:n_components]
    ratio, axes = values[order] / max(values.sum(), 1e-300), axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])
    place = [sum(((F.col("v")[i] - float(mean[i])) / float(scale[i]) * float(axes[i, c]) for i in ks), F.lit(0.0)) for c in range(axes.shape[1])]
    out = v.select(key, F.posexplode(F.array(*place)).alias("component", "value"))
    rows = [(c, i, float(axes[i, c]), float(ratio[c]), float(ratio[: c + 1].sum())) for c in range(axes.shape[1]) for i in ks]
    return out, spark.createDataFrame(rows, "component int, dimension int, loading double, ratio double, cumulative double")


def scaled(d: np.ndarray) -> np.ndarray:
    """Two coordinates that keep the distances as well as any."""
    n = len(d)
    if not n:
        return np.zeros((0, 2))
    centre = np.eye(n) - 1 / n
    values, axes = np.linalg.eigh(-centre @ d**2 @ centre / 2)
    order = np.argsort(-values)[:2]
    xy = axes[:, order] * np.sqrt(np.maximum(values[order], 0))
    return np.pad(xy * np.sign(xy[np.abs(xy).argmax(0), range(xy.shape[1])] + 1e-300), ((0, 0), (0, 2 - xy.shape[1])))


def classical_mds(pairs: DataFrame) -> DataFrame:
    """(participant, x, y): two coordinates that keep the distances as well as any; largest coordinate of an axis positive."""
    ids, d = square(pairs)
    xy = scaled(d)
    return pairs.sparkSession.createDataFrame([(str(i), *map(float, p)) for i, p in zip(ids, xy, strict=True)], "participant string, x double, y double")


def vector_map(vectors: DataFrame, key: str = "participant") -> DataFrame:
    """What classical_mds gives for the Euclidean distances of the vectors: their two main axes, from one aggregation over them."""
    v = vectors.where(F.col(key).isNotNull())
    if v.limit(1).count() == 0:
        return v.sparkSession.createDataFrame([], "participant string, x double, y double")
    placed = pca(v, 2, standardise=False, key=key)[0].groupBy(key).agg(*[F.max(F.when(F.col("component") == i, F.col("value"))).alias(c) for i, c in enumerate("xy")])
    first = placed.agg(*[F.min(F.struct((-F.round(F.abs(c), 9)).alias("far"), F.col(key).alias("k"), F.col(c).alias("c"))).alias(c) for c in "xy"]).first()
    way = {c: -1.0 if first[c].c is not None and first[c].c < 0 else 1.0 for c in "xy"}
    return placed.select(F.col(key).cast("string").alias("participant"), *[(F.coalesce(c, F.lit(0.0)) * way[c]).alias(c) for c in "xy"])


def leaf_order(pairs: DataFrame, method: str = "average") -> list:
    """Ids in the order of the dendrogram's leaves, for heat maps."""
    ids, d = square(pairs)
    leaves = {i: [i] for i in range(len(ids))}
    for step, (a, b, *_) in enumerate(linkage(d, method)):
        leaves[len(ids) + step] = leaves.pop(a) + leaves.pop(b)
    return [ids[i] for part in leaves.values() for i in part]
