"""Places of graph nodes in a picture: by likeness of their labels, pushed apart, and grouped into named regions. A picture
holds few nodes, so they are collected behind a check of their number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import clustering as K
from textloom.operators import similarity as M

MOST_NODES = 5_000


def _unit(xy: np.ndarray) -> np.ndarray:
    """Each coordinate stretched to 0..1; one that doesn't vary becomes 0.5."""
    low, span = xy.min(0, initial=np.inf), np.ptp(xy, axis=0) if len(xy) else np.zeros(2)
    return np.where(span > 0, (xy - low) / np.where(span > 0, span, 1.0), 0.5)


def _collected(rows: DataFrame) -> tuple[list, np.ndarray]:
    found = rows.select("id", "x", "y").orderBy("id").limit(MOST_NODES + 1).collect()
    if len(found) > MOST_NODES:
        raise ValueError(f"at most {MOST_NODES} nodes")
    return [r.id for r in found], np.array([(r.x, r.y) for r in found], float).reshape(len(found), 2)


def _table(like: DataFrame, ids: list, xy: np.ndarray) -> DataFrame:
    return like.sparkSession.createDataFrame([(i, *map(float, p)) for i, p in zip(ids, xy, strict=True)], "id string, x double, y double")


def semantic_layout(nodes: DataFrame) -> DataFrame:
    """(id, x, y) within 0..1: labels that are written alike lie close, by multidimensional scaling of the cosine distances of
    their character trigrams. nodes: id, label."""
    rows = M.embed(nodes).join(nodes.select("id", "label"), "label").select("id", "weights").orderBy("id").limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError(f"at most {MOST_NODES} nodes")
    column = {g: k for k, g in enumerate(sorted({g for r in rows for g in r.weights}))}
    x = np.zeros((len(rows), len(column)))
    for i, r in enumerate(rows):
        x[i, [column[g] for g in r.weights]] = list(r.weights.values())
    return _table(nodes, [r.id for r in rows], _unit(K.scaled(np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)))))


def repel(positions: DataFrame, min_distance: float = 0.05, rounds: int = 50) -> DataFrame:
    """(id, x, y) within 0..1, nodes nearer than `min_distance` pushed apart. In a round every node moves by the mean of the
    pushes of all that are too near, half the missing distance each; nodes at one place are told apart by their order."""
    ids, xy = _collected(positions)
    angle = 2 * np.pi * np.arange(len(ids)) / max(1, len(ids))
    for _ in range(rounds if len(ids) > 1 else 0):
        gap = xy[:, None] - xy[None]
        far = np.hypot(gap[..., 0], gap[..., 1])
        near = (far < min_distance) & ~np.eye(len(ids), dtype=bool)
        if not near.any():
            break
        spread = np.stack([np.cos(angle), np.sin(angle)], 1)
        way = np.where((far > 1e-9)[..., None], gap / np.maximum(far, 1e-9)[..., None], (spread[:, None] - spread[None]) / 2)
        push = way * np.where(near, (min_distance - far) / 2, 0.0)[..., None]
        xy = xy + push.sum(1) / np.maximum(1, near.sum(1))[:, None]
    return _table(positions, ids, _unit(xy))


def regions(positions: DataFrame, min_cluster_size: int = 3, method: str = "hdbscan") -> DataFrame:
    """(id, region): groups of nodes that lie together, by density (-1 for nodes between them) or by merging into a third of
    the nodes' number, two at least. Fewer nodes than a region needs are one."""
    ids, xy = _collected(positions)
    if len(ids) < min_cluster_size:
        labels = np.zeros(len(ids), int)
    else:
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
        labels = K.density_labels(d, min_cluster_size, 2)[0] if method == "hdbscan" else K.cut(K.linkage(d), len(ids), max(2, len(ids) // min_cluster_size))
    return positions.sparkSession.createDataFrame([(i, int(x)) for i, x in zip(ids, labels, strict=True)], "id string, region int")


def region_centres(positions: DataFrame, found: DataFrame) -> DataFrame:
    """(region, x, y, nodes) of each region; nodes between regions have none."""
    return positions.join(found.where("region >= 0"), "id").groupBy("region").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("nodes"))
