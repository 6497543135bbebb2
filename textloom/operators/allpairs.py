"""All pairs of vectors without a table of them: the vectors are broadcast as one matrix, and a task makes the distances of its
rows to all later rows a tile at a time. So memory is a tile's, however many vectors there are.

Distances are made in the order of the expressions in functions.vectors, to the last digit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.plans.storage import broadcast_object, broadcast_value

#: Distances of a tile, and of a task.
TILE, TASK = 1 << 17, 20_000_000


@dataclass(frozen=True)
class Points:
    """Vectors as columns of x, in the order of their ids. `place` numbers distinct ids. `size` is the number of a vector's
    elements, NaN with a null among them, and None if that is the same and known for all."""

    x: np.ndarray
    place: np.ndarray
    size: np.ndarray | None
    cosine: bool

    def __len__(self) -> int:
        return self.x.shape[1]

    def tile(self, a, b) -> np.ndarray:
        """Distances of the vectors a (rows) and b (columns), each a slice or an array of positions."""
        shape = (len(self.place[a]), len(self.place[b]))
        total, length_a, length_b = np.zeros(shape), np.zeros((shape[0], 1)), np.zeros(shape[1])
        if self.cosine:
            for row in self.x:
                total += row[a][:, None] * row[b]
                length_a += row[a][:, None] * row[a][:, None]
                length_b += row[b] * row[b]
            lengths = np.sqrt(length_a) * np.sqrt(length_b)
            return 1 - np.divide(total, lengths, out=np.zeros(shape), where=lengths != 0)
        gap = np.empty(shape)
        for row in self.x:
            np.subtract(row[a][:, None], row[b], out=gap)
            gap *= gap
            total += gap
        return np.sqrt(total, out=total)

    def known(self, a, b) -> np.ndarray | None:
        """Which of a tile's distances there are; None for all."""
        return None if self.size is None else self.size[a][:, None] == self.size[b]

    def rows(self, first: int, last: int) -> Iterator[tuple[int, int]]:
        """Ranges of rows whose distances to all later vectors make a tile."""
        while first < last:
            end = min(last, first + max(1, TILE // max(1, len(self) - first)))
            yield first, end
            first = end


def collected(vectors: DataFrame, metric: str = "euclidean", key: str = "participant") -> tuple[pa.Array, Points]:
    """Ids in order, and their vectors (column v). Rows without an id are left out."""
    v = V.clr(F.col("v")) if metric == "aitchison" else V.doubles(F.col("v"))
    found = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), v.alias("v")).orderBy("k").toArrow()
    ids, lists = (_whole(found.column(c)) for c in ("k", "v"))
    n = len(ids)
    sizes = np.array([len(x) if x is not None and None not in x else np.nan for x in lists.to_pylist()]) if lists.null_count or lists.flatten().null_count else np.diff(lists.offsets.to_numpy()).astype(float)
    width = int(np.nanmax(sizes)) if n and not np.isnan(sizes).all() else 0
    if (sizes == width).all():
        x, size = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float).reshape(n, width), None
    else:
        x, size = np.zeros((n, width)), sizes
        for i in np.flatnonzero(~np.isnan(sizes)):
            x[i, : int(sizes[i])] = lists[int(i)].as_py()
    names = ids.to_pylist()
    place = np.cumsum([i > 0 and names[i] != names[i - 1] for i in range(n)], dtype=np.int64) if n else np.zeros(0, np.int64)
    return ids, Points(np.ascontiguousarray(x.T), place, size, metric == "cosine")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def spans(n: int, parts: int) -> list[tuple[int, int]]:
    """Ranges of rows with about as many pairs each."""
    done = np.cumsum(np.arange(n - 1, -1, -1, dtype=np.int64))
    ends = [0, *(np.searchsorted(done, done[-1] * k / parts) + 1 if n else 0 for k in range(1, parts)), n]
    return [(int(a), int(min(b, n))) for a, b in zip(ends, ends[1:], strict=False)]


def n_parts(spark: SparkSession, n: int) -> int:
    return max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-n * (n - 1) // 2 // TASK))))


def over_spans(spark: SparkSession, points: Points, work: Callable[[Points, int, int], Any], ranges: list[tuple[int, int]] | None = None) -> list:
    """What work(points, first, last) gives for ranges of rows that are all rows together, one task each; by default ranges
    with about as many pairs each."""
    shared, ranges = broadcast_object(spark, points), ranges or spans(len(points), n_parts(spark, len(points)))
    return spark.sparkContext.parallelize(ranges, len(ranges)).map(lambda s: work(broadcast_value(shared), *s)).collect()


def pairs(vectors: DataFrame, metric: str = "euclidean", key: str = "participant") -> DataFrame:
    """(a, b, d) of every pair a < b; d is null where a vector has a null or both differ in their number of elements."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    ids, points = collected(vectors, metric, key)
    parts = n_parts(spark, len(ids))
    shared, ranges = broadcast_object(spark, (ids, points)), spans(len(ids), parts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = broadcast_value(shared)
        for part in (i for batch in batches for i in batch.column(0).to_pylist()):
            for first, end in points.rows(*ranges[part]):
                a, b = np.arange(first, end), np.arange(first + 1, len(points))
                later = points.place[b] > points.place[a][:, None]
                d, known = points.tile(slice(first, end), slice(first + 1, None)), points.known(a, b)
                i, j = np.nonzero(later)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(a[i])), ids.take(pa.array(b[j])), pa.array(d[later], mask=None if known is None else ~known[later]),
                ], names=["a", "b", "d"])

    return spark.range(0, parts, 1, parts).mapInArrow(emit, f"a {kind}, b {kind}, d double")


def _bits(d: np.ndarray) -> np.ndarray:
    """Numbers in the order of the distances, one for each."""
    raw = np.where(np.isnan(d), np.nan, d).view(np.uint64)
    return np.where(raw >> 63, ~raw, raw | np.uint64(1 << 63))


def _value(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ (2**64 - 1)
    return float(np.array([raw], np.uint64).view(float)[0])


def _given(points: Points, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distances that there are, and their rows and columns."""
    for start, end in points.rows(first, last):
        a, b = np.arange(start, end), np.arange(start + 1, len(points))
        later = points.place[b] > points.place[a][:, None]
        known = points.known(a, b)
        i, j = np.nonzero(later if known is None else later & known)
        yield points.tile(slice(start, end), slice(start + 1, None))[i, j], a[i], b[j]


def summary(vectors: DataFrame, metric: str = "euclidean", key: str = "participant") -> DataFrame:
    """One row over all pairs: n_pairs, mean, median, min, max, and the closest and farthest pair, the first in order on ties.

    The median is found by its digits: distances are counted by the next 16 bits of those that share the ones found so far.
    """
    ids, points = collected(vectors, metric, key)
    same = np.unique(points.place, return_counts=True)[1].astype(object)

    def count(wanted: list[int], depth: int):
        def work(points: Points, first: int, last: int):
            n, total, near, far, seen = 0, 0.0, None, None, {w: np.zeros(1 << 16, np.int64) for w in wanted}
            for d, a, b in _given(points, first, last):
                if not len(d):
                    continue
                bits = _bits(d)
                for w in wanted:
                    own = bits if not depth else bits[bits >> np.uint64(64 - 16 * depth) == np.uint64(w)]
                    seen[w] += np.bincount(((own >> np.uint64(48 - 16 * depth)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
                if not depth:
                    n, total = n + len(d), total + float(d.sum())
                    low, high = int(bits.argmin()), int(bits.argmax())
                    near = min(near or (np.inf,), (int(bits[low]), int(a[low]), int(b[low])))
                    far = min(far or (np.inf,), (-int(bits[high]), int(a[high]), int(b[high])))
            return n, total, near, far, {w: (np.flatnonzero(c), c[c > 0]) for w, c in seen.items()}

        return over_spans(vectors.sparkSession, points, work)

    parts, wanted = count([0], 0), [0]
    n = sum(p[0] for p in parts)
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"n_pairs long, mean double, median double, min double, max double, closest_a {kind}, closest_b {kind}, farthest_a {kind}, farthest_b {kind}"
    every = int(sum(same) ** 2 - sum(same**2)) // 2 if len(same) else 0
    if not n:
        return vectors.sparkSession.createDataFrame([(every, *[None] * 8)], schema)
    mean = sum(p[1] for p in parts) / n
    near, far = (min(p[k] for p in parts if p[k]) for k in (2, 3))
    ranks, found = [(n - 1) // 2, n // 2], [0, 0]
    for depth in range(4):
        sums = {w: np.zeros(1 << 16, np.int64) for w in wanted}
        for p in parts:
            for w, (at, c) in p[4].items():
                sums[w][at] += c
        for k, w in enumerate(list(found)):
            upto = np.cumsum(sums[w])
            digit = int(np.searchsorted(upto, ranks[k], "right"))
            ranks[k] -= int(upto[digit - 1]) if digit else 0
            found[k] = w << 16 | digit
        wanted = sorted(set(found))
        if depth < 3:
            parts = count(wanted, depth + 1)
    row = (every, mean, (_value(found[0]) + _value(found[1])) / 2, _value(near[0]), _value(-far[0]), *(ids[i].as_py() for i in (*near[1:], *far[1:])))
    return vectors.sparkSession.createDataFrame([row], schema)


def by_group(vectors: DataFrame, groups: DataFrame, metric: str = "euclidean", key: str = "participant") -> DataFrame:
    """(ga, gb, n, known, total): per two groups the number of pairs of their members, of those with a distance, and their
    distances' sum. Groups are in no order; a pair's members differ. groups: (group, key); without a group rows are left out."""
    spark, names = vectors.sparkSession, groups.schema["group"].dataType.simpleString()
    member = groups.where(F.col("group").isNotNull()).select(F.col(key).alias("_member"), "group")
    ids, points = collected(vectors.join(member, F.col(key) == F.col("_member")).select(F.struct("group", key).alias("k"), "v"), metric, "k")
    own = ids.field("group") if len(ids) else pa.array([], pa.string())
    people = ids.field(key).to_pylist() if len(ids) else []
    listed = own.to_pylist()
    code = np.cumsum([i > 0 and listed[i] != listed[i - 1] for i in range(len(listed))], dtype=np.int64)
    labels = [listed[i] for i in range(len(listed)) if not i or listed[i] != listed[i - 1]]
    numbers: dict = {}
    person = np.array([numbers.setdefault(p, len(numbers)) for p in people], np.int64)
    parts = n_parts(spark, len(points))
    shared, ranges = broadcast_object(spark, (points, code, person, labels)), spans(len(points), parts)
    schema, kind = f"ga {names}, gb {names}, n long, known long, total double", own.type

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, code, person, labels = broadcast_value(shared)

        def finished(g: int, sums: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(sums[0])
            sides = [pa.array([labels[x] for x in side], kind) for side in (np.full(len(at), g), at)]
            return pa.RecordBatch.from_arrays([*sides, *(pa.array(s[at].astype(np.int64)) for s in sums[:2]), pa.array(sums[2][at])], names=["ga", "gb", "n", "known", "total"])

        for part in (i for batch in batches for i in batch.column(0).to_pylist()):
            now, sums = -1, np.zeros((3, len(labels)))
            for first, end in points.rows(*ranges[part]):
                tile, known = points.tile(slice(first, end), slice(first + 1, None)), points.known(slice(first, end), slice(first + 1, None))
                for i in range(first, end):
                    if code[i] != now:
                        if now >= 0:
                            yield finished(now, sums)
                        now, sums = int(code[i]), np.zeros((3, len(labels)))
                    other = person[i + 1 :] != person[i]
                    there = other if known is None else other & known[i - first, i - first :]
                    groups_of, d = code[i + 1 :], tile[i - first, i - first :]
                    sums[0] += np.bincount(groups_of[other], minlength=len(labels))
                    sums[1] += np.bincount(groups_of[there], minlength=len(labels))
                    sums[2] += np.bincount(groups_of[there], d[there], len(labels))
            if now >= 0:
                yield finished(now, sums)

    return spark.range(0, parts, 1, parts).mapInArrow(add, schema).groupBy("ga", "gb").agg(*[F.sum(c).alias(c) for c in ("n", "known", "total")])
