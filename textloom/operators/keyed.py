"""Joins and ranks over keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.storage import materialise


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key.

    The keys are compared as one struct. Groups that come from an aggregation by the same keys would otherwise go into the
    join without a shuffle of their own; but only where both sides are plain shuffles can adaptive execution split a hot
    key's rows over many tasks, each with a copy of that key's single group row. Null keys match nothing.
    """
    key = F.struct(*[F.col(k) for k in keys]).alias("_join_key")
    known = groups.where(" and ".join(f"`{k}` is not null" for k in keys))
    rest = [c for c in groups.columns if c not in keys]
    return rows.select("*", key).join(known.select(key, *rest), "_join_key", how).drop("_join_key")


def join_checked(rows: DataFrame, groups: DataFrame, keys: Sequence[str], most: int, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key: by broadcast if that table, counted first, has at most `most` rows, else as
    join_groups does. The groups should be materialised, as they are read twice."""
    if groups.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(groups), list(keys), how)
    return join_groups(rows, groups, keys, how)


def running_total(rows: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Add the sum of `value` over the rows ahead in each key, by the order column; 0 for the first. Rows of a key are spread
    over tasks by ranges of the order column, so not even three keys that hold all rows gather in three tasks: what comes ahead
    of a range is told by sums per key and range. Equal order values within a key aren't allowed; null keys neither."""
    placed = materialise(rows.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(offsets, [*keys, "_range"]).withColumn(name, F.col("_ahead") + F.col("_within")).drop("_range", "_ahead", "_within")


def rank_within(rows: DataFrame, key: str, order: Sequence[str], name: str, slice_rows: int = 500_000, most_keys: int = 200_000) -> DataFrame:
    """Add a dense zero-based row number within each key, without bringing a key's rows into one task.

    Rows are spread by the hash of the order columns over as many slices as the key's count calls for, of about `slice_rows`
    each; numbers count on from slice to slice, so a key's rows are ranked by (slice, order), which is a total order as far
    as the order columns are. Rows with a null key are left out. The rows should be materialised, as they are counted first.
    """
    slices = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("_slices"))
    sliced = join_checked(rows, slices, [key], most_keys).withColumn("_slice", F.pmod(F.xxhash64(*order), F.col("_slices"))).drop("_slices")
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(key, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*order)) - 1
    return (
        sliced.withColumn("_local", local)
        .join(offsets, [key, "_slice"])
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_slice", "_offset", "_local")
    )
