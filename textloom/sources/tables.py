"""The engine's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by name; columns are pruned and filters pushed down by the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
