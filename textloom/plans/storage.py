"""Cutting lineage in storage that outlives executors."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode, where it is unset, one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"textloom-{os.getuid()}-checkpoints")


def materialise(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_object(spark: SparkSession, value: Any) -> Broadcast:
    """An object of a class of ours for all tasks; the class goes along, as executors needn't have the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def broadcast_value(shared: Broadcast) -> Any:
    """What broadcast_object was given; to be called once per task."""
    return pickle.loads(shared.value)


class Rounds:
    """Tables of an iteration, each written to the shared folder in place of the one before, which is removed. What a table is
    made of besides the last one has to lie elsewhere. The last table stays."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.path = spark, os.path.join(shared_folder(spark), f"rounds-{uuid.uuid4().hex}"), None
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        path, self.count = f"{self.folder}-{self.count}", self.count + 1
        df.write.parquet(path)
        if self.path:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)
