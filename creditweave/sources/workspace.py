"""Intermediate results that several stages read, kept as Parquet in the shared folder.

A written table cuts the lineage, survives the loss of an executor, is read back with
column pruning, and carries its true size, so that Spark's own broadcast threshold
decides how it is joined.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


@dataclass(frozen=True)
class Stored:
    """A frame read back from the shared folder, with its exact row count."""

    frame: DataFrame
    rows: int


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches. Only local sessions may get one of their own."""
    folder = spark.conf.get(_SETTING, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"Set {_SETTING} to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/creditweave/{app}/{label}-{uuid.uuid4().hex}"


def store(frame: DataFrame, label: str = "stage", by: str | None = None) -> Stored:
    """Write a frame once and continue from the written copy."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    counter = Observation()
    writer = frame.observe(counter, F.count(F.lit(1)).alias("rows")).write
    (writer.partitionBy(by) if by else writer).parquet(path)
    return Stored(spark.read.schema(frame.schema).parquet(path), int(counter.get["rows"]))


def stored(frame: DataFrame | Stored, label: str = "stage") -> Stored:
    return frame if isinstance(frame, Stored) else store(frame, label)


def discard_all(spark: SparkSession) -> None:
    """Delete what this application stored."""
    app = spark.sparkContext.applicationId
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/creditweave/{app}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
