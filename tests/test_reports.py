import os

import pytest
from pyspark.sql import functions as F

from creditweave.sources.reports import ReportError, read_partitions, replace_partitions, write_table

ROWS = [("v1", 1, 0.5), ("v1", 2, 0.25), ("v2", 1, 0.75), ("003", 4, 1.0)]
SCHEMA = "model_version string, applicant_id long, score double"


def files(path):
    return {
        version: {f: os.stat(f"{path}/{version}/{f}").st_mtime_ns for f in os.listdir(f"{path}/{version}") if f.endswith(".parquet")}
        for version in os.listdir(path)
        if version.startswith("model_version=")
    }


@pytest.fixture
def table(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    write_table(frame, f"{tmp_path}/scores", ("model_version",))
    return f"{tmp_path}/scores", frame.schema


def test_other_partitions_keep_their_files(spark, table):
    path, schema = table
    before = files(path)
    replace_partitions(spark.createDataFrame([("v1", 9, 0.125), ("v3", 3, 0.5)], SCHEMA), path)
    after = files(path)
    assert set(after) == {f"model_version={v}" for v in ("v1", "v2", "v3", "003")}
    assert all(after[v] == before[v] for v in ("model_version=v2", "model_version=003"))
    assert not set(after["model_version=v1"]) & set(before["model_version=v1"])
    got = sorted(tuple(r) for r in read_partitions(spark, path, schema).collect())
    # A version that looks like a number stays text.
    assert got == [("003", 4, 1.0), ("v1", 9, 0.125), ("v2", 1, 0.75), ("v3", 3, 0.5)]


def test_rows_may_come_from_the_replaced_partition(spark, table):
    path, schema = table
    doubled = read_partitions(spark, path, schema).where("model_version = 'v1'").withColumn("score", F.col("score") * 2)
    replace_partitions(doubled, path)
    got = sorted(tuple(r) for r in read_partitions(spark, path, schema).collect())
    assert got == [("003", 4, 1.0), ("v1", 1, 1.0), ("v1", 2, 0.5), ("v2", 1, 0.75)]


def test_rows_that_name_no_partition_are_refused(spark, table):
    path, schema = table
    before = files(path)
    with pytest.raises(ReportError, match="0 rows"):
        replace_partitions(spark.createDataFrame([], SCHEMA), path)
    assert files(path) == before
