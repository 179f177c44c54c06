"""Report tables: declared column order, Parquet or CSV, and the dashboard bundle."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditweave.schemas import REPORTS

DASHBOARD_TABLES = (
    "credit_risk_scores",
    "model_metrics_summary",
    "model_threshold_metrics",
    "model_lift_by_decile",
    "model_calibration_bins",
    "model_confusion_matrix",
    "model_feature_importance",
    "segment_performance_summary",
)
# Tables whose size grows with the applicants; the others hold a few hundred rows.
_GROWING = {"credit_risk_scores"}


class ReportError(RuntimeError):
    """A report table is missing, or its columns differ from the declared ones."""


def in_report_order(frame: DataFrame, table: str) -> DataFrame:
    """Project to the declared columns; a missing column is an error."""
    missing = sorted(set(REPORTS[table]) - set(frame.columns))
    if missing:
        raise ReportError(f"{table} lacks the columns {missing}")
    return frame.select(*REPORTS[table])


def rows_frame(spark: SparkSession, rows: Iterable[Mapping[str, Any]], schema: str) -> DataFrame:
    """A small driver-made table with a fixed schema, e.g. one row per model candidate."""
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(row[c] for c in names) for row in rows], schema)


def write_table(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table directory with the rows of a frame."""
    frame.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def replace_partitions(frame: DataFrame, path: str, by: str = "model_version") -> None:
    """Replace those partitions of a stored table that the frame has rows for.

    Other partitions keep their files: nothing of them is read or written. New files take the place of old ones
    when the job commits. A frame without rows is an error, as it names no partition.
    """
    seen = Observation()
    counted = frame.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(by).isNull()).alias("unnamed"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if not seen.get["rows"] or seen.get["unnamed"]:
        raise ReportError(f"Rows that replace partitions need a {by}; got {seen.get['rows']} rows, {seen.get['unnamed']} without")


def read_partitions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A partitioned table with the declared column types; versions that look like numbers stay text."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def write_csv(frame: DataFrame, table: str, path: str) -> int:
    """Write one report as headered CSV and return the row count.

    Small summaries become one file; growing tables keep their partitions.
    """
    seen = Observation()
    ordered = in_report_order(frame, table).observe(seen, F.count(F.lit(1)).alias("rows"))
    if table not in _GROWING:
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite").option("header", True).csv(path)
    return int(seen.get["rows"])


def read_csv_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a headered CSV whose header must equal the schema, in order."""
    header = spark.read.option("header", True).csv(path).columns
    if header != schema.names:
        raise ReportError(f"{path} has columns {header}, expected {schema.names}")
    return spark.read.schema(schema).option("header", True).csv(path)


def relabel_version(frame: DataFrame, source: str, target: str) -> DataFrame:
    if source == target or "model_version" not in frame.columns:
        return frame
    version = F.col("model_version")
    return frame.withColumn("model_version", F.when(version == source, target).otherwise(version))


def replace_version_rows(existing: DataFrame, version: str, replacement: DataFrame) -> DataFrame:
    """Drop one model's rows and append the given ones."""
    kept = existing.where(~F.col("model_version").eqNullSafe(version))
    return kept.unionByName(replacement.select(*existing.columns))


def require_tables(tables: Mapping[str, DataFrame], names: Iterable[str]) -> None:
    missing = sorted(set(names) - set(tables))
    if missing:
        raise ReportError(f"The bundle lacks the tables {missing}")


def export_dashboard(
    tables: Mapping[str, DataFrame],
    folder: str,
    overrides: Mapping[str, DataFrame] | None = None,
    relabel: tuple[str, str] | None = None,
) -> dict[str, int]:
    """Write the eight dashboard tables as CSV and return their row counts.

    ``overrides`` replaces whole tables; ``relabel`` renames one model version in the rest.
    All columns are checked before the first file is written.
    """
    overrides = dict(overrides or {})
    require_tables({**tables, **overrides}, DASHBOARD_TABLES)
    bundle = {}
    for name in DASHBOARD_TABLES:
        frame = overrides.get(name)
        if frame is None:
            frame = tables[name] if relabel is None else relabel_version(tables[name], *relabel)
        bundle[name] = in_report_order(frame, name)
    return {name: write_csv(frame, name, f"{folder.rstrip('/')}/{name}") for name, frame in bundle.items()}
