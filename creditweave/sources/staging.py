"""CSV sources -> Parquet -> staging frames, with row reconciliation."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditweave.schemas import REPORTS, SOURCES, V1_SOURCES, staging_name
from creditweave.settings import Settings


class SourceError(RuntimeError):
    """A declared source is missing or does not match its schema."""


def timestamp_text() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


def required_sources(settings: Settings) -> tuple[str, ...]:
    return tuple(SOURCES) if settings.post_v1 else V1_SOURCES


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.exists(hadoop_path))


def require_files(spark: SparkSession, files: Mapping[str, str]) -> None:
    """Name every missing file in one error, before anything is written."""
    missing = [f"{name} ({path})" for name, path in files.items() if not path_exists(spark, path)]
    if missing:
        raise SourceError("Missing source files: " + ", ".join(sorted(missing)))


def without_nan(frame: DataFrame) -> DataFrame:
    """NaN and NULL both mean missing; keep only NULL."""
    doubles = {f.name for f in frame.schema if isinstance(f.dataType, T.DoubleType)}
    return frame.select(
        *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in doubles else c
          for c in frame.columns]
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV; columns are matched by header name, extra columns are left out."""
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(schema.names) - set(header))
    if missing:
        raise SourceError(f"{path} is missing columns: {missing}")
    kinds = {f.name: f.dataType for f in schema}
    as_read = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    rows = spark.read.schema(as_read).option("header", True).option("mode", "FAILFAST").csv(path)
    return without_nan(rows.select(*schema.names))


def ingest(
    spark: SparkSession,
    files: Mapping[str, str],
    parquet_dir: str,
    settings: Settings = Settings(),
    created_at: str | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rewrite every source as Parquet and return (staging frames, summary frame).

    CSV rows are counted while they are written, Parquet rows when read back.
    """
    names = required_sources(settings)
    undeclared = sorted(set(names) - set(files))
    if undeclared:
        raise SourceError(f"Sources without a file: {undeclared}")
    require_files(spark, {name: files[name] for name in names})
    created_at = created_at or timestamp_text()
    staging, counts = {}, []
    for name in names:
        target = f"{parquet_dir.rstrip('/')}/{name}"
        seen = Observation()
        source = read_csv(spark, files[name], SOURCES[name])
        source.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(target)
        table = read_parquet(spark, name, target)
        staging[staging_name(name)] = table
        table.createOrReplaceTempView(staging_name(name))
        counts.append(
            table.agg(F.count(F.lit(1)).alias("parquet_rows")).select(
                F.lit(name).alias("source_name"),
                F.lit(files[name].rsplit("/", 1)[-1]).alias("source_file"),
                F.lit(files[name]).alias("raw_path"),
                F.lit(target).alias("parquet_path"),
                F.lit(staging_name(name)).alias("staging_table"),
                F.lit(int(seen.get["rows"])).cast("long").alias("csv_rows"),
                "parquet_rows",
                F.col("parquet_rows").alias("staged_rows"),
                F.lit(created_at).alias("created_at_utc"),
            )
        )
    summary = counts[0]
    for part in counts[1:]:
        summary = summary.unionByName(part)
    return staging, summary.select(*REPORTS["ingestion_summary"])


def read_parquet(spark: SparkSession, source: str, path: str) -> DataFrame:
    return spark.read.schema(SOURCES[source]).parquet(path)


def load_staging(
    spark: SparkSession, parquet_dir: str, settings: Settings = Settings()
) -> dict[str, DataFrame]:
    """Staging frames of an earlier ingestion."""
    paths = {n: f"{parquet_dir.rstrip('/')}/{n}" for n in required_sources(settings)}
    require_files(spark, paths)
    return {staging_name(n): read_parquet(spark, n, p) for n, p in paths.items()}
