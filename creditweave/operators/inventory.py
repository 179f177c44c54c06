"""Table profiles, grain checks and column inventories as aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditweave.functions.expressions import ratio
from creditweave.settings import Settings
from creditweave.sources.workspace import store

# Keys that one task counts.
KEYS_IN_TASK = 1 << 19


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often.

    Nearly all keys may differ, so the tasks that count them grow in number with the rows, not in memory. The keys
    are written first, which also frees what a join behind them holds.
    """
    kept = store(frame.select(*keys), "keys")
    dealt = kept.frame.repartition(max(1, math.ceil(kept.rows / KEYS_IN_TASK)), *keys)
    return dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def profile(name: str, frame: DataFrame, keys: Sequence[str], applicant: str = "SK_ID_CURR") -> DataFrame:
    """One row: rows, distinct applicants, duplicate keys, labeled rows.

    One pass over the table: rows per key, then totals over the keys. The applicant is part
    of most keys, so its distinct count is taken over the keys as well.
    """
    has_target, has_applicant = "TARGET" in frame.columns, applicant in frame.columns
    level = list(dict.fromkeys([*keys, *([applicant] if has_applicant else [])]))
    labels = [F.count("TARGET").alias("_labeled")] if has_target else []
    per_level = frame.groupBy(*level).agg(F.count(F.lit(1)).alias("_n"), *labels)
    if has_applicant and level != list(keys):
        # The key does not hold the applicant: count rows per key and applicants apart.
        per_key = per_level.groupBy(*keys).agg(
            F.sum("_n").alias("_n"), *([F.sum("_labeled").alias("_labeled")] if has_target else [])
        )
        applicants = per_level.agg(F.count_distinct(applicant).cast("long").alias("distinct_applicant_count"))
    else:
        per_key, applicants = per_level, None
    distinct = (
        F.count_distinct(applicant) if has_applicant and applicants is None else F.lit(None).cast("long")
    )
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    labeled = F.coalesce(F.sum("_labeled"), F.lit(0)) if has_target else F.lit(0).cast("long")
    table = per_key.agg(
        rows.alias("row_count"),
        distinct.alias("_applicants"),
        F.count_if(F.col("_n") > 1).alias("duplicate_key_count"),
        labeled.alias("target_non_null_count"),
        ((rows - labeled) if has_target else F.lit(0).cast("long")).alias("target_null_count"),
    )
    if applicants is None:
        table = table.withColumnRenamed("_applicants", "distinct_applicant_count")
    else:
        both = table.drop("_applicants").unionByName(applicants, allowMissingColumns=True)
        table = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return table.select(
        F.lit(name).alias("table_name"),
        "row_count",
        "distinct_applicant_count",
        "duplicate_key_count",
        F.lit(len(frame.columns)).alias("column_count"),
        F.lit(has_target).alias("has_target_column"),
        "target_non_null_count",
        "target_null_count",
    )


def column_counts(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, row_count, missing_count, distinct_value_count), exact, for all columns.

    The columns are stacked as text and counted per (column, value) before the shuffle; one
    aggregation with a distinct count per column would copy every row once per column.
    """
    columns = list(columns or frame.columns)
    doubles = {f.name for f in frame.schema if isinstance(f.dataType, T.DoubleType)}
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            # Adding zero turns -0.0, which equals 0.0, into the same text.
            (F.col(c) + F.lit(0.0) if c in doubles else F.col(c)).cast("string").alias("value"),
        )
        for c in columns
    ]
    per_value = (
        frame.select(F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.column_name", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_value.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
        F.count("value").alias("distinct_value_count"),
    )


def feature_inventory(
    name: str, frame: DataFrame, settings: Settings, is_mart: bool, created_at: str
) -> DataFrame:
    groups = settings.exclusion_groups()
    facts = frame.sparkSession.createDataFrame(
        [
            (f.name, f.dataType.simpleString(), is_mart and f.name not in groups, groups.get(f.name, ""))
            for f in frame.schema
        ],
        "column_name string, column_type string, is_model_feature boolean, exclusion_group string",
    )
    # One row per column on both sides; the facts are as small as the schema.
    return facts.join(F.broadcast(column_counts(frame)), "column_name", "left").select(
        F.lit(name).alias("table_name"),
        "column_name",
        "column_type",
        "is_model_feature",
        "exclusion_group",
        F.coalesce("missing_count", F.lit(0)).alias("missing_count"),
        ratio("missing_count", "row_count").alias("missing_rate"),
        F.coalesce("distinct_value_count", F.lit(0)).alias("distinct_value_count"),
        F.lit(created_at).alias("created_at_utc"),
    )
