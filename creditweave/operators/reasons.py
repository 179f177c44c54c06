"""Per-row contributions: global importance, top reasons and their merge into scores.

A contribution frame has key columns and one array ``contributions``; position i belongs to
``labels[i]``. The array is as long as the model's encoded feature vector.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditweave.operators.contracts import SCORE_KEY, ContractError
from creditweave.schemas import REPORTS

REASONS = ("top_reason_1", "top_reason_2", "top_reason_3")


def linear_contributions(
    features: Column, coefficients: Sequence[float], means: Sequence[float]
) -> Column:
    """coefficient * (value - mean) per position of an array of feature values."""
    weights = F.array(*[F.struct(F.lit(float(c)).alias("w"), F.lit(float(m)).alias("m"))
                        for c, m in zip(coefficients, means, strict=True)])
    return F.zip_with(features, weights, lambda x, c: c["w"] * (x - c["m"]))


def feature_importance(rows: DataFrame, labels: Sequence[str], version: str) -> DataFrame:
    """Mean absolute contribution per label; labels shared by several positions add up.

    One aggregation with one sum per position: no row is copied per feature.
    """
    totals = rows.agg(
        *[F.avg(F.abs(F.col("contributions")[i])).alias(f"v{i}") for i in range(len(labels))]
    )
    entries = [
        F.struct(F.lit(label).alias("feature_name"), F.col(f"v{i}").alias("value"))
        for i, label in enumerate(labels)
    ]
    per_label = (
        totals.select(F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.feature_name")
        .agg(F.sum("e.value").alias("importance_value"))
        .where("importance_value > 0")
    )
    # One row per label, so the single window partition is as small as the model.
    order = W.partitionBy("model_version").orderBy(F.desc("importance_value"), "feature_name")
    return (
        per_label.withColumn("model_version", F.lit(version))
        .withColumn("importance_type", F.lit("mean_abs_shap"))
        .withColumn("rank", F.row_number().over(order))
        .select(*REPORTS["model_feature_importance"])
    )


def top_reasons(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The three largest positive contributions with distinct labels, NULL padded.

    Array functions only: rows are neither exploded nor shuffled.
    """
    label_array = F.array(*[F.lit(x) for x in labels])
    indexed = F.transform(
        F.col("contributions"), lambda x, i: F.struct((-x).alias("v"), i.alias("i"))
    )
    positive = F.array_sort(F.filter(indexed, lambda e: e["v"] < 0))
    ordered = F.array_distinct(F.transform(positive, lambda e: F.element_at(label_array, e["i"] + 1)))
    kept = [c for c in rows.columns if c != "contributions"]
    with_order = rows.select(*kept, ordered.alias("_labels"))
    return with_order.select(
        *kept,
        *[
            F.concat(F.lit("Higher risk: "), F.get("_labels", F.lit(i))).alias(name)
            for i, name in enumerate(REASONS)
        ],
    )


def missing_reason_keys(scores: DataFrame, reasons: DataFrame) -> DataFrame:
    return reasons.select(*SCORE_KEY).join(scores.select(*SCORE_KEY), list(SCORE_KEY), "left_anti")


def merge_reasons(scores: DataFrame, reasons: DataFrame, check: bool = True) -> DataFrame:
    """Put reasons into the score rows with the same key; other score rows stay as they are."""
    if check and not missing_reason_keys(scores, reasons).isEmpty():
        raise ContractError("Some reasons belong to no row of the score table")
    fresh = reasons.select(*SCORE_KEY, *[F.col(r).alias(f"_{r}") for r in REASONS], F.lit(True).alias("_hit"))
    joined = scores.join(fresh, list(SCORE_KEY), "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
            if c in REASONS
            else F.col(c)
            for c in scores.columns
        ]
    )
