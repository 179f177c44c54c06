"""Choosing among few candidates by lexicographic metric keys, and stability summaries.

The frames here hold one row per candidate or per run, not per applicant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditweave.functions.expressions import ratio
from creditweave.schemas import REPORTS, STABILITY_METRICS


def candidate_key() -> list[Column]:
    """Best tree candidate first: never a constant score, then the rank metrics, then Brier."""
    varied = F.col("max_predicted_probability") > F.col("min_predicted_probability")
    best = ("pr_auc", "top_decile_lift", "recall_at_manual_review_capacity", "roc_auc")
    return [varied.desc(), *(F.col(m).desc_nulls_last() for m in best), F.col("brier_score").asc()]


def feature_set_key() -> list[Column]:
    best = ("pr_auc", "top_decile_lift", "recall_at_review_capacity", "roc_auc")
    return [
        *(F.col(f"validation_{m}").desc_nulls_last() for m in best),
        F.col("validation_brier_score").asc(),
        F.col("feature_count").asc(),
    ]


def stability_key() -> list[Column]:
    return [
        F.col("validation_pr_auc_mean").desc_nulls_last(),
        F.col("validation_win_rate").desc(),
        F.col("validation_top_decile_lift_mean").desc_nulls_last(),
        F.col("validation_recall_at_review_capacity_mean").desc_nulls_last(),
        F.col("validation_roc_auc_mean").desc_nulls_last(),
        F.col("validation_brier_score_mean").asc(),
        F.col("validation_pr_auc_std").asc(),
        F.col("feature_count").asc(),
    ]


def place(rows: DataFrame, key: Sequence[Column], within: Sequence[str], name: str) -> DataFrame:
    """1 for the best row within each group. The key should end in a unique column."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*within).orderBy(*key)))


def seed_winners(runs: DataFrame) -> DataFrame:
    """Mark the feature set that wins on validation for every seed."""
    key = [*feature_set_key(), F.col("feature_set").asc()]
    placed = place(runs, key, ["seed"], "_place")
    return placed.withColumn("seed_validation_winner", F.col("_place") == 1).drop("_place")


def stability_summary(runs: DataFrame, created_at: str) -> DataFrame:
    """Mean and population deviation of every metric per feature set, wins and gaps."""
    marked = seed_winners(runs)
    table = marked.groupBy("feature_set").agg(
        F.min("feature_count").alias("feature_count"),
        F.min("feature_limit").alias("feature_limit"),
        F.count_distinct("seed").alias("seed_count"),
        F.count_if("seed_validation_winner").alias("validation_win_count"),
        *[F.avg(m).alias(f"{m}_mean") for m in STABILITY_METRICS],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in STABILITY_METRICS],
    )
    pr_gap = F.col("test_pr_auc_mean") - F.col("validation_pr_auc_mean")
    ev_gap = F.col("test_balanced_ev_per_applicant_mean") - F.col(
        "validation_balanced_ev_per_applicant_mean"
    )
    table = table.select(
        "*",
        ratio("validation_win_count", "seed_count").alias("validation_win_rate"),
        pr_gap.alias("pr_auc_generalization_gap"),
        F.abs(pr_gap).alias("abs_pr_auc_generalization_gap"),
        ev_gap.alias("balanced_ev_generalization_gap"),
        F.abs(ev_gap).alias("abs_balanced_ev_generalization_gap"),
        F.lit(created_at).alias("created_at"),
        F.lit(0).alias("_all"),
    )
    placed = place(table, [*stability_key(), F.col("feature_set").asc()], ["_all"], "_place")
    return placed.withColumn("selected", F.col("_place") == 1).select(
        *REPORTS["model_stability_summary"]
    )


def selected_set(runs: DataFrame) -> DataFrame:
    """Mark the best feature set of one run (no seeds involved)."""
    key = [*feature_set_key(), F.col("feature_set").asc()]
    placed = place(runs.withColumn("_all", F.lit(0)), key, ["_all"], "_place")
    return placed.withColumn("selected", F.col("_place") == 1).drop("_place", "_all")
