"""Exact evaluation metrics of binary risk scores, per group of predictions.

A prediction frame has the columns (SK_ID_CURR, target, probability) and any grouping
columns such as model_version and split. All of these are aggregations over one ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditweave.functions.expressions import col, ratio, tenth, top_rows
from creditweave.operators.ordering import ranked
from creditweave.schemas import RANK_METRICS, REPORTS
from creditweave.sources.workspace import Stored

GROUPS = ("model_version", "split")
TOP_RATE = 0.10


def prediction_frame(
    rows: DataFrame, probability: Column | str, *extra: Column | str, target: str = "TARGET"
) -> DataFrame:
    """The canonical frame: applicant, integer target, double probability, extra columns."""
    return rows.select(
        F.col("SK_ID_CURR").cast("long").alias("SK_ID_CURR"),
        F.col(target).cast("int").alias("target"),
        col(probability).cast("double").alias("probability"),
        *[col(e) for e in extra],
    )


def invalid_probabilities(rows: DataFrame, name: str = "probability") -> DataFrame:
    """Rows whose probability is missing, not finite or outside [0, 1]."""
    p = F.col(name)
    return rows.where(p.isNull() | F.isnan(p) | (p < 0) | (p > 1))


def risk_order(descending: bool = True) -> list[Column]:
    p = F.col("probability")
    return [p.desc() if descending else p.asc(), F.col("SK_ID_CURR").asc()]


def riskiest_first(
    predictions: DataFrame | Stored,
    groups: Sequence[str] = GROUPS,
) -> DataFrame:
    """Predictions ranked from the highest probability, with running target counts."""
    return ranked(predictions, groups, risk_order(), ["target"])


def score_curve(ranking: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """One row per distinct score: rows and positives at the score and down to it."""
    return (
        ranking.groupBy(*groups, "probability")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("target").alias("positives"),
            F.max("rank").alias("rows_down_to"),
            F.max("running_target").alias("positives_down_to"),
            F.max("group_rows").alias("group_rows"),
            F.max("group_target").alias("group_positives"),
        )
        .withColumn("group_negatives", F.col("group_rows") - F.col("group_positives"))
    )


def distinct_scores(predictions: DataFrame | Stored, groups: Sequence[str] = GROUPS) -> DataFrame:
    """The score curve without a ranking of rows.

    Rows are added up per score first, and the prefix sums run over the distinct scores; rows of equal
    score leave a task as one. `rows` and `positives` may be counted already.
    """
    rows = predictions.frame if isinstance(predictions, Stored) else predictions
    if "positives" not in rows.columns:
        rows = rows.withColumns({"rows": F.lit(1).cast("bigint"), "positives": F.col("target").cast("bigint")})
    per_score = rows.groupBy(*groups, "probability").agg(F.sum("rows").alias("size"), F.sum("positives").alias("hits"))
    placed = ranked(per_score, groups, [F.col("probability").desc()], ["size", "hits"])
    return placed.select(
        *groups,
        "probability",
        F.col("size").alias("rows"),
        F.col("hits").alias("positives"),
        F.col("running_size").alias("rows_down_to"),
        F.col("running_hits").alias("positives_down_to"),
        F.col("group_size").alias("group_rows"),
        F.col("group_hits").alias("group_positives"),
        (F.col("group_size") - F.col("group_hits")).alias("group_negatives"),
    )


def curve_measures() -> dict[str, Column]:
    """Aggregates over a score curve: all measures that need no row ranks."""
    p, positives = F.col("probability"), F.col("positives")
    squared = positives * F.pow(p - 1, F.lit(2)) + (F.col("rows") - positives) * F.pow(p, F.lit(2))
    size, total = F.max("group_rows"), F.max("group_positives")
    return {
        "rows": size,
        "positives": total,
        "average_score": ratio(F.sum(p * F.col("rows")), size),
        "positive_rate": ratio(total, size),
        "roc_auc": roc_auc(),
        "pr_auc": average_precision(),
        "brier_score": ratio(F.sum(squared), size),
        "min_predicted_probability": F.min(p),
        "max_predicted_probability": F.max(p),
    }


def roc_points(curve: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    return curve.select(
        *groups,
        F.col("probability").alias("threshold"),
        ratio(F.col("rows_down_to") - F.col("positives_down_to"), "group_negatives").alias(
            "false_positive_rate"
        ),
        ratio("positives_down_to", "group_positives").alias("true_positive_rate"),
    )


def pr_points(curve: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    return curve.select(
        *groups,
        F.col("probability").alias("threshold"),
        ratio("positives_down_to", "rows_down_to").alias("precision"),
        ratio("positives_down_to", "group_positives").alias("recall"),
    )


def _both_classes(value: Column) -> Column:
    """NULL when a group holds one class only."""
    both = (F.max("group_positives") > 0) & (F.max("group_positives") < F.max("group_rows"))
    return F.when(both, value)


def roc_auc() -> Column:
    """Aggregate over a score curve: tie-aware Mann-Whitney statistic."""
    negatives = F.col("rows") - F.col("positives")
    above = F.col("positives_down_to") - F.col("positives")
    wins = F.sum(negatives * (above + F.col("positives") / F.lit(2.0)))
    pairs = F.max("group_positives").cast("double") * F.max(
        F.col("group_rows") - F.col("group_positives")
    )
    return _both_classes(ratio(wins, pairs))


def average_precision() -> Column:
    """Aggregate over a score curve: sum of recall steps times precision."""
    steps = F.sum(F.col("positives") * ratio("positives_down_to", "rows_down_to"))
    return _both_classes(ratio(steps, F.max("group_positives")))


def metric_bundle(
    ranking: DataFrame, groups: Sequence[str] = GROUPS, capacity: float = TOP_RATE
) -> DataFrame:
    """One row per group with the eight rank and probability metrics.

    Two aggregations over the ranking: per distinct score, then per group.
    """
    chosen = F.col("rank") <= top_rows("group_rows", TOP_RATE)
    reviewed = F.col("rank") <= top_rows("group_rows", capacity)
    curve = ranking.groupBy(*groups, "probability").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("target").alias("positives"),
        F.max("rank").alias("rows_down_to"),
        F.max("running_target").alias("positives_down_to"),
        F.max("group_rows").alias("group_rows"),
        F.max("group_target").alias("group_positives"),
        F.sum(F.when(chosen, F.col("target")).otherwise(0)).alias("top_positives"),
        F.count_if(chosen).alias("top"),
        F.sum(F.when(reviewed, F.col("target")).otherwise(0)).alias("reviewed_positives"),
    )
    size, total = F.max("group_rows"), F.max("group_positives")
    precision = ratio(F.sum("top_positives"), F.sum("top"))
    return curve.groupBy(*groups).agg(
        *[measure.alias(name) for name, measure in curve_measures().items()],
        ratio(precision, ratio(total, size)).alias("top_decile_lift"),
        precision.alias("precision_at_top_decile"),
        F.coalesce(ratio(F.sum("reviewed_positives"), total), F.lit(0.0)).alias(
            "recall_at_manual_review_capacity"
        ),
    )


def metric_rows(bundle: DataFrame, created_at: str, groups: Sequence[str] = GROUPS) -> DataFrame:
    """The bundle in long form: one row per metric."""
    return bundle.unpivot(
        list(groups), list(RANK_METRICS), "metric_name", "metric_value"
    ).withColumn("created_at", F.lit(created_at))


def at_rate(
    ranking: DataFrame, rates: Sequence[float], groups: Sequence[str] = GROUPS
) -> DataFrame:
    """Precision, recall and lift among the top rows, for several selection rates."""
    measures, entries = [], []
    for i, rate in enumerate(rates):
        chosen = F.col("rank") <= top_rows("group_rows", rate)
        measures += [
            F.count_if(chosen).alias(f"n{i}"),
            F.sum(F.when(chosen, F.col("target")).otherwise(0)).alias(f"hits{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(float(rate)).alias("rate"),
                F.col(f"n{i}").alias("selected_count"),
                ratio(f"hits{i}", f"n{i}").alias("precision_at_rate"),
                F.coalesce(ratio(f"hits{i}", "positives"), F.lit(0.0)).alias("recall_at_rate"),
                ratio(ratio(f"hits{i}", f"n{i}"), ratio("positives", "rows")).alias("lift_at_rate"),
            )
        )
    totals = ranking.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("target").alias("positives"), *measures
    )
    return totals.select(*groups, F.explode(F.array(*entries)).alias("_e")).select(
        *groups, "_e.*"
    )


def with_tenth(
    predictions: DataFrame | Stored,
    name: str,
    descending: bool,
    groups: Sequence[str] = GROUPS,
) -> DataFrame:
    """Predictions with their deterministic rank bin 1..10."""
    rows = ranked(predictions, groups, risk_order(descending), ())
    return rows.withColumn(name, tenth("rank", "group_rows")).drop("rank", "group_rows")


def _tenths(binned: DataFrame, name: str, groups: Sequence[str]) -> DataFrame:
    """Counts per bin, with all ten bins of every group present."""
    counts = binned.groupBy(*groups, name).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("target").alias("positives"),
        F.sum("probability").alias("scores"),
    )
    grid = counts.select(*groups).distinct().withColumn(
        name, F.explode(F.sequence(F.lit(1), F.lit(10)))
    )
    return grid.join(counts, [*groups, name], "left").na.fill(0, ["n", "positives"])


def lift_by_decile(binned: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Default rate, lift and cumulative capture per score decile, 1 being the riskiest."""
    whole = W.partitionBy(*groups)
    upto = whole.orderBy("decile").rowsBetween(W.unboundedPreceding, 0)
    defaults = F.sum("positives").over(whole)
    portfolio = ratio(defaults, F.sum("n").over(whole))
    rate = ratio("positives", "n")
    table = _tenths(binned, "decile", groups).select(
        *groups,
        F.col("decile"),
        F.col("n").alias("applicant_count"),
        ratio("scores", "n").alias("average_score"),
        rate.alias("observed_default_rate"),
        portfolio.alias("portfolio_default_rate"),
        ratio(rate, portfolio).alias("lift"),
        ratio(F.sum("positives").over(upto), defaults).alias("cumulative_default_capture_rate"),
    )
    return table if groups != GROUPS else table.select(*REPORTS["model_lift_by_decile"])


def calibration_bins(binned: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    score, rate = ratio("scores", "n"), ratio("positives", "n")
    return _tenths(binned, "bin_id", groups).select(
        *groups,
        "bin_id",
        F.col("n").alias("applicant_count"),
        score.alias("average_predicted_score"),
        rate.alias("observed_default_rate"),
        (rate - score).alias("calibration_error"),
    )


def bin_errors(bins: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Mean, applicant-weighted and largest absolute calibration error."""
    error = F.abs("calibration_error")
    known = F.when(F.col("calibration_error").isNotNull(), F.col("applicant_count"))

    def or_zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    return bins.groupBy(*groups).agg(
        or_zero(F.avg(error)).alias("mean_absolute_bin_error"),
        or_zero(ratio(F.sum(error * F.col("applicant_count")), F.sum(known))).alias(
            "weighted_calibration_error"
        ),
        or_zero(F.max(error)).alias("max_absolute_bin_error"),
    )
