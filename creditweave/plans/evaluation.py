"""Evaluation, calibration, batch scoring, explanation and the dashboard bundle."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.functions.labels import forbidden_text
from creditweave.operators import calibration as cal
from creditweave.operators import contracts, metrics, models, policy, reasons, scoring
from creditweave.operators.segments import segment_performance
from creditweave.operators.splits import require_split_rows, segment_rows, split_rows
from creditweave.plans.training import checked, comparison, predict
from creditweave.schemas import REPORTS
from creditweave.settings import (
    BASELINE_VERSION,
    DASHBOARD_VERSION,
    HOLDOUT_SCORING,
    SEGMENT_DIMENSIONS,
    TEST_POPULATION,
    TREES_TYPE,
    TREES_VERSION,
    UNLABELED_SCORING,
    Settings,
)
from creditweave.sources.artifacts import (
    CalibrationArtifact,
    ModelArtifact,
    load_calibration,
    load_model,
    save_calibration,
    uncalibrated,
)
from creditweave.sources.reports import (
    export_dashboard,
    in_report_order,
    replace_version_rows,
    require_tables,
)
from creditweave.sources.staging import timestamp_text
from creditweave.sources.workspace import Stored, store

REPORTED = "split <> 'train'"


def artifact_rows(mart: DataFrame, artifact: ModelArtifact) -> DataFrame:
    """Mart rows of a model's saved split, written once and checked against the saved ids."""
    missing = sorted(set(artifact.feature_columns) - set(mart.columns))
    if missing:
        raise contracts.ContractError(f"The model reads columns that the mart lacks: {missing}")
    rows = store(split_rows(mart, artifact.splits, artifact.feature_columns), "split-rows").frame
    require_split_rows(rows, artifact.splits)
    return rows


@dataclass(frozen=True)
class Evaluation:
    tables: dict[str, DataFrame]
    thresholds: dict[str, policy.Thresholds]
    selected_model_type: str
    predictions: Stored


def run_evaluation(
    mart: DataFrame,
    baseline: ModelArtifact,
    trees: ModelArtifact,
    saved_comparison: DataFrame,
    settings: Settings = Settings(),
) -> Evaluation:
    """Re-predict with both saved models and derive every report table.

    Thresholds come from the selected model's validation scores only.
    """
    contracts.require_same_surface(
        {"feature_columns": baseline.feature_columns}, {"feature_columns": trees.feature_columns}
    )
    contracts.require_same_splits(baseline.splits, trees.splits)
    created_at = timestamp_text()
    rows = artifact_rows(mart, baseline)
    kept = checked(
        predict(baseline.model, rows, BASELINE_VERSION).unionByName(
            predict(trees.model, rows, TREES_VERSION)
        ),
        "evaluation predictions",
    )
    bundle = metrics.metric_bundle(metrics.riskiest_first(kept), capacity=settings.review_capacity)
    measured = store(metrics.metric_rows(bundle, created_at), "metrics").frame
    recomputed = comparison(measured, BASELINE_VERSION, TREES_VERSION).first()["selected_model_type"]
    contracts.selected_model_type(saved_comparison, recomputed)
    version = TREES_VERSION if recomputed == TREES_TYPE else BASELINE_VERSION
    chosen = store(kept.frame.where(F.col("model_version") == version).where(REPORTED), "reported")
    validation = store(chosen.frame.where("split = 'validation'"), "validation")
    pairs = policy.scenario_thresholds(validation, settings.thresholds)
    tables = {
        "model_metrics_summary": measured,
        "model_threshold_metrics": policy.threshold_metrics(
            chosen.frame, pairs, settings.threshold_version, created_at, settings.assumptions
        ),
        "model_confusion_matrix": policy.confusion_matrix(chosen.frame, pairs),
        "model_lift_by_decile": metrics.lift_by_decile(metrics.with_tenth(chosen, "decile", True)),
        "model_calibration_bins": metrics.calibration_bins(
            metrics.with_tenth(chosen, "bin_id", False)
        ),
    }
    ordered = {name: in_report_order(frame, name) for name, frame in tables.items()}
    return Evaluation(ordered, pairs, recomputed, kept)


def with_methods(rows: DataFrame, fitted: cal.Calibrators) -> DataFrame:
    """Every prediction once per calibration method, the method as the model version."""
    parts = [
        cal.apply_method(rows, method, fitted).select(
            F.lit(method).alias("model_version"),
            "split",
            "SK_ID_CURR",
            "target",
            F.col("calibrated").alias("probability"),
        )
        for method in cal.METHODS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def method_metrics(long: Stored, capacity: float) -> tuple[DataFrame, DataFrame]:
    """(metrics with bin errors, bins) per method and split."""
    bins = store(metrics.calibration_bins(metrics.with_tenth(long, "bin_id", False)), "bins").frame
    bundle = metrics.metric_bundle(metrics.riskiest_first(long), capacity=capacity)
    return bundle.join(metrics.bin_errors(bins), list(metrics.GROUPS)), bins


@dataclass(frozen=True)
class Calibration:
    artifact: CalibrationArtifact
    comparison: DataFrame
    bins: DataFrame


def run_calibration(
    mart: DataFrame, trees: ModelArtifact, folder: str, settings: Settings = Settings()
) -> Calibration:
    """Fit the calibrators on validation, compare all methods on both reporting splits, save."""
    created_at = timestamp_text()
    rows = artifact_rows(mart, trees).where(REPORTED)
    raw = checked(predict(trees.model, rows, trees.model_version), "calibration scores")
    fitted = cal.fit_calibrators(raw.frame.where("split = 'validation'"))
    long = checked(with_methods(raw.frame, fitted), "calibrated scores")
    wide, bins = method_metrics(long, settings.review_capacity)

    def labelled(frame: DataFrame) -> DataFrame:
        return (
            frame.withColumnRenamed("model_version", "calibration_method")
            .withColumn("model_version", F.concat_ws("_", F.lit(trees.model_version), "calibration_method"))
            .withColumn("base_model_version", F.lit(trees.model_version))
            .withColumn("created_at", F.lit(created_at))
        )

    compared = store(
        labelled(wide).select(*REPORTS["model_calibration_comparison"]), "comparison"
    ).frame
    method = cal.choose_method(cal.brier_by_method(compared))
    artifact = CalibrationArtifact(trees.model_version, method, fitted, created_at)
    save_calibration(artifact, mart.sparkSession, folder)
    return Calibration(
        artifact, compared, labelled(bins).select(*REPORTS["model_calibration_bins_comparison"])
    )


@dataclass(frozen=True)
class Selected:
    """The model that scoring uses, with its calibration."""

    artifact: ModelArtifact
    calibration: CalibrationArtifact


def load_selected(folder: str, saved_comparison: DataFrame, calibrated: bool = True) -> Selected:
    spark = saved_comparison.sparkSession
    kind = contracts.selected_model_type(saved_comparison)
    artifact = load_model(spark, folder, kind)
    found = (
        load_calibration(spark, folder, artifact.model_version, TREES_TYPE, kind)
        if calibrated
        else uncalibrated(artifact.model_version)
    )
    return Selected(artifact, found)


def run_scoring(
    mart: DataFrame,
    selected: Selected,
    thresholds: DataFrame,
    scored_at: datetime | None = None,
) -> Stored:
    """Score the labeled holdout and the unlabeled population into one score table."""
    artifact = selected.artifact
    version, low, high = contracts.balanced_policy(thresholds, artifact.model_version)
    features = artifact.feature_columns
    holdout_ids = artifact.splits.where("split = 'test'")
    holdout = split_rows(mart, holdout_ids, features)
    require_split_rows(holdout, holdout_ids)
    fresh = mart.where(F.col("source_population") == TEST_POPULATION)
    facts = fresh.agg(F.count(F.lit(1)).alias("n"), F.count("TARGET").alias("labeled")).first()
    if not facts["n"] or facts["labeled"]:
        raise contracts.ContractError(
            f"The unlabeled population needs rows without TARGET, got {facts['n']} rows, "
            f"{facts['labeled']} labeled"
        )

    def population(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("SK_ID_CURR", "TARGET", F.lit(name).alias("scoring_population"), *features)

    both = population(holdout, HOLDOUT_SCORING).unionByName(population(fresh, UNLABELED_SCORING))
    raw = metrics.prediction_frame(
        artifact.model.with_probability(both), "probability", "scoring_population"
    )
    scored = store(
        cal.apply_method(raw, selected.calibration.selected_method, selected.calibration.fitted),
        "scored",
    )
    for name in ("probability", "calibrated"):
        contracts.raise_violations(
            contracts.probability_violations(scored.frame, name, "scores"), "Invalid probabilities"
        )
    moment = scored_at or datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)
    table = store(
        scoring.score_rows(
            scored,
            policy.Thresholds(low, high),
            version,
            artifact.model_version,
            selected.calibration.selected_method,
            moment,
        ),
        "scores",
    )
    contracts.raise_violations(contracts.score_violations(table.frame), "Score table is invalid")
    return table


@dataclass(frozen=True)
class Explanation:
    scores: Stored
    importance: DataFrame


def require_plain_labels(artifact: ModelArtifact, labels: list[str], settings: Settings) -> None:
    """No excluded field may be named by an input of the model or by its label.

    All explanation texts are made of these labels, so this is checked before any job runs.
    """
    spark = artifact.splits.sparkSession
    pairs = [(f, label) for (f, _), label in zip(artifact.model.encoder.positions(), labels, strict=True)]
    texts = spark.createDataFrame(pairs, "feature string, label string")
    leaks = forbidden_text(texts, ["feature", "label"], settings.forbidden_terms()).collect()
    if leaks:
        listed = ", ".join(sorted({r["text"] for r in leaks}))
        raise contracts.ContractError(f"Labels of the explanation name excluded fields: {listed}")


def run_explanation(
    mart: DataFrame, scores: DataFrame, artifact: ModelArtifact, settings: Settings = Settings()
) -> Explanation:
    """Contributions of every scored row, global importance, and reasons merged into scores."""
    joined = scoring.scored_features(scores, mart, artifact.model_version, artifact.feature_columns)
    rows = scoring.require_all_scored(scores, joined, artifact.model_version).frame
    labels = artifact.model.encoder.labels(mart.sparkSession)
    require_plain_labels(artifact, labels, settings)
    if artifact.model_type == TREES_TYPE:
        found = models.tree_contributions(artifact.model, rows, contracts.SCORE_KEY)
    else:
        background = split_rows(
            mart, artifact.splits.where("split = 'train'"), artifact.feature_columns
        )
        found = models.logistic_contributions(artifact.model, rows, background, contracts.SCORE_KEY)
    kept = store(found, "contributions").frame
    importance = store(
        reasons.feature_importance(kept, labels, artifact.model_version), "importance"
    )
    if not importance.rows:
        raise contracts.ContractError("No feature contributes to any score")
    merged = store(reasons.merge_reasons(scores, reasons.top_reasons(kept, labels)), "scores")
    return Explanation(merged, importance.frame)


def calibrated_predictions(mart: DataFrame, selected: Selected, version: str) -> Stored:
    artifact = selected.artifact
    raw = predict(artifact.model, artifact_rows(mart, artifact), version)
    adjusted = cal.apply_method(raw, selected.calibration.selected_method, selected.calibration.fitted)
    final = adjusted.withColumn("probability", F.col("calibrated")).drop("calibrated")
    return checked(final, "dashboard calibrated scores")


def quality_overrides(
    mart: DataFrame, selected: Selected, saved_metrics: DataFrame, settings: Settings, version: str
) -> dict[str, DataFrame]:
    """Metrics and bins of the calibrated scores; nothing when the scores stay uncalibrated.

    The saved timestamp of the replaced rows is kept.
    """
    if selected.calibration.selected_method == cal.UNCALIBRATED:
        return {}
    kept = calibrated_predictions(mart, selected, version)
    own = saved_metrics.where(F.col("model_version") == selected.artifact.model_version)
    saved = own.select("created_at").first()
    created_at = saved["created_at"] if saved else timestamp_text()
    bundle = metrics.metric_bundle(metrics.riskiest_first(kept), capacity=settings.review_capacity)
    reported = store(kept.frame.where(REPORTED), "reported")
    return {
        "model_metrics_summary": replace_version_rows(
            saved_metrics.select(*REPORTS["model_metrics_summary"]),
            selected.artifact.model_version,
            metrics.metric_rows(bundle, created_at),
        ),
        "model_calibration_bins": metrics.calibration_bins(
            metrics.with_tenth(reported, "bin_id", False)
        ),
    }


def segment_table(
    mart: DataFrame, diagnostics: DataFrame, selected: Selected, version: str
) -> DataFrame:
    artifact = selected.artifact
    rows = segment_rows(mart, diagnostics, artifact.splits, artifact.feature_columns, SEGMENT_DIMENSIONS)
    raw = predict(artifact.model, rows.where(REPORTED), version, *SEGMENT_DIMENSIONS)
    adjusted = cal.apply_method(raw, selected.calibration.selected_method, selected.calibration.fitted)
    final = adjusted.withColumn("probability", F.col("calibrated")).drop("calibrated")
    return segment_performance(final)


def run_dashboard_export(
    tables: Mapping[str, DataFrame],
    selected: Selected,
    folder: str,
    calibrated: bool = False,
    settings: Settings = Settings(),
) -> dict[str, int]:
    """Write the dashboard bundle; with calibrated quality under its own model version."""
    require_tables(
        tables,
        (
            "credit_risk_scores",
            "model_metrics_summary",
            "model_threshold_metrics",
            "model_lift_by_decile",
            "model_calibration_bins",
            "model_confusion_matrix",
            "model_feature_importance",
            "model_comparison_summary",
            contracts.MART,
            contracts.DIAGNOSTICS,
        ),
    )
    mart = tables[contracts.MART]
    source = selected.artifact.model_version
    version = DASHBOARD_VERSION if calibrated else source
    used = selected if calibrated else Selected(selected.artifact, uncalibrated(source))
    overrides = quality_overrides(mart, used, tables["model_metrics_summary"], settings, version)
    segments = store(segment_table(mart, tables[contracts.DIAGNOSTICS], used, version), "segments")
    if not segments.rows:
        raise contracts.ContractError("No segment has scored rows")
    overrides["segment_performance_summary"] = segments.frame
    relabel = (source, version) if version != source else None
    return export_dashboard(tables, folder, overrides, relabel)
