"""Training: split, fit both model families, compare them on validation, save."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.operators import models, selection
from creditweave.operators.contracts import model_features, raise_violations, probability_violations
from creditweave.operators.encoding import Encoder, fit_encoder
from creditweave.operators.metrics import (
    metric_bundle,
    metric_rows,
    prediction_frame,
    riskiest_first,
)
from creditweave.operators.splits import require_split_rows, split_rows, split_summary, stratified_split
from creditweave.schemas import RANK_METRICS, REPORTS
from creditweave.settings import (
    BASELINE_TYPE,
    BASELINE_VERSION,
    TRAIN_POPULATION,
    TREES_TYPE,
    TREES_VERSION,
    Settings,
)
from creditweave.sources.artifacts import ModelArtifact, save_model
from creditweave.sources.reports import rows_frame
from creditweave.sources.staging import timestamp_text
from creditweave.sources.workspace import Stored, store

_TUNING = (
    "candidate_rank int, selected boolean, candidate_name string, candidate_source string, "
    "validation_selection_score double, "
    + ", ".join(
        f"validation_{m} double"
        for m in (
            "pr_auc", "roc_auc", "brier_score", "top_decile_lift", "precision_at_top_decile",
            "recall_at_manual_review_capacity",
        )
    )
    + ", n_estimators int, learning_rate double, num_leaves int, max_depth int, "
    "min_child_samples int, subsample double, colsample_bytree double, reg_alpha double, "
    "reg_lambda double, scale_pos_weight double, created_at string"
)


@dataclass(frozen=True)
class Tuning:
    """Fitted candidates, best first."""

    ranked: list[tuple[models.Candidate, models.FittedModel, dict]]

    @property
    def best(self) -> tuple[models.Candidate, models.FittedModel, dict]:
        return self.ranked[0]


@dataclass(frozen=True)
class Training:
    baseline: ModelArtifact
    trees: ModelArtifact
    tables: dict[str, DataFrame]
    selected_model_type: str


def labeled_rows(mart: DataFrame, features: Sequence[str]) -> Stored:
    """All labeled rows, written once: the split, the fits and the predictions read them."""
    if not features:
        raise models.ModelError("The mart has none of the model's features")
    rows = mart.where(F.col("source_population") == TRAIN_POPULATION)
    kept = store(rows.select("SK_ID_CURR", "TARGET", *features), "labeled")
    if not kept.rows:
        raise models.ModelError("The mart has no row with a target to learn from")
    return kept


def predict(
    model: models.FittedModel, rows: DataFrame, version: str, *extra: str
) -> DataFrame:
    """One long prediction frame for all splits."""
    scored = model.with_probability(rows)
    return prediction_frame(scored, "probability", F.lit(version).alias("model_version"), "split", *extra)


def checked(predictions: DataFrame, label: str) -> Stored:
    kept = store(predictions, "predictions")
    raise_violations(probability_violations(kept.frame, "probability", label), "Invalid probabilities")
    return kept


def tune_trees(
    train: Stored,
    validation: DataFrame,
    features: Sequence[str],
    settings: Settings,
    seed: int,
    encoder: Encoder | None = None,
) -> Tuning:
    """Fit the candidates one after another and rank them by their validation metrics.

    All candidates are measured in one pass over the validation rows.
    """
    negatives, positives = models.class_sizes(train.frame)
    weight = negatives / positives if settings.class_weighting else 1.0
    encoded, encoder, stages = models.encode_training(train, features, encoder=encoder)
    fitted = {}
    for candidate in models.tree_candidates(weight, settings):
        model = models.fit_trees(encoded.frame, encoder, candidate, seed, stages)
        fitted[candidate.name] = (candidate, model)
    scored = validation.select("SK_ID_CURR", "TARGET", "split", *features)
    parts = [predict(model, scored, name) for name, (_, model) in fitted.items()]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    bundle = metric_bundle(
        riskiest_first(store(together, "candidates")), capacity=settings.review_capacity
    ).withColumn("_all", F.lit(0))
    order = [*selection.candidate_key(), F.col("model_version").asc()]
    # As many rows as candidates.
    placed = selection.place(bundle, order, ["_all"], "_place").orderBy("_place").collect()
    return Tuning([(*fitted[r["model_version"]], r.asDict()) for r in placed])


def tuning_rows(tuning: Tuning, mart: DataFrame, created_at: str) -> DataFrame:
    rows = []
    for rank, (candidate, _, found) in enumerate(tuning.ranked, start=1):
        measured = {f"validation_{m}": found[m] for m in RANK_METRICS}
        rows.append(
            {
                "candidate_rank": rank,
                "selected": rank == 1,
                "candidate_name": candidate.name,
                "candidate_source": candidate.source,
                "validation_selection_score": found["pr_auc"],
                "created_at": created_at,
                **measured,
                **candidate.params,
            }
        )
    return rows_frame(mart.sparkSession, rows, _TUNING)


def comparison(rows: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """Validation metrics of two models side by side and which model type they select."""
    value = F.col("metric_value")
    wide = (
        rows.where(F.col("split") == "validation")
        .groupBy("metric_name")
        .agg(
            F.max(F.when(F.col("model_version") == baseline, value)).alias("baseline_metric_value"),
            F.max(F.when(F.col("model_version") == challenger, value)).alias("trees_metric_value"),
        )
    )
    gain = F.col("trees_metric_value") - F.col("baseline_metric_value")
    choice = wide.where("metric_name = 'pr_auc'").select(
        F.when(gain >= 0, TREES_TYPE).otherwise(BASELINE_TYPE).alias("selected_model_type"),
        F.lit(True).alias("_one"),
    )
    # One row per metric on the left, a single row on the right.
    return (
        wide.withColumn("trees_minus_baseline", gain)
        .withColumn("_one", F.lit(True))
        .join(F.broadcast(choice), "_one")
        .select(*REPORTS["model_comparison_summary"])
    )


def run_training(
    mart: DataFrame, folder: str, settings: Settings = Settings(), run_id: str | None = None
) -> Training:
    """Train the logistic baseline and the tuned trees on one split and save both."""
    created_at = timestamp_text()
    run_id = run_id or f"train-{created_at}"
    features = model_features(mart, settings)
    labeled = labeled_rows(mart, features)
    drawn = store(stratified_split(labeled, settings), "splits")
    rows = store(labeled.frame.join(drawn.frame.select("SK_ID_CURR", "split"), "SK_ID_CURR"), "split-rows")
    require_split_rows(rows.frame, drawn.frame)
    train = store(rows.frame.where("split = 'train'"), "train")

    # Medians, modes and vocabularies are those of both models.
    encoder = fit_encoder(train, features, scaled=False)
    logistic = models.fit_logistic(train, features, settings, encoder=encoder)
    validation = rows.frame.where("split = 'validation'")
    tuning = tune_trees(train, validation, features, settings, settings.seed, encoder)
    candidate, trees, _ = tuning.best

    both = predict(logistic, rows.frame, BASELINE_VERSION).unionByName(
        predict(trees, rows.frame, TREES_VERSION)
    )
    kept = checked(both, "training predictions")
    bundle = metric_bundle(riskiest_first(kept), capacity=settings.review_capacity)
    measured = store(metric_rows(bundle, created_at), "metrics").frame
    compared = store(comparison(measured, BASELINE_VERSION, TREES_VERSION), "comparison").frame
    summary = store(split_summary(drawn.frame, BASELINE_VERSION, run_id, created_at), "summary").frame
    sizes = {r["split"]: r for r in summary.collect()}
    spark = mart.sparkSession
    runs = rows_frame(
        spark,
        [
            {
                "model_version": version,
                "run_id": run_id,
                "model_type": kind,
                "data_scope_version": settings.data_scope,
                "train_rows": sizes["train"]["row_count"],
                "validation_rows": sizes["validation"]["row_count"],
                "test_rows": sizes["test"]["row_count"],
                "feature_count": len(features),
                "positive_rate_train": sizes["train"]["positive_rate"],
                "random_seed": settings.seed,
                "created_at": created_at,
            }
            for version, kind in ((BASELINE_VERSION, BASELINE_TYPE), (TREES_VERSION, TREES_TYPE))
        ],
        "model_version string, run_id string, model_type string, data_scope_version string, "
        "train_rows long, validation_rows long, test_rows long, feature_count int, "
        "positive_rate_train double, random_seed int, created_at string",
    )
    details = {
        "tuning": {
            "enabled": settings.tuning_enabled,
            "max_candidates": settings.max_candidates,
            "candidate_count": len(tuning.ranked),
            "selected_candidate": {"rank": 1, "candidate_name": candidate.name, "params": candidate.params},
        }
    }
    artifacts = [
        ModelArtifact(kind, version, run_id, list(features), created_at, model, drawn.frame, extra)
        for kind, version, model, extra in (
            (BASELINE_TYPE, BASELINE_VERSION, logistic, {}),
            (TREES_TYPE, TREES_VERSION, trees, json.loads(json.dumps(details))),
        )
    ]
    for artifact in artifacts:
        save_model(artifact, folder)
    return Training(
        *artifacts,
        tables={
            "model_metrics_summary": measured,
            "model_comparison_summary": compared,
            "split_summary": summary,
            "model_run_summary": runs,
            "tuning_summary": tuning_rows(tuning, mart, created_at),
            "predictions": kept.frame,
        },
        selected_model_type=compared.first()["selected_model_type"],
    )
