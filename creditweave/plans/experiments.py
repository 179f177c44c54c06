"""Feature-set, feature-selection and seed-stability experiments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.functions.labels import humanize, plain_text
from creditweave.operators import calibration as cal
from creditweave.operators import metrics, policy, selection
from creditweave.operators.splits import stratified_split
from creditweave.plans.evaluation import REPORTED, method_metrics, with_methods
from creditweave.plans.training import checked, labeled_rows, predict, tune_trees
from creditweave.schemas import EXPERIMENT_METRICS, REPORTS
from creditweave.settings import REPORTING_SPLITS, Settings
from creditweave.sources.staging import timestamp_text
from creditweave.sources.workspace import Stored, store

DEFAULT_LIMITS = (40, 60, 80, 100)


class ExperimentError(ValueError):
    """The experiment is not possible with the given features, limits or seeds."""


@dataclass(frozen=True)
class FeatureSet:
    name: str
    features: tuple[str, ...]
    limit: int | None


def ranked_raw_features(importance: DataFrame, features: Sequence[str]) -> list[str]:
    """Raw feature names in the order of their best-ranked label.

    A category label counts for its feature; unknown labels are left out. Both sides are as
    small as the model.
    """
    spark = importance.sparkSession
    names = spark.createDataFrame([(f,) for f in features], "feature string").select(
        "feature", plain_text(humanize("feature")).alias("label")
    )
    labels = importance.select(
        plain_text(F.split("feature_name", ":")[0]).alias("label"), "rank"
    )
    best = names.join(labels, "label").groupBy("feature").agg(F.min("rank").alias("rank"))
    return [r["feature"] for r in best.orderBy("rank", "feature").collect()]


def feature_sets(
    ranked: Sequence[str],
    full: Sequence[str],
    limits: Sequence[int] = DEFAULT_LIMITS,
    include_full: bool = True,
) -> list[FeatureSet]:
    """The top-n prefixes of a ranking, and all features."""
    for n in limits:
        if n <= 0:
            raise ExperimentError(f"A set of {n} features is asked for")
        if n > len(full):
            raise ExperimentError(f"A set of {n} features is asked for, of {len(full)} that exist")
    wanted = max(limits, default=0)
    if len(ranked) < wanted:
        raise ExperimentError(
            f"The ranking covers {len(ranked)} features, but {wanted} are requested"
        )
    sets = [FeatureSet(f"top_{n}", tuple(ranked[:n]), n) for n in limits]
    return sets + ([FeatureSet("full", tuple(full), None)] if include_full else [])


def run_feature_set(
    rows: Stored, chosen: FeatureSet, settings: Settings, seed: int, created_at: str
) -> DataFrame:
    """Tune, calibrate and price one feature set; one summary row.

    Unlike production scoring, the thresholds here come from the calibrated scores.
    """
    features = list(chosen.features)
    used = rows.frame.select("SK_ID_CURR", "TARGET", "split", *features)
    train = store(used.where("split = 'train'"), "train")
    tuning = tune_trees(train, used.where("split = 'validation'"), features, settings, seed)
    candidate, model, _ = tuning.best
    raw = checked(predict(model, used.where(REPORTED), chosen.name), chosen.name)
    fitted = cal.fit_calibrators(raw.frame.where("split = 'validation'"))
    long = checked(with_methods(raw.frame, fitted), chosen.name)
    wide, _ = method_metrics(long, settings.review_capacity)
    measured = store(wide, "method-metrics").frame
    brier = measured.where("split = 'validation'").select("model_version", "brier_score").collect()
    method = cal.choose_method({r[0]: float(r[1]) for r in brier})
    final = store(long.frame.where(F.col("model_version") == method), "chosen")
    validation = store(final.frame.where("split = 'validation'"), "validation")
    pairs = policy.scenario_thresholds(validation, settings.thresholds)
    balanced = policy.threshold_metrics(
        final.frame, pairs, settings.threshold_version, created_at, settings.assumptions
    ).where("scenario_name = 'balanced'")
    merged = (
        measured.where(F.col("model_version") == method)
        .join(balanced.select("split", "expected_value_per_applicant"), "split")
        .withColumn("recall_at_review_capacity", F.col("recall_at_manual_review_capacity"))
        .withColumn("balanced_ev_per_applicant", F.col("expected_value_per_applicant"))
    )
    table = merged.agg(
        *[
            F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}")
            for s in REPORTING_SPLITS
            for m in (*EXPERIMENT_METRICS, "balanced_ev_per_applicant")
        ]
    )
    return table.select(
        F.lit(chosen.name).alias("feature_set"),
        F.lit(len(features)).alias("feature_count"),
        F.lit(str(chosen.limit) if chosen.limit else "full").alias("feature_limit"),
        F.lit(method).alias("selected_calibration_method"),
        F.lit(candidate.name).alias("selected_candidate_name"),
        "*",
        F.lit(created_at).alias("created_at"),
    )


def split_for(labeled: Stored, settings: Settings, seed: int) -> Stored:
    from dataclasses import replace

    drawn = stratified_split(labeled, replace(settings, seed=seed)).select("SK_ID_CURR", "split")
    return store(labeled.frame.join(drawn, "SK_ID_CURR"), "split-rows")


@dataclass(frozen=True)
class SelectionResult:
    comparison: DataFrame
    selected: str
    features: DataFrame


def run_feature_selection(
    mart: DataFrame,
    importance: DataFrame,
    features: Sequence[str],
    settings: Settings = Settings(),
    limits: Sequence[int] = DEFAULT_LIMITS,
    include_full: bool = True,
    splits: DataFrame | None = None,
) -> SelectionResult:
    """Compare top-n feature sets with the full set and name the best on validation."""
    created_at = timestamp_text()
    sets = feature_sets(ranked_raw_features(importance, features), features, limits, include_full)
    labeled = labeled_rows(mart, features)
    if splits is None:
        rows = split_for(labeled, settings, settings.seed)
    else:
        rows = store(labeled.frame.join(splits.select("SK_ID_CURR", "split"), "SK_ID_CURR"), "rows")
    parts = [run_feature_set(rows, s, settings, settings.seed, created_at) for s in sets]
    runs = store(reduce(DataFrame.unionByName, parts), "runs").frame
    marked = selection.selected_set(runs).select(*REPORTS["feature_selection_comparison"])
    winner = marked.where("selected").first()["feature_set"]
    chosen = next(s for s in sets if s.name == winner)
    return SelectionResult(marked, winner, selected_features(mart, chosen))


def selected_features(mart: DataFrame, chosen: FeatureSet) -> DataFrame:
    one = mart.sparkSession.createDataFrame([(chosen.name, list(chosen.features))], "feature_set string, f array<string>")
    return one.select("feature_set", F.posexplode("f").alias("i", "feature_name")).select(
        "feature_set", (F.col("i") + 1).alias("feature_rank"), "feature_name"
    )


@dataclass(frozen=True)
class StabilityResult:
    runs: DataFrame
    summary: DataFrame
    selected: str


def run_stability(
    mart: DataFrame,
    importance: DataFrame,
    features: Sequence[str],
    seeds: Sequence[int] = (17, 29, 43),
    settings: Settings = Settings(),
    limits: Sequence[int] = DEFAULT_LIMITS,
    include_full: bool = True,
) -> StabilityResult:
    """Repeat the feature-set comparison over several split seeds and summarise."""
    if not seeds:
        raise ExperimentError("No seed is given")
    if len(set(seeds)) != len(seeds):
        raise ExperimentError(f"Seeds repeat: {list(seeds)}")
    created_at = timestamp_text()
    sets = feature_sets(ranked_raw_features(importance, features), features, limits, include_full)
    labeled = labeled_rows(mart, features)
    parts = []
    for seed in seeds:
        rows = split_for(labeled, settings, seed)
        parts += [
            run_feature_set(rows, s, settings, seed, created_at).withColumn("seed", F.lit(seed))
            for s in sets
        ]
    runs = store(reduce(DataFrame.unionByName, parts), "runs").frame
    summary = store(selection.stability_summary(runs, created_at), "summary").frame
    marked = selection.seed_winners(runs).select(*REPORTS["model_stability_runs"])
    return StabilityResult(marked, summary, summary.where("selected").first()["feature_set"])
