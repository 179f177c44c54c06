"""Splits, metrics, policy, scoring and explanations on a closed-form risk score.

The score is a fixed logistic expression over mart columns, so that every table has a SQL
twin. ``fine`` is rounded to 20 binary digits, ``coarse`` to 6, which makes heavy ties. Sums
of such numbers are exact, whatever the order of addition.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweave.functions.expressions import logit, ratio, sigmoid
from creditweave.operators import contracts, inventory, metrics, policy, reasons, scoring
from creditweave.operators import selection, splits
from creditweave.operators.segments import segment_performance
from creditweave.plans.mart import FeatureTables
from creditweave.plans.training import comparison
from creditweave.schemas import REPORTS, RUN_METRICS
from creditweave.settings import SEGMENT_DIMENSIONS, TRAIN_POPULATION, BusinessAssumptions, Settings
from creditweave.sources.reports import (
    read_partitions,
    relabel_version,
    replace_partitions,
    replace_version_rows,
    write_table,
)
from creditweave.sources.workspace import Stored, new_path, store
from workload.queries import joined_once, tables, tidy

NOW = "2026-01-01T00:00:00+00:00"
SCORED_AT = datetime(2026, 1, 1)
FINE, COARSE = "closed_form_fine", "closed_form_coarse"
PLATT = (0.35, 0.8)  # intercept and slope of the stand-in sigmoid calibration
SEEDS = (17, 29, 43)
DRIVERS = (
    "ext_source_mean",
    "credit_to_income_ratio",
    "late_payment_count",
    "installment_payment_count",
    "active_credit_count",
)


def r6(value: Column) -> Column:
    return F.floor(value * 1e6 + 0.5) / F.lit(1e6)


def dyadic(value: Column, digits: int = 20) -> Column:
    return F.floor(value * float(1 << digits) + 0.5) / F.lit(float(1 << digits))


def terms() -> list[tuple[str, Column]]:
    """Labelled additive parts of the margin."""
    lateness = F.coalesce(ratio("late_payment_count", "installment_payment_count") - 0.5, F.lit(0.0))
    return [
        ("Ext source mean", F.lit(1.6) * F.coalesce(F.lit(0.5) - F.col("ext_source_mean"), F.lit(0.0))),
        ("Credit to income ratio",
         F.lit(0.04) * F.least(F.coalesce("credit_to_income_ratio", F.lit(5.0)), F.lit(20.0))),
        ("Late payment count", F.lit(2.0) * lateness),
        ("Active credit count", F.lit(0.1) * F.coalesce("active_credit_count", F.lit(0))),
    ]


def fine_score() -> Column:
    return dyadic(sigmoid(F.lit(-2.4) + reduce(Column.__add__, (t for _, t in terms()))))


def coarse_score(fine: Column) -> Column:
    return dyadic(fine, 6)


def scored_mart(t: FeatureTables, *extra: str) -> DataFrame:
    return t.mart_v1.select(
        "SK_ID_CURR", "source_population", F.col("TARGET").cast("int").alias("TARGET"),
        fine_score().alias("fine"), *extra,
    )


def labeled(spark: SparkSession, sf_dir: str) -> Stored:
    scored = scored_mart(tables(spark, sf_dir))
    return store(scored.where(F.col("source_population") == TRAIN_POPULATION), "labeled")


@dataclass(frozen=True)
class Base:
    """Scored applicants with the drivers, the labeled ones and their split, each computed once."""

    scored: DataFrame
    labeled: Stored
    split: DataFrame


def base(spark: SparkSession, sf_dir: str) -> Base:
    """For queries that need these tables several times."""
    scored = store(scored_mart(tables(spark, sf_dir), *DRIVERS), "scored").frame
    rows = store(
        scored.where(F.col("source_population") == TRAIN_POPULATION).drop(*DRIVERS), "labeled"
    )
    drawn = splits.stratified_split(rows).select("SK_ID_CURR", "split")
    return Base(scored, rows, store(drawn, "split").frame)


def two_models(rows: DataFrame, *extra: str) -> DataFrame:
    """The long prediction frame of both score variants."""
    entries = [
        F.struct(F.lit(name).alias("model_version"), score.alias("probability"))
        for name, score in ((FINE, F.col("fine")), (COARSE, coarse_score(F.col("fine"))))
    ]
    return rows.select(
        "SK_ID_CURR", F.col("TARGET").alias("target"), "split", *extra,
        F.explode(F.array(*entries)).alias("_e"),
    ).select("_e.model_version", "split", "SK_ID_CURR", "target", "_e.probability", *extra)


def predictions(spark: SparkSession, sf_dir: str, given: Base | None = None) -> Stored:
    rows = given.labeled if given else labeled(spark, sf_dir)
    drawn = given.split if given else splits.stratified_split(rows).select("SK_ID_CURR", "split")
    return store(two_models(rows.frame.join(drawn, "SK_ID_CURR")), "predictions")


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.riskiest_first(predictions(spark, sf_dir))


def bundle(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return metrics.metric_bundle(ranking(spark, sf_dir)).select(*metrics.GROUPS, *columns)


def thresholds(kept: Stored) -> dict[str, policy.Thresholds]:
    """From the validation scores of the coarse variant, so that ties matter."""
    validation = kept.frame.where(f"split = 'validation' AND model_version = '{COARSE}'")
    return policy.scenario_thresholds(store(validation, "validation"))


# --- tables and contracts -------------------------------------------------------------


def kept_tables(spark, sf_dir, post_v1: bool = True) -> FeatureTables:
    """Feature tables over stored digests, for queries that touch many of them."""
    return joined_once(spark, sf_dir).keep(lambda name, frame: store(frame, name).frame, post_v1)


def table_profile(spark, sf_dir):
    t = kept_tables(spark, sf_dir)
    named = {k: v for k, v in t.named().items() if k.startswith("f_") or k == "segment_diagnostics"}
    return contracts.mart_profile(named, NOW)


def data_inventory(spark, sf_dir):
    t = kept_tables(spark, sf_dir)
    return contracts.data_inventory({**t.staging, **t.named()}, NOW)


def column_inventory(spark, sf_dir):
    mart = store(tables(spark, sf_dir).mart_v1, "mart").frame
    return tidy(inventory.feature_inventory(contracts.MART, mart, Settings(), True, NOW))


def grain_duplicates(spark, sf_dir):
    lines = tables(spark, sf_dir).source("installments_payments")
    return inventory.duplicate_keys(lines, ["SK_ID_PREV", "NUM_INSTALMENT_NUMBER"])


def damaged(t: FeatureTables) -> dict[str, DataFrame]:
    """All tables, with a mart that breaks the contract in several ways."""
    mart = t.mart_v1
    key, label = F.col("SK_ID_CURR"), F.col("TARGET")
    broken = (
        mart.unionByName(mart.where(key % 100 == 3))
        .where(key % 211 != 9)
        .withColumn("TARGET", F.when(key % 97 == 5, None).when(key % 103 == 7, 2).otherwise(label))
        .withColumn("TARGET", F.when(key % 49 == 0, 1).otherwise(F.col("TARGET")))
        .withColumn("OWN_CAR_AGE", F.lit(None).cast("double"))
        .withColumn("CODE_GENDER", F.lit("F"))
    )
    return {**t.staging, **t.named(post_v1=False), contracts.MART: store(broken, "mart").frame}


def contract_violations(spark, sf_dir):
    t = kept_tables(spark, sf_dir, post_v1=False)
    return contracts.contract_violations(damaged(t), Settings(data_scope="v1"))


def contract_clean(spark, sf_dir):
    t = kept_tables(spark, sf_dir, post_v1=False)
    named = {**t.staging, **t.named(post_v1=False)}
    return contracts.contract_violations(named, Settings(data_scope="v1"))


def reconciliation(spark, sf_dir):
    t = tables(spark, sf_dir)
    return contracts.reconciliation(
        t.source("application_train"), t.source("application_test"), damaged(t)[contracts.MART]
    )


def anti_missing_ids(spark, sf_dir):
    """Applicants without any POS history."""
    t = tables(spark, sf_dir)
    return splits.missing_ids(t.applicants, t.source("pos_cash_balance"))


# --- splits ---------------------------------------------------------------------------


def stratified_split(spark, sf_dir):
    return splits.stratified_split(labeled(spark, sf_dir))


def split_summary(spark, sf_dir):
    return tidy(splits.split_summary(stratified_split(spark, sf_dir), FINE, "run", NOW))


def split_rows(spark, sf_dir):
    t = tables(spark, sf_dir)
    drawn = splits.stratified_split(labeled(spark, sf_dir))
    return tidy(splits.segment_rows(t.mart_v1, t.diagnostics, drawn, DRIVERS, SEGMENT_DIMENSIONS))


# --- metrics --------------------------------------------------------------------------


def score_decile(spark, sf_dir):
    return metrics.with_tenth(predictions(spark, sf_dir), "decile", True)


def lift_by_decile(spark, sf_dir):
    return tidy(metrics.lift_by_decile(score_decile(spark, sf_dir)))


def bins(kept: Stored) -> DataFrame:
    return metrics.calibration_bins(metrics.with_tenth(kept, "bin_id", False))


def calibration_bins(spark, sf_dir):
    return tidy(bins(predictions(spark, sf_dir)))


def bin_error_summary(spark, sf_dir):
    return tidy(metrics.bin_errors(bins(predictions(spark, sf_dir))))


def metric_bundle(spark, sf_dir):
    return tidy(metrics.metric_rows(metrics.metric_bundle(ranking(spark, sf_dir)), NOW))


def precision_recall_at_rate(spark, sf_dir):
    return tidy(metrics.at_rate(ranking(spark, sf_dir), (0.01, 0.05, 0.10, 0.33, 1.0)))


def roc_points(spark, sf_dir):
    return tidy(metrics.roc_points(metrics.distinct_scores(predictions(spark, sf_dir))))


def pr_points(spark, sf_dir):
    return tidy(metrics.pr_points(metrics.distinct_scores(predictions(spark, sf_dir))))


def segment_query(spark, sf_dir, given: Base | None = None):
    rows = given.labeled if given else labeled(spark, sf_dir)
    drawn = given.split if given else splits.stratified_split(rows).select("SK_ID_CURR", "split")
    fields = tables(spark, sf_dir).diagnostics.where(
        F.col("source_population") == TRAIN_POPULATION
    ).select("SK_ID_CURR", *SEGMENT_DIMENSIONS)
    joined = rows.frame.join(drawn, "SK_ID_CURR").join(fields, "SK_ID_CURR")
    reported = two_models(joined, *SEGMENT_DIMENSIONS).where("split <> 'train'")
    return tidy(segment_performance(reported))


def labels_metrics(spark, sf_dir):
    """The second labeled set: document quality scored by a function of the text length."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(1500.0))
    rows = documents.join(given, "doc_id").select(
        F.lit("length_score").alias("model_version"),
        F.col("lang").alias("split"),
        F.col("doc_id").alias("SK_ID_CURR"),
        F.col("quality").cast("int").alias("target"),
        score.alias("probability"),
    )
    ranked = metrics.riskiest_first(store(rows, "documents"))
    return tidy(metrics.metric_rows(metrics.metric_bundle(ranked, capacity=0.25), NOW))


# --- policy ---------------------------------------------------------------------------


def scenario_thresholds(spark, sf_dir):
    pairs = thresholds(predictions(spark, sf_dir))
    rows = [(s, p.low, p.high) for s, p in pairs.items()]
    return tidy(spark.createDataFrame(rows, "scenario_name string, threshold_low double, threshold_high double"))


def tied_thresholds(spark, sf_dir):
    """Nine tenths of the validation scores tie at the top, so that the quantiles of a scenario are equal."""
    kept = predictions(spark, sf_dir).frame.where(f"split = 'validation' AND model_version = '{FINE}'")
    tied = F.when(F.col("SK_ID_CURR") % 10 != 0, F.lit(0.5)).otherwise(F.col("probability") / 2)
    pairs = policy.scenario_thresholds(store(kept.withColumn("probability", tied), "tied"))
    rows = [(s, p.low, p.high) for s, p in pairs.items()]
    return tidy(spark.createDataFrame(rows, "scenario_name string, threshold_low double, threshold_high double"))


def score_bands(spark, sf_dir):
    kept = predictions(spark, sf_dir)
    pair = thresholds(kept)["balanced"]
    band = policy.risk_band("probability", pair)
    return kept.frame.select(
        *metrics.GROUPS, "SK_ID_CURR", "probability", band.alias("band"),
        policy.band_label(band).alias("risk_band"), policy.band_action(band).alias("recommended_action"),
    )


def threshold_metrics(spark, sf_dir):
    kept = predictions(spark, sf_dir)
    table = policy.threshold_metrics(
        kept.frame.where("split <> 'train'"), thresholds(kept), "threshold_v1", NOW, BusinessAssumptions()
    )
    return tidy(table.select(*REPORTS["model_threshold_metrics"]))


def confusion_matrix(spark, sf_dir):
    kept = predictions(spark, sf_dir)
    return policy.confusion_matrix(kept.frame.where("split <> 'train'"), thresholds(kept))


# --- calibration with given coefficients ----------------------------------------------


def calibrated(fine: Column) -> Column:
    return dyadic(sigmoid(F.lit(PLATT[0]) + F.lit(PLATT[1]) * logit(fine)))


def platt_apply(spark, sf_dir):
    kept = predictions(spark, sf_dir)
    return kept.frame.withColumn("calibrated", calibrated(F.col("probability")))


def calibration_comparison(spark, sf_dir):
    """Raw and sigmoid scores of the fine variant side by side, with bin errors."""
    kept = predictions(spark, sf_dir)
    fine = kept.frame.where(f"model_version = '{FINE}' AND split <> 'train'")
    entries = [
        F.struct(F.lit(m).alias("model_version"), s.alias("probability"))
        for m, s in (("uncalibrated", F.col("probability")), ("sigmoid", calibrated(F.col("probability"))))
    ]
    long = store(
        fine.select("split", "SK_ID_CURR", "target", F.explode(F.array(*entries)).alias("e")).select(
            "e.model_version", "split", "SK_ID_CURR", "target", "e.probability"
        ),
        "calibration",
    )
    wide = metrics.metric_bundle(metrics.riskiest_first(long)).join(
        metrics.bin_errors(bins(long)), list(metrics.GROUPS)
    )
    return tidy(
        wide.withColumnRenamed("model_version", "calibration_method")
        .withColumn("model_version", F.concat_ws("_", F.lit(FINE), "calibration_method"))
        .withColumn("base_model_version", F.lit(FINE))
        .withColumn("created_at", F.lit(NOW))
        .select(*REPORTS["model_calibration_comparison"])
    )


# --- scoring and explanation ----------------------------------------------------------


def score_table(spark, sf_dir, given: Base | None = None) -> Stored:
    """Both populations scored with the fine variant, bands from its validation quantiles."""
    scored = given.scored.drop(*DRIVERS) if given else store(scored_mart(tables(spark, sf_dir)), "scored").frame
    train = scored.where(F.col("source_population") == TRAIN_POPULATION)
    drawn = given.split if given else splits.stratified_split(store(train, "labeled")).select("SK_ID_CURR", "split")
    split_scores = store(train.join(drawn, "SK_ID_CURR"), "split-scores")
    validation = store(
        split_scores.frame.where("split = 'validation'").select(F.col("fine").alias("probability")),
        "validation",
    )
    pair = policy.scenario_thresholds(validation)["balanced"]
    holdout = split_scores.frame.where("split = 'test'").withColumn(
        "scoring_population", F.lit("holdout_test")
    )
    unlabeled = scored.where(F.col("source_population") != TRAIN_POPULATION).withColumn(
        "scoring_population", F.lit("kaggle_test")
    )
    columns = [
        "SK_ID_CURR", "scoring_population", F.col("TARGET").alias("target"),
        F.col("fine").alias("probability"), calibrated(F.col("fine")).alias("calibrated"),
    ]
    both = store(holdout.select(*columns).unionByName(unlabeled.select(*columns)), "populations")
    return store(
        scoring.score_rows(both, pair, "threshold_v1", FINE, "sigmoid", SCORED_AT), "scores"
    )


def risk_scores(spark, sf_dir):
    return score_table(spark, sf_dir).frame


def contributions(spark, sf_dir, given: Base | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(scores, contribution rows, labels) for the scored rows."""
    scores = score_table(spark, sf_dir, given).frame
    features = given.scored if given else tables(spark, sf_dir).mart_v1
    joined = scoring.scored_features(scores, features, FINE, list(DRIVERS))
    parts = terms()
    rows = joined.select(
        "applicant_id", "scoring_population", "model_version", "threshold_version",
        F.array(*[dyadic(t) for _, t in parts]).alias("contributions"),
    )
    return scores, store(rows, "contributions").frame, [label for label, _ in parts]


def linear_contributions(spark, sf_dir):
    """coefficient * (value - mean) of two mart columns for every applicant."""
    mart = tables(spark, sf_dir).mart_v1
    values = F.array(
        F.coalesce(F.col("bureau_credit_count").cast("double"), F.lit(0.0)),
        F.coalesce("AMT_ANNUITY", F.lit(0.0)),
    )
    found = reasons.linear_contributions(values, (0.25, -0.5), (10.0, 20000.0))
    return tidy(
        mart.select("SK_ID_CURR", "source_population", found.alias("c")).select(
            "SK_ID_CURR", "source_population",
            F.col("c")[0].alias("bureau_credit_count"), F.col("c")[1].alias("AMT_ANNUITY"),
        )
    )


def feature_importance(spark, sf_dir):
    _, rows, labels = contributions(spark, sf_dir)
    return tidy(reasons.feature_importance(rows, labels, FINE))


def top_reasons(spark, sf_dir):
    _, rows, labels = contributions(spark, sf_dir)
    return reasons.top_reasons(rows, labels)


def merge_reasons(spark, sf_dir):
    """Only the holdout rows get reasons; the others keep theirs."""
    scores, rows, labels = contributions(spark, sf_dir)
    found = reasons.top_reasons(rows.where("scoring_population = 'holdout_test'"), labels)
    return reasons.merge_reasons(scores, found)


# --- experiments on the closed-form scores --------------------------------------------


def run_rows(spark, sf_dir) -> DataFrame:
    """One row per (seed, score variant): metrics on validation and test."""
    rows = labeled(spark, sf_dir)
    drawn = [
        splits.stratified_split(rows, Settings(seed=seed))
        .select("SK_ID_CURR", F.concat_ws("|", F.lit(seed), "split").alias("split"))
        for seed in SEEDS
    ]
    assigned = reduce(DataFrame.unionByName, drawn).where("split NOT LIKE '%train'")
    kept = store(two_models(rows.frame.join(assigned, "SK_ID_CURR")), "runs")
    wide = metrics.metric_bundle(metrics.riskiest_first(kept)).join(
        metrics.bin_errors(bins(kept)), list(metrics.GROUPS)
    ).withColumn("recall_at_review_capacity", F.col("recall_at_manual_review_capacity"))
    fixed = {"balanced": policy.Thresholds(0.12, 0.16)}
    values = policy.threshold_metrics(kept.frame, fixed, "fixed", NOW).select(
        *metrics.GROUPS, F.col("expected_value_per_applicant").alias("balanced_ev_per_applicant")
    )
    joined = wide.join(values, list(metrics.GROUPS))
    split = F.split("split", r"\|")
    measures = [m.removeprefix("validation_") for m in RUN_METRICS if m.startswith("validation_")]
    return joined.groupBy(split[0].cast("int").alias("seed"), F.col("model_version").alias("feature_set")).agg(
        F.when(F.col("feature_set") == FINE, 6).otherwise(2).cast("int").alias("feature_count"),
        F.lit("full").alias("feature_limit"),
        *[
            F.max(F.when(split[1] == s, r6(F.col(m)))).alias(f"{s}_{m}")
            for s in ("validation", "test")
            for m in measures
        ],
    )


def stability_summary(spark, sf_dir):
    return tidy(selection.stability_summary(run_rows(spark, sf_dir), NOW))


def feature_set_winner(spark, sf_dir):
    marked = selection.seed_winners(run_rows(spark, sf_dir))
    return tidy(marked.select("seed", "feature_set", "seed_validation_winner", *RUN_METRICS))


def relabel_union(spark, sf_dir):
    """The fine variant's metric rows replaced by those of the calibrated scores, relabelled."""
    kept = predictions(spark, sf_dir)
    existing = metrics.metric_rows(metrics.metric_bundle(metrics.riskiest_first(kept)), NOW)
    fine = kept.frame.where(F.col("model_version") == FINE)
    adjusted = store(fine.withColumn("probability", calibrated(F.col("probability"))), "adjusted")
    fresh = metrics.metric_rows(metrics.metric_bundle(metrics.riskiest_first(adjusted)), NOW)
    fresh = relabel_version(fresh, FINE, "dashboard")
    return tidy(replace_version_rows(existing, FINE, fresh))


def replaced_partitions(spark, sf_dir):
    """The same on a stored table: only the fine variant's partition is written anew."""
    kept = predictions(spark, sf_dir)
    existing = metrics.metric_rows(metrics.metric_bundle(metrics.riskiest_first(kept)), NOW)
    path = new_path(spark, "reports")
    write_table(existing, path, ("model_version",))
    fine = kept.frame.where(F.col("model_version") == FINE)
    adjusted = store(fine.withColumn("probability", calibrated(F.col("probability"))), "adjusted")
    replace_partitions(metrics.metric_rows(metrics.metric_bundle(metrics.riskiest_first(adjusted)), NOW), path)
    return tidy(relabel_version(read_partitions(spark, path, existing.schema), FINE, "dashboard"))


def model_comparison(spark, sf_dir):
    """Coarse as baseline, fine as challenger, on validation."""
    rows = metrics.metric_rows(metrics.metric_bundle(ranking(spark, sf_dir)), NOW)
    return tidy(comparison(rows, COARSE, FINE))


def model_queries() -> dict:
    return {
        "table_profile": table_profile,
        "data_inventory": data_inventory,
        "column_inventory": column_inventory,
        "grain_duplicates": grain_duplicates,
        "contract_violations": contract_violations,
        "contract_clean": contract_clean,
        "reconciliation": reconciliation,
        "anti_missing_ids": anti_missing_ids,
        "stratified_split": stratified_split,
        "split_summary": split_summary,
        "split_rows": split_rows,
        "score_bands": score_bands,
        "score_decile": score_decile,
        "lift_by_decile": lift_by_decile,
        "calibration_bins": calibration_bins,
        "bin_error_summary": bin_error_summary,
        "roc_auc": lambda s, d: tidy(bundle(s, d, "roc_auc")),
        "average_precision": lambda s, d: tidy(bundle(s, d, "pr_auc")),
        "brier_minmax": lambda s, d: tidy(
            bundle(s, d, "brier_score", "min_predicted_probability", "max_predicted_probability")
        ),
        "precision_recall_at_rate": precision_recall_at_rate,
        "metric_bundle": metric_bundle,
        "labels_metrics": labels_metrics,
        "roc_points": roc_points,
        "pr_points": pr_points,
        "scenario_thresholds": scenario_thresholds,
        "tied_thresholds": tied_thresholds,
        "threshold_metrics": threshold_metrics,
        "confusion_matrix": confusion_matrix,
        "segment_performance": segment_query,
        "platt_apply": platt_apply,
        "calibration_comparison": calibration_comparison,
        "risk_scores": risk_scores,
        "linear_contributions": linear_contributions,
        "feature_importance": feature_importance,
        "top_reasons": top_reasons,
        "merge_reasons": merge_reasons,
        "stability_summary": stability_summary,
        "feature_set_winner": feature_set_winner,
        "relabel_union": relabel_union,
        "replaced_partitions": replaced_partitions,
        "model_comparison": model_comparison,
    }
