"""Training to dashboard on the synthetic mart, with the invariants of every table."""

from dataclasses import replace
from datetime import datetime
from functools import reduce

import pytest
from pyspark.sql import functions as F

from creditweave.operators import contracts, models, scoring
from creditweave.plans import evaluation as ev
from creditweave.plans import experiments as ex
from creditweave.plans.training import run_training
from creditweave.schemas import REPORTS, SCORE_SCHEMA
from creditweave.settings import BASELINE_TYPE, TREES_TYPE, TREES_VERSION, Settings
from creditweave.sources import artifacts, reports
from creditweave.sources.workspace import store
from tests.fixtures import synthetic_diagnostics, synthetic_mart

SETTINGS = Settings(max_candidates=2)


@pytest.fixture(scope="module", autouse=True)
def small_presets():
    """The library has no bound on the trees; the tests' presets have few."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(models, "PRESETS", [replace(p, n_estimators=3) for p in models.PRESETS])
        yield


@pytest.fixture(scope="module")
def world(spark, small_presets, tmp_path_factory):
    """Everything up to the explained scores, made once."""
    folder = str(tmp_path_factory.mktemp("models"))
    mart = store(synthetic_mart(spark)).frame
    training = run_training(mart, folder, SETTINGS, "run")
    compared = training.tables["model_comparison_summary"]
    baseline = artifacts.load_model(spark, folder, BASELINE_TYPE)
    trees = artifacts.load_model(spark, folder, TREES_TYPE)
    evaluation = ev.run_evaluation(mart, baseline, trees, compared, SETTINGS)
    calibration = ev.run_calibration(mart, trees, folder, SETTINGS)
    selected = ev.load_selected(folder, compared)
    scores = ev.run_scoring(mart, selected, evaluation.tables["model_threshold_metrics"],
                            datetime(2026, 1, 1))
    explained = ev.run_explanation(mart, scores.frame, selected.artifact, SETTINGS)
    return {**locals()}


def test_training_tables(world):
    t = world["training"]
    sizes = {r["split"]: r["row_count"] for r in t.tables["split_summary"].collect()}
    assert sizes == {"train": 56, "validation": 12, "test": 12}
    assert t.tables["model_metrics_summary"].count() == 2 * 3 * 8
    tuning = t.tables["tuning_summary"].orderBy("candidate_rank").collect()
    assert [r["selected"] for r in tuning] == [True, False]
    assert t.tables["tuning_summary"].columns == list(REPORTS["tuning_summary"])
    runs = t.tables["model_run_summary"].collect()
    assert {r["model_type"] for r in runs} == {BASELINE_TYPE, TREES_TYPE}
    assert all(r["feature_count"] == 15 for r in runs)
    assert t.tables["model_comparison_summary"].count() == 8


def test_saved_models_predict_the_same(world):
    before = world["training"].trees.model
    rows = world["mart"].where("TARGET IS NULL")
    a = {r[0]: r[1] for r in before.with_probability(rows).select("SK_ID_CURR", "probability").collect()}
    b = world["trees"].model.with_probability(rows).select("SK_ID_CURR", "probability").collect()
    assert {r[0]: r[1] for r in b} == a


def test_artifact_checks(spark, world):
    with pytest.raises(artifacts.ArtifactError, match="No saved model"):
        artifacts.load_model(spark, world["folder"] + "/none", TREES_TYPE)
    with pytest.raises(artifacts.ArtifactError, match="expected"):
        artifacts.load_model(spark, world["folder"], TREES_TYPE, "other")
    with pytest.raises(artifacts.ArtifactError, match="belongs"):
        artifacts.load_calibration(spark, world["folder"], "other", TREES_TYPE, TREES_TYPE)


def test_evaluation_tables(world):
    e = world["evaluation"]
    for name, frame in e.tables.items():
        assert frame.columns == list(REPORTS[name])
    policy = e.tables["model_threshold_metrics"].collect()
    assert len(policy) == 6
    for scenario, pair in e.thresholds.items():
        own = [r for r in policy if r["scenario_name"] == scenario]
        assert {(r["threshold_low"], r["threshold_high"]) for r in own} == {(pair.low, pair.high)}
        for r in own:
            parts = r["approved_good_count"] + r["approved_bad_count"] + r["manual_review_count"]
            assert parts + r["high_risk_count"] == r["applicant_count"] == 12
    for name, key in (("model_lift_by_decile", "decile"), ("model_calibration_bins", "bin_id")):
        rows = e.tables[name].collect()
        assert len(rows) == 20 and {r[key] for r in rows} == set(range(1, 11))
        assert sum(r["applicant_count"] for r in rows) == 24
    cells = e.tables["model_confusion_matrix"].collect()
    assert len(cells) == 24 and sum(r["count"] for r in cells) == 24 * 3


def test_wrong_saved_selection_is_refused(spark, world):
    chosen = world["evaluation"].selected_model_type
    other = BASELINE_TYPE if chosen == TREES_TYPE else TREES_TYPE
    wrong = world["compared"].withColumn("selected_model_type", F.lit(other))
    with pytest.raises(contracts.ContractError, match="differs"):
        contracts.selected_model_type(wrong, chosen)
    both = world["compared"].unionByName(wrong)
    with pytest.raises(contracts.ContractError, match="exactly one"):
        contracts.selected_model_type(both)


def test_calibration_tables(world):
    c = world["calibration"]
    assert c.comparison.count() == 6 and c.bins.count() == 60
    rows = {(r["calibration_method"], r["split"]): r for r in c.comparison.collect()}
    for split in ("validation", "test"):
        raw, line = rows["uncalibrated", split], rows["sigmoid", split]
        if c.artifact.fitted.slope > 0:
            assert line["roc_auc"] == pytest.approx(raw["roc_auc"])


def test_scores(world):
    scores = world["scores"].frame
    assert scores.schema.simpleString() == SCORE_SCHEMA.simpleString()
    assert contracts.score_violations(scores).isEmpty()
    rows = scores.collect()
    assert len(rows) == 24
    pairs = {(r["risk_band"], r["recommended_action"]) for r in rows}
    assert pairs <= {("low_risk", "approve"), ("medium_risk", "manual_review"),
                     ("high_risk", "high_priority_review")}
    for population in ("holdout_test", "kaggle_test"):
        own = sorted((r for r in rows if r["scoring_population"] == population),
                     key=lambda r: (-r["score"], r["applicant_id"]))
        deciles = [r["score_decile"] for r in own]
        assert deciles == sorted(deciles) and len(own) == 12
        assert all((r["observed_target"] is None) == (population == "kaggle_test") for r in own)


def test_both_families_explain(world):
    for artifact in (world["baseline"], world["trees"]):
        scores = world["scores"].frame.withColumn("model_version", F.lit(artifact.model_version))
        done = ev.run_explanation(world["mart"], store(scores).frame, artifact, SETTINGS)
        assert done.scores.rows == 24
        assert {r["model_version"] for r in done.importance.collect()} == {artifact.model_version}


def test_score_contract_finds_damage(world):
    scores = world["scores"].frame
    broken = scores.unionByName(scores.limit(1)).withColumn(
        "risk_band", F.when(F.col("score_decile") > 1, F.col("risk_band")))
    found = {r["check"] for r in contracts.score_violations(broken).collect()}
    assert found == {"duplicate grain keys", "band or action is missing"}
    assert contracts.score_violations(scores.limit(0)).first()["check"] == "score table is empty"


def test_explanation(world):
    e = world["explained"]
    ranks = [r["rank"] for r in e.importance.orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1))
    rows = e.scores.frame.collect()
    assert len(rows) == 24
    for r in rows:
        given = [r[c] for c in ("top_reason_1", "top_reason_2", "top_reason_3")]
        assert given == sorted(given, key=lambda x: x is None)
        assert all(g.startswith("Higher risk: ") for g in given if g)
        assert len({g for g in given if g}) == sum(g is not None for g in given)
    secret = Settings(excluded={**SETTINGS.excluded, "more": ("category_feature",)})
    with pytest.raises(contracts.ContractError, match="Category feature: High"):
        ev.run_explanation(world["mart"], world["scores"].frame, world["selected"].artifact, secret)
    with pytest.raises(contracts.ContractError, match="holds no rows"):
        scoring.require_all_scored(world["scores"].frame, world["scores"].frame, "none")


@pytest.mark.parametrize("calibrated", [False, True])
def test_dashboard_bundle(spark, world, tmp_path, calibrated):
    tables = {
        **world["evaluation"].tables,
        "credit_risk_scores": world["explained"].scores.frame,
        "model_feature_importance": world["explained"].importance,
        "model_comparison_summary": world["compared"],
        contracts.MART: world["mart"],
        contracts.DIAGNOSTICS: synthetic_diagnostics(spark),
    }
    selected = ev.load_selected(world["folder"], world["compared"], calibrated)
    counts = ev.run_dashboard_export(tables, selected, str(tmp_path), calibrated, SETTINGS)
    assert set(counts) == set(reports.DASHBOARD_TABLES)
    assert counts["credit_risk_scores"] == 24
    for name in counts:
        back = spark.read.option("header", True).csv(f"{tmp_path}/{name}")
        assert back.columns == list(REPORTS[name]) and back.count() == counts[name]
    segments = spark.read.option("header", True).csv(f"{tmp_path}/segment_performance_summary")
    rows = segments.collect()
    totals = {}
    for r in rows:
        key = (r["split"], r["segment_name"])
        totals[key] = totals.get(key, 0) + int(r["applicant_count"])
    assert set(totals.values()) == {12}
    gender = [r for r in rows if r["segment_name"] == "CODE_GENDER"]
    assert all(r["roc_auc"] is None and r["pr_auc"] is None for r in gender)
    with pytest.raises(reports.ReportError, match="lacks the tables"):
        ev.run_dashboard_export({}, selected, str(tmp_path), calibrated)


def test_reasons_must_match_scores(world):
    from creditweave.operators.reasons import REASONS, merge_reasons

    scores = world["scores"].frame
    rows = scores.limit(1).withColumn("applicant_id", F.lit(-1).cast("long"))
    with pytest.raises(contracts.ContractError, match="belong to no row"):
        merge_reasons(scores, rows)
    one = scores.limit(1).select(*contracts.SCORE_KEY, *[F.lit("x").alias(r) for r in REASONS])
    merged = merge_reasons(scores, store(one).frame)
    assert merged.where("top_reason_1 = 'x'").count() == 1 and merged.count() == 24


def test_selection_and_stability(world):
    features = contracts.model_features(world["mart"], SETTINGS)
    quick = Settings(max_candidates=1)
    importance = world["mart"].sparkSession.createDataFrame(
        [(f"{name.replace('_', ' ').capitalize()}" + (": Low" if i == 0 else ""), i + 1)
         for i, name in enumerate(["category_feature", *[f for f in features if f != "category_feature"]])],
        "feature_name string, rank int")
    result = ex.run_feature_selection(world["mart"], importance, features, quick, (3,), True)
    assert result.comparison.columns == list(REPORTS["feature_selection_comparison"])
    assert {r["feature_set"] for r in result.comparison.collect()} == {"top_3", "full"}
    assert result.comparison.where("selected").count() == 1
    assert [r["feature_rank"] for r in result.features.collect()][0] == 1
    ranked = ex.ranked_raw_features(importance, features)
    assert ranked[0] == "category_feature" and sorted(ranked) == sorted(features)
    with pytest.raises(ex.ExperimentError):
        ex.feature_sets(ranked, features, (99,))
    with pytest.raises(ex.ExperimentError, match="repeat"):
        ex.run_stability(world["mart"], importance, features, (1, 1))


def test_stability_uses_validation_not_test(spark):
    from creditweave.operators.selection import stability_summary
    from creditweave.schemas import RUN_METRICS, STABILITY_METRICS

    def run(seed, name, count, validation, test):
        given = {"validation_pr_auc": validation, "test_pr_auc": test}
        return (seed, name, count, str(count), *[given.get(m, 0.5) for m in RUN_METRICS])

    rows = [run(s, "top_100", 100, 0.30 + s / 1000, 0.2) for s in (1, 2)]
    rows += [run(s, "full", 168, 0.29, 0.4) for s in (1, 2)]
    schema = "seed int, feature_set string, feature_count int, feature_limit string, " + ", ".join(
        f"{m} double" for m in RUN_METRICS)
    got = {r["feature_set"]: r for r in
           stability_summary(spark.createDataFrame(rows, schema), "now").collect()}
    assert got["top_100"]["selected"] and not got["full"]["selected"]
    assert got["top_100"]["validation_win_count"] == 2
    assert got["top_100"]["validation_win_rate"] == 1.0
    assert got["top_100"]["validation_pr_auc_std"] == pytest.approx(0.0005)
    assert got["top_100"]["pr_auc_generalization_gap"] == pytest.approx(0.2 - 0.3015)
    assert len(STABILITY_METRICS) == 16
