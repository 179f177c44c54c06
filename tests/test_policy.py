import pytest
from pyspark.sql import functions as F

from creditweave.operators import policy as p
from creditweave.settings import BusinessAssumptions

PREDICTIONS = "model_version string, split string, SK_ID_CURR long, target int, probability double"


def scores(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "probability double")


def test_bands_are_half_open(spark):
    pair = p.checked_pair(0.30, 0.70, "balanced")
    rows = scores(spark, [0.1, 0.3, 0.5, 0.7, 0.9]).select(
        p.risk_band("probability", pair).alias("b")
    )
    assert [r["b"] for r in rows.collect()] == [
        "approve", "manual_review", "manual_review", "high_risk", "high_risk"]


def test_quantile_thresholds_and_override(spark):
    values = scores(spark, [(i + 1) / 100 for i in range(100)])
    pairs = p.scenario_thresholds(
        values, {"balanced": {"threshold_low": 0.4, "threshold_high": 0.7}})
    assert (pairs["growth_oriented"].low, pairs["growth_oriented"].high) == pytest.approx(
        (0.8515, 0.9505))
    assert (pairs["risk_averse"].low, pairs["risk_averse"].high) == pytest.approx((0.703, 0.802))
    assert pairs["balanced"] == p.Thresholds(0.4, 0.7)
    assert list(pairs) == ["growth_oriented", "balanced", "risk_averse"]


def test_half_configured_and_bad_pairs(spark):
    values = scores(spark, [0.1, 0.2])
    with pytest.raises(p.PolicyError, match="Only one threshold"):
        p.scenario_thresholds(values, {"balanced": {"threshold_low": 0.4}})
    for low, high in ((0.5, 0.5), (-0.1, 0.5), ("x", 0.5), (0.2, float("nan"))):
        with pytest.raises(p.PolicyError):
            p.checked_pair(low, high, "balanced")


def test_ties_fall_back_to_neighbouring_scores(spark):
    pairs = p.scenario_thresholds(scores(spark, [0.2] * 96 + [0.4, 0.6, 0.8, 0.9]))
    assert pairs["balanced"] == p.Thresholds(0.8, 0.9)
    assert pairs["risk_averse"] == p.Thresholds(0.6, 0.9)
    with pytest.raises(p.PolicyError, match="no threshold parts"):
        p.scenario_thresholds(scores(spark, [0.2] * 5))


def test_expected_value(spark):
    value = p.expected_value(F.lit(8), F.lit(2), F.lit(5), BusinessAssumptions())
    assert spark.range(1).select(value.alias("v")).first()["v"] == -2250.0


def test_scenario_tables(spark):
    rows = spark.createDataFrame(
        [("m", "test", i, int(i % 4 == 0), i / 100) for i in range(100)], PREDICTIONS)
    pairs = {s: p.Thresholds(low, low + 0.2) for s, low in
             (("growth_oriented", 0.7), ("balanced", 0.5), ("risk_averse", 0.3))}
    table = p.threshold_metrics(rows, pairs, "t1", "now").collect()
    assert len(table) == 3
    for r in table:
        assert r["approval_rate"] + r["manual_review_rate"] + r["high_risk_rate"] == pytest.approx(1)
        assert r["approved_good_count"] + r["approved_bad_count"] == round(100 * r["threshold_low"])
    cells = p.confusion_matrix(rows, pairs).collect()
    assert len(cells) == 12
    for scenario in pairs:
        assert sum(c["count"] for c in cells if c["scenario_name"] == scenario) == 100
