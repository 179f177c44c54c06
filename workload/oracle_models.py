"""DuckDB twins of the split, metric, policy, scoring and experiment queries."""

from __future__ import annotations

from creditweave.operators.contracts import required_tables
from creditweave.schemas import RANK_METRICS, REPORTS, RUN_METRICS, STABILITY_METRICS
from creditweave.settings import SEGMENT_DIMENSIONS, Settings
from workload.model_queries import COARSE, FINE, NOW, PLATT, SEEDS
from workload.oracle_features import (
    APPLICANT, BALANCE, BUREAU, CARD, FULL, INSTALLMENTS, LAST_K, POS, PREVIOUS, PRESSURE,
    RECENCY, V1, _by_applicant, compose, per, round6,
)

G = "model_version, split"


def _dyadic(expression: str, digits: int = 20) -> str:
    return f"floor(({expression}) * {1 << digits}::DOUBLE + 0.5) / {1 << digits}::DOUBLE"


def _share(total: str, own: str, other: str) -> str:
    """The rows of class 1 when a total is divided over two classes by largest remainder."""
    exact, rest = f"({total} * {own} / ({own} + {other}))", f"({total} * {other} / ({own} + {other}))"
    return (
        f"(floor({exact}) + CASE WHEN {total} > floor({exact}) + floor({rest})"
        f" AND {exact} - floor({exact}) > {rest} - floor({rest}) THEN 1 ELSE 0 END)"
    )


def _split(seed: int) -> str:
    return f"""SELECT SK_ID_CURR, TARGET, CASE
  WHEN nth <= CASE WHEN TARGET = 1 THEN t1 ELSE t - t1 END THEN 'test'
  WHEN nth <= CASE WHEN TARGET = 1 THEN h1 ELSE h - h1 END THEN 'validation' ELSE 'train' END AS split
FROM (SELECT SK_ID_CURR, TARGET, row_number() OVER (PARTITION BY TARGET
    ORDER BY md5('{seed}:' || SK_ID_CURR), SK_ID_CURR) AS nth FROM labeled),
  (SELECT *, {_share("t", "h1", "(h - h1)")} AS t1 FROM
    (SELECT *, ceil(h * 0.5) AS t, {_share("h", "n1", "n0")} AS h1 FROM
      (SELECT *, ceil((n0 + n1) * 0.3::DOUBLE) AS h FROM
        (SELECT count(*) FILTER (WHERE TARGET = 0)::DOUBLE AS n0,
                count(*) FILTER (WHERE TARGET = 1)::DOUBLE AS n1 FROM labeled))))"""


def _two(source: str, extra: str = "") -> str:
    cols = f"split, SK_ID_CURR, TARGET AS target{extra}"
    return f"""SELECT '{FINE}' AS model_version, {cols}, fine AS probability FROM {source}
UNION ALL SELECT '{COARSE}', {cols}, {_dyadic('fine', 6)} FROM {source}"""


_TERMS = {
    "Ext source mean": "1.6 * coalesce(0.5 - ext_source_mean, 0)",
    "Credit to income ratio": "0.04 * least(coalesce(credit_to_income_ratio, 5), 20)",
    "Late payment count": "2.0 * coalesce(" + per("late_payment_count", "installment_payment_count") + " - 0.5, 0)",
    "Active credit count": "0.1::DOUBLE * coalesce(active_credit_count, 0)",
}
_MARGIN = "-2.4 + (" + " + ".join(f"({t})" for t in _TERMS.values()) + ")"


def _calibrated(p: str) -> str:
    clipped = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    return _dyadic(f"1 / (1 + exp(-({PLATT[0]} + {PLATT[1]} * ln({clipped} / (1 - {clipped})))))")


def _bundle(source: str, groups: str = G, capacity: float = 0.1) -> dict[str, str]:
    """CTEs that end in ``bundle``: one row per group with all metrics."""
    same = " AND ".join(f"a.{g.strip()} = b.{g.strip()}" for g in groups.split(","))
    return {
        "bundle_ranks": f"""SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY probability DESC, SK_ID_CURR) AS nth,
  count(*) OVER (PARTITION BY {groups}) AS n FROM {source}""",
        "bundle_scores": f"""SELECT {groups}, probability, count(*) AS here, sum(target) AS hits,
  sum(sum(target)) OVER w AS tp, sum(count(*)) OVER w AS seen FROM {source} GROUP BY {groups}, probability
  WINDOW w AS (PARTITION BY {groups} ORDER BY probability DESC)""",
        "bundle_totals": f"""SELECT {groups}, count(*) AS n, sum(target) AS pos, avg(probability) AS average_score,
  avg(target) AS positive_rate,
  avg((probability - target) * (probability - target)) AS brier_score, min(probability) AS min_predicted_probability,
  max(probability) AS max_predicted_probability,
  avg(target) FILTER (WHERE nth <= greatest(1, ceil(n * 0.1::DOUBLE))) AS precision_at_top_decile,
  coalesce(sum(target) FILTER (WHERE nth <= greatest(1, ceil(n * {capacity}::DOUBLE))) / NULLIF(sum(target), 0), 0)
    AS recall_at_manual_review_capacity FROM bundle_ranks GROUP BY {groups}""",
        "bundle": f"""SELECT a.*, a.precision_at_top_decile / NULLIF(a.positive_rate, 0) AS top_decile_lift,
  CASE WHEN a.pos > 0 AND a.pos < a.n THEN b.wins / (a.pos * (a.n - a.pos)) END AS roc_auc,
  CASE WHEN a.pos > 0 AND a.pos < a.n THEN b.area / a.pos END AS pr_auc
FROM bundle_totals a JOIN (SELECT {groups}, sum((here - hits) * ((tp - hits) + hits / 2.0::DOUBLE)) AS wins, sum(hits * (tp / seen::DOUBLE)) AS area
  FROM bundle_scores GROUP BY {groups}) b ON {same}""",
    }


def _long(source: str = "bundle", groups: str = G) -> str:
    return " UNION ALL ".join(
        f"SELECT {groups}, '{m}' AS metric_name, {round6(f'CAST({m} AS DOUBLE)')} AS metric_value, '{NOW}' AS created_at FROM {source}"
        for m in RANK_METRICS
    )


def _tenth(source: str, name: str, order: str, groups: str = G) -> str:
    return f"""SELECT *, CAST(ceil(row_number() OVER (PARTITION BY {groups} ORDER BY probability {order}, SK_ID_CURR)
  * 10 / (count(*) OVER (PARTITION BY {groups}))::DOUBLE) AS INTEGER) AS {name} FROM {source}"""


def _bins(source: str) -> dict[str, str]:
    return {
        "binned": _tenth(source, "bin_id", "ASC"),
        "bins": f"""SELECT {G}, CAST(i AS INTEGER) AS bin_id, count(SK_ID_CURR) AS applicant_count,
  avg(probability) AS average_predicted_score, avg(target) AS observed_default_rate,
  avg(target) - avg(probability) AS calibration_error
FROM (SELECT DISTINCT {G} FROM {source}) CROSS JOIN range(1, 11) t(i)
LEFT JOIN binned USING ({G}) WHERE bin_id = i OR bin_id IS NULL GROUP BY ALL""",
        "bin_errors": f"""SELECT {G}, avg(abs(calibration_error)) AS mean_absolute_bin_error,
  sum(abs(calibration_error) * applicant_count) / sum(applicant_count) AS weighted_calibration_error,
  max(abs(calibration_error)) AS max_absolute_bin_error FROM bins GROUP BY ALL""",
    }


SCENARIOS = {"growth_oriented": (0.85, 0.95), "balanced": (0.80, 0.90), "risk_averse": (0.70, 0.80)}

_CTES = {
    "scored": f"""SELECT SK_ID_CURR, source_population, CAST(TARGET AS INTEGER) AS TARGET, *EXCLUDE (SK_ID_CURR, source_population, TARGET),
  {_dyadic(f"1 / (1 + exp(-({_MARGIN})))")} AS fine FROM mart_v1""",
    "labeled": "SELECT SK_ID_CURR, TARGET, fine FROM scored WHERE source_population = 'application_train'",
    "splits": _split(42),
    "split_scores": "SELECT l.*, s.split FROM labeled l JOIN splits s USING (SK_ID_CURR)",
    "predictions": _two("split_scores"),
    "cut": " UNION ALL ".join(
        f"SELECT '{s}' AS scenario_name, quantile_cont(probability, {lo}) AS low, quantile_cont(probability, {hi}) AS high"
        f" FROM predictions WHERE split = 'validation' AND model_version = '{COARSE}'"
        for s, (lo, hi) in SCENARIOS.items()
    ),
    "levels": f"""SELECT probability, row_number() OVER (ORDER BY probability) - 1 AS i, count(*) OVER () - 1 AS last
FROM (SELECT DISTINCT probability FROM predictions WHERE split = 'validation' AND model_version = '{COARSE}')""",
    "pairs": "SELECT scenario_name, CASE WHEN low < high THEN low ELSE low_level END AS threshold_low, "
    "CASE WHEN low < high THEN high ELSE high_level END AS threshold_high FROM cut JOIN ("
    + " UNION ALL ".join(
        f"""SELECT '{s}' AS scenario_name, max(probability) FILTER (WHERE i = least(floor({lo} * last), last - 1)) AS low_level,
  max(probability) FILTER (WHERE i = least(greatest(ceil({hi} * last), least(floor({lo} * last), last - 1) + 1), last)) AS high_level FROM levels"""
        for s, (lo, hi) in SCENARIOS.items()
    )
    + ") USING (scenario_name)",
    "balanced_pair": "SELECT threshold_low, threshold_high FROM pairs WHERE scenario_name = 'balanced'",
    "banded": """SELECT p.*, scenario_name, threshold_low, threshold_high, CASE WHEN probability >= threshold_high THEN 'high_risk'
  WHEN probability >= threshold_low THEN 'manual_review' ELSE 'approve' END AS band
FROM predictions p, pairs WHERE split <> 'train'""",
    "fine_cut": "SELECT quantile_cont(fine, 0.8) AS low, quantile_cont(fine, 0.9) AS high FROM split_scores WHERE split = 'validation'",
    "populations": """SELECT SK_ID_CURR, 'holdout_test' AS scoring_population, TARGET, fine AS probability FROM split_scores WHERE split = 'test'
UNION ALL SELECT SK_ID_CURR, 'kaggle_test', TARGET, fine FROM scored WHERE source_population = 'application_test'""",
    "score_table": f"""SELECT SK_ID_CURR AS applicant_id, scoring_population, TARGET AS observed_target, probability AS score,
  probability AS raw_risk_score, {_calibrated("probability")} AS calibrated_risk_score, 'sigmoid' AS calibration_method,
  score_decile, CASE WHEN probability < low THEN 'low_risk' WHEN probability < high THEN 'medium_risk' ELSE 'high_risk' END AS risk_band,
  CASE WHEN probability < low THEN 'approve' WHEN probability < high THEN 'manual_review' ELSE 'high_priority_review' END AS recommended_action,
  'threshold_v1' AS threshold_version, '{FINE}' AS model_version, CAST(NULL AS VARCHAR) AS top_reason_1,
  CAST(NULL AS VARCHAR) AS top_reason_2, CAST(NULL AS VARCHAR) AS top_reason_3, TIMESTAMP '2026-01-01 00:00:00' AS scored_at
FROM ({_tenth("populations", "score_decile", "DESC", "scoring_population")}), fine_cut""",
    "parts": "SELECT t.applicant_id, t.scoring_population, t.model_version, t.threshold_version, label, i, v FROM score_table t JOIN scored s "
    "ON s.SK_ID_CURR = t.applicant_id, LATERAL (VALUES "
    + ", ".join(f"('{n}', {i}, {_dyadic(e)})" for i, (n, e) in enumerate(_TERMS.items()))
    + ") x(label, i, v)",
    "reasons": """SELECT applicant_id, scoring_population, model_version, threshold_version,
  max('Higher risk: ' || label) FILTER (WHERE v > 0 AND nth = 1) AS top_reason_1,
  max('Higher risk: ' || label) FILTER (WHERE v > 0 AND nth = 2) AS top_reason_2,
  max('Higher risk: ' || label) FILTER (WHERE v > 0 AND nth = 3) AS top_reason_3
FROM (SELECT *, row_number() OVER (PARTITION BY applicant_id, scoring_population ORDER BY v DESC, i) AS nth FROM parts) GROUP BY ALL""",
}


def named(select: str, *more: dict[str, str]) -> str:
    known = dict(_CTES)
    for part in more:
        known |= part
    return compose(select, known)


_FEATURE_TABLES = {
    "f_applicant_static": ("f_applicant", ["SK_ID_CURR", "source_population"], len(APPLICANT) + 3),
    "segment_diagnostics": ("f_diagnostics", ["SK_ID_CURR", "source_population"], 9),
    "f_bureau_agg": ("f_bureau", ["SK_ID_CURR"], len(BUREAU) + 1),
    "f_bureau_balance_agg": ("f_balance", ["SK_ID_CURR"], len(BALANCE) + 1),
    "f_pos_cash_agg": ("f_pos", ["SK_ID_CURR"], len(POS) + 1),
    "f_credit_card_agg": ("f_card", ["SK_ID_CURR"], len(CARD) + 1),
    "f_previous_application_agg": ("f_previous", ["SK_ID_CURR"], len(PREVIOUS) + 1),
    "f_installments_agg": ("f_installments", ["SK_ID_CURR"], len(INSTALLMENTS) + 1),
    "f_risk_pressure_features": ("f_pressure", ["SK_ID_CURR", "source_population"], len(PRESSURE) + 2),
    "f_recency_deterioration_features": ("f_recency", ["SK_ID_CURR", "source_population"], len(RECENCY) + 2),
    "f_last_k_temporal_features": ("f_last_k", ["SK_ID_CURR", "source_population"], len(LAST_K) + 2),
    "mart_credit_risk_features": ("mart", ["SK_ID_CURR", "source_population"], len(FULL) + 3),
}


def _profile(name: str, cte: str, keys: list[str], width: int) -> str:
    listed = ", ".join(keys)
    return f"""SELECT '{name}' AS table_name, (SELECT count(*) FROM {cte}) AS row_count,
  (SELECT count(DISTINCT SK_ID_CURR) FROM {cte}) AS distinct_applicant_count,
  (SELECT count(*) FROM (SELECT {listed} FROM {cte} GROUP BY ALL HAVING count(*) > 1)) AS duplicate_key_count,
  {width} AS column_count, '{NOW}' AS created_at_utc"""


def _inventory() -> str:
    parts = []
    for c in required_tables(True):
        cte, _, _ = _FEATURE_TABLES.get(c.name, (c.name, None, None))
        has_id = c.name not in ("stg_bureau_balance",)
        has_target = c.name in ("stg_application_train", "f_applicant_static", "segment_diagnostics", "mart_credit_risk_features")
        listed = ", ".join(c.grain)
        ids = f"(SELECT count(DISTINCT SK_ID_CURR) FROM {cte})" if has_id else "CAST(NULL AS BIGINT)"
        count = (lambda test: f"(SELECT count(*) FROM {cte} WHERE TARGET {test})") if has_target else (lambda test: "CAST(0 AS BIGINT)")
        parts.append(f"""SELECT '{c.name}' AS table_name, '{c.layer}' AS layer, '{",".join(c.grain)}' AS grain_key,
  (SELECT count(*) FROM {cte}) AS row_count, {ids} AS distinct_applicant_count,
  (SELECT count(*) FROM (SELECT {listed} FROM {cte} GROUP BY ALL HAVING count(*) > 1)) AS duplicate_grain_key_count,
  {str(has_target).lower()} AS has_target_column, {count("IS NOT NULL")} AS target_non_null_count,
  {count("IS NULL")} AS target_null_count, '{NOW}' AS created_at_utc""")
    return " UNION ALL ".join(parts)


KINDS = {
    **{c: "string" for c in ("source_population", "NAME_CONTRACT_TYPE", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_INCOME_TYPE",
                             "NAME_EDUCATION_TYPE", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE")},
    "ext_source_missing_count": "int",
}


def _exact_mean(value: str) -> str:
    """The mean of fractions cut at 20 and 50 binary digits, whose sums are the same in any order."""
    coarse = f"CASE WHEN abs({value}) < {1 << 32} THEN floor(({value}) * {1 << 20}) / {1 << 20} ELSE {value} END"
    rest = f"floor((({value}) - ({coarse})) * {1 << 50}) / {1 << 50}"
    return f"(sum({coarse}) + sum({rest})) / NULLIF(count({value}), 0)"


# Distinct values can only be counted of means that do not depend on the order of the rows.
_EXACT_MEANS = {
    "f_previous": _by_applicant("stg_previous_application", PREVIOUS | {
        "avg_credit_to_application_ratio": (_exact_mean("AMT_CREDIT / NULLIF(AMT_APPLICATION, 0)"), True)}),
    "f_installments": _by_applicant("stg_installments_payments", INSTALLMENTS | {
        "avg_payment_to_instalment_ratio": (_exact_mean("AMT_PAYMENT / NULLIF(AMT_INSTALMENT, 0)"), True)}),
}


def _column_inventory() -> str:
    groups = Settings().exclusion_groups()
    parts = []
    for name in ["SK_ID_CURR", "source_population", "TARGET", *V1]:
        kind = KINDS.get(name) or ("double" if V1.get(name, ("", False))[1] else "bigint")
        group = groups.get(name, "")
        parts.append(f"""SELECT 'mart_credit_risk_features' AS table_name, '{name}' AS column_name, '{kind}' AS column_type,
  {str(not group).lower()} AS is_model_feature, '{group}' AS exclusion_group, count(*) - count({name}) AS missing_count,
  {round6(f"(count(*) - count({name})) / count(*)")} AS missing_rate, count(DISTINCT {name}) AS distinct_value_count,
  '{NOW}' AS created_at_utc FROM mart_v1""")
    return " UNION ALL ".join(parts)


_DAMAGED = {
    "doubled": "SELECT * FROM mart_v1 UNION ALL SELECT * FROM mart_v1 WHERE SK_ID_CURR % 100 = 3",
    "damaged": """SELECT * REPLACE (CASE WHEN SK_ID_CURR % 49 = 0 THEN 1 WHEN SK_ID_CURR % 97 = 5 THEN NULL
  WHEN SK_ID_CURR % 103 = 7 THEN 2 ELSE TARGET END AS TARGET) FROM doubled WHERE SK_ID_CURR % 211 <> 9""",
    "recon": """SELECT source_population, CAST(sum(s) AS BIGINT) AS staging_rows, CAST(sum(m) AS BIGINT) AS mart_rows FROM (
  SELECT 'application_train' AS source_population, 1 AS s, 0 AS m FROM stg_application_train UNION ALL
  SELECT 'application_test', 1, 0 FROM stg_application_test UNION ALL SELECT source_population, 0, 1 FROM damaged) GROUP BY ALL""",
}

_VIOLATIONS = """SELECT * FROM (
  SELECT 'diagnostic-only column in the mart' AS "check", 'CODE_GENDER' AS detail, CAST(1 AS BIGINT) AS n
  UNION ALL SELECT 'train TARGET is null', 'application_train', count(*) FROM damaged WHERE source_population = 'application_train' AND TARGET IS NULL
  UNION ALL SELECT 'train TARGET is not binary', 'application_train', count(*) FROM damaged WHERE source_population = 'application_train' AND TARGET NOT IN (0, 1)
  UNION ALL SELECT 'test TARGET is not null', 'application_test', count(*) FROM damaged WHERE source_population = 'application_test' AND TARGET IS NOT NULL
  UNION ALL SELECT 'model feature is 100% missing', 'OWN_CAR_AGE', CAST(1 AS BIGINT)
  UNION ALL SELECT 'duplicate grain keys', 'mart_credit_risk_features', count(*) FROM (SELECT SK_ID_CURR, source_population FROM damaged GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'staging rows differ from mart rows', source_population || ': staging=' || staging_rows || ', mart=' || mart_rows,
    abs(staging_rows - mart_rows) FROM recon WHERE staging_rows <> mart_rows) WHERE n <> 0"""

_SEGMENTS = {
    "segment_scores": _two(
        "(SELECT s.*, " + ", ".join(f"d.{c}" for c in SEGMENT_DIMENSIONS)
        + " FROM split_scores s JOIN f_diagnostics d USING (SK_ID_CURR) WHERE split <> 'train')",
        "".join(f", {c}" for c in SEGMENT_DIMENSIONS),
    ),
    "segment_long": " UNION ALL ".join(
        f"SELECT {G}, SK_ID_CURR, target, probability, '{c}' AS segment_name, "
        + (f"coalesce(CAST(CAST({c} AS BIGINT) AS VARCHAR), 'missing')" if c.startswith("CNT") else f"coalesce({c}, 'missing')")
        + " AS segment_value FROM segment_scores"
        for c in SEGMENT_DIMENSIONS
    ),
}

_COMPARED = {
    "compared": f"""SELECT 'uncalibrated' AS model_version, split, SK_ID_CURR, target, probability FROM predictions
  WHERE model_version = '{FINE}' AND split <> 'train' UNION ALL
SELECT 'sigmoid', split, SK_ID_CURR, target, {_calibrated("probability")} FROM predictions
  WHERE model_version = '{FINE}' AND split <> 'train'""",
}

_ADJUSTED = {
    "adjusted": f"""SELECT * FROM predictions WHERE model_version = '{COARSE}' UNION ALL
SELECT 'dashboard', split, SK_ID_CURR, target, {_calibrated("probability")} FROM predictions WHERE model_version = '{FINE}'""",
}


def _runs() -> dict[str, str]:
    assigned = " UNION ALL ".join(
        f"SELECT l.SK_ID_CURR, l.TARGET, l.fine, '{seed}|' || s.split AS split FROM labeled l JOIN splits_{seed} s USING (SK_ID_CURR) WHERE s.split <> 'train'"
        for seed in SEEDS
    )
    value = "(1000.0 * good - 5000.0 * bad - 50.0 * review)"
    measures = [m.removeprefix("validation_") for m in RUN_METRICS if m.startswith("validation_")]
    names = {"recall_at_review_capacity": "recall_at_manual_review_capacity", "balanced_ev_per_applicant": "ev"}
    columns = ", ".join(
        f"{round6(f'max({names.get(m, m)}) FILTER (WHERE part = {chr(39)}{s}{chr(39)})')} AS {s}_{m}"
        for s in ("validation", "test")
        for m in measures
    )
    return {
        **{f"splits_{seed}": _split(seed) for seed in SEEDS},
        "assigned": assigned,
        "run_scores": _two("assigned"),
        **_bundle("run_scores"),
        **_bins("run_scores"),
        "run_values": f"""SELECT {G}, {value} / n AS ev FROM (SELECT {G}, count(*)::DOUBLE AS n,
  count(*) FILTER (WHERE probability < 0.12 AND target = 0) AS good, count(*) FILTER (WHERE probability < 0.12 AND target = 1) AS bad,
  count(*) FILTER (WHERE probability >= 0.12 AND probability < 0.16) AS review FROM run_scores GROUP BY ALL)""",
        "runs": f"""SELECT CAST(str_split(split, '|')[1] AS INTEGER) AS seed, model_version AS feature_set,
  CASE WHEN model_version = '{FINE}' THEN 6 ELSE 2 END AS feature_count, {columns}
FROM (SELECT *, str_split(split, '|')[2] AS part FROM bundle JOIN bin_errors USING ({G}) JOIN run_values USING ({G})) GROUP BY ALL""",
        "marked": """SELECT *, row_number() OVER (PARTITION BY seed ORDER BY validation_pr_auc DESC, validation_top_decile_lift DESC,
  validation_recall_at_review_capacity DESC, validation_roc_auc DESC, validation_brier_score, feature_count, feature_set) = 1
  AS seed_validation_winner FROM runs""",
        "stable": "SELECT feature_set, min(feature_count) AS feature_count, 'full' AS feature_limit, count(DISTINCT seed) AS seed_count, "
        "count(*) FILTER (WHERE seed_validation_winner) AS validation_win_count, "
        + ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in STABILITY_METRICS)
        + " FROM marked GROUP BY ALL",
    }


def _stability() -> str:
    pr = "test_pr_auc_mean - validation_pr_auc_mean"
    ev = "test_balanced_ev_per_applicant_mean - validation_balanced_ev_per_applicant_mean"
    derived = {
        "selected": """row_number() OVER (ORDER BY validation_pr_auc_mean DESC, validation_win_count DESC,
  validation_top_decile_lift_mean DESC, validation_recall_at_review_capacity_mean DESC, validation_roc_auc_mean DESC,
  validation_brier_score_mean, validation_pr_auc_std, feature_count, feature_set) = 1""",
        "validation_win_rate": round6("validation_win_count / seed_count"),
        "pr_auc_generalization_gap": round6(pr),
        "abs_pr_auc_generalization_gap": round6(f"abs({pr})"),
        "balanced_ev_generalization_gap": round6(ev),
        "abs_balanced_ev_generalization_gap": round6(f"abs({ev})"),
        "created_at": f"'{NOW}'",
    }
    for m in STABILITY_METRICS:
        for part in ("mean", "std"):
            derived[f"{m}_{part}"] = round6(f"{m}_{part}")
    columns = ", ".join(f"{derived.get(c, c)} AS {c}" for c in REPORTS["model_stability_summary"])
    return f"SELECT {columns} FROM stable"


def _wide(source: str, *names: str) -> str:
    return f"SELECT {G}, " + ", ".join(f"{round6(f'CAST({n} AS DOUBLE)')} AS {n}" for n in names) + f" FROM {source}"


def _rates() -> str:
    return " UNION ALL ".join(
        f"""SELECT {G}, {rate}::DOUBLE AS rate, count(*) FILTER (WHERE hit) AS selected_count,
  {round6("avg(target) FILTER (WHERE hit)")} AS precision_at_rate,
  {round6("coalesce(sum(target) FILTER (WHERE hit) / NULLIF(sum(target), 0), 0)")} AS recall_at_rate,
  {round6("avg(target) FILTER (WHERE hit) / NULLIF(avg(target), 0)")} AS lift_at_rate
FROM (SELECT *, nth <= greatest(1, ceil(n * {rate}::DOUBLE)) AS hit FROM bundle_ranks) GROUP BY {G}"""
        for rate in (0.01, 0.05, 0.10, 0.33, 1.0)
    )


def _policy_rows() -> str:
    value = "(1000.0 * good - 5000.0 * bad - 50.0 * review)"
    rate = {
        "approval_rate": "(good + bad) / n",
        "manual_review_rate": "review / n",
        "high_risk_rate": "high / n",
        "default_rate_approved": "bad / NULLIF(good + bad, 0)",
        "high_risk_default_capture_rate": "caught / NULLIF(defaults, 0)",
        "expected_value": f"CAST({value} AS DOUBLE)",
        "expected_value_per_applicant": f"{value} / n::DOUBLE",
    }
    return f"""SELECT {G}, 'threshold_v1' AS threshold_version, scenario_name, {round6("threshold_low")} AS threshold_low,
  {round6("threshold_high")} AS threshold_high, n AS applicant_count, good AS approved_good_count, bad AS approved_bad_count,
  review AS manual_review_count, high AS high_risk_count, '{NOW}' AS created_at,
  {", ".join(f"{round6(e)} AS {n}" for n, e in rate.items())}
FROM (SELECT {G}, scenario_name, threshold_low, threshold_high, count(*) AS n, sum(target) AS defaults,
  count(*) FILTER (WHERE band = 'approve' AND target = 0) AS good, count(*) FILTER (WHERE band = 'approve' AND target = 1) AS bad,
  count(*) FILTER (WHERE band = 'manual_review') AS review, count(*) FILTER (WHERE band = 'high_risk') AS high,
  count(*) FILTER (WHERE band = 'high_risk' AND target = 1) AS caught FROM banded GROUP BY ALL)"""


def _lift() -> str:
    hits = "sum(target)"
    return f"""SELECT {G}, CAST(i AS INTEGER) AS decile, applicant_count, {round6("average_score")} AS average_score,
  {round6("rate")} AS observed_default_rate, {round6("base")} AS portfolio_default_rate, {round6("rate / NULLIF(base, 0)")} AS lift,
  {round6(f"sum(hits) OVER (PARTITION BY {G} ORDER BY i) / NULLIF(sum(hits) OVER (PARTITION BY {G}), 0)")} AS cumulative_default_capture_rate
FROM (SELECT {G}, i, count(*) AS applicant_count, avg(probability) AS average_score, avg(target) AS rate, {hits} AS hits,
  sum({hits}) OVER (PARTITION BY {G}) / sum(count(*)) OVER (PARTITION BY {G}) AS base
  FROM (SELECT *, decile AS i FROM deciles) GROUP BY {G}, i)"""


def segment_count_sql() -> str:
    """How many (model, split, dimension, value) rows the segment table has."""
    counts = " + ".join(
        f"(SELECT count(*) FROM (SELECT DISTINCT split, {c} FROM split_scores JOIN f_diagnostics USING (SK_ID_CURR) WHERE split <> 'train'))"
        for c in SEGMENT_DIMENSIONS
    )
    return f"2 * ({counts})"


_BAND = {"approve": ("low_risk", "approve"), "manual_review": ("medium_risk", "manual_review"), "high_risk": ("high_risk", "high_priority_review")}


def model_oracles() -> dict[str, str]:
    pb, bins = _bundle("predictions"), _bins("predictions")
    deciles = {"deciles": _tenth("predictions", "decile", "DESC")}
    documents = {
        "document_scores": """SELECT 'length_score' AS model_version, lang AS split, doc_id AS SK_ID_CURR, CAST(quality AS INTEGER) AS target,
  n_chars / (n_chars + 1500.0::DOUBLE) AS probability FROM documents JOIN labels USING (doc_id)""",
        **_bundle("document_scores", capacity=0.25),
    }
    profiles = [_profile(n, *v) for n, v in _FEATURE_TABLES.items() if n != "mart_credit_risk_features"]
    cells = " UNION ALL ".join(
        f"SELECT {t} AS true_label, {p} AS predicted_label" for t in (0, 1) for p in (0, 1)
    )
    bundle_names = "brier_score min_predicted_probability max_predicted_probability".split()
    compared_columns = [*RANK_METRICS, "mean_absolute_bin_error", "weighted_calibration_error", "max_absolute_bin_error"]
    curve = f"""SELECT {G}, {round6("probability")} AS threshold, {{columns}} FROM (SELECT *,
  sum(hits) OVER (PARTITION BY {G}) AS pos, sum(here - hits) OVER (PARTITION BY {G}) AS neg FROM bundle_scores)"""
    return {
        "table_profile": named(" UNION ALL ".join(profiles)),
        "data_inventory": named(_inventory()),
        "column_inventory": named(_column_inventory(), _EXACT_MEANS),
        "grain_duplicates": named("SELECT SK_ID_PREV, NUM_INSTALMENT_NUMBER, count(*) AS n FROM stg_installments_payments GROUP BY ALL HAVING count(*) > 1"),
        "contract_violations": named(_VIOLATIONS, _DAMAGED),
        "contract_clean": 'SELECT CAST(NULL AS VARCHAR) AS "check", CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS BIGINT) AS n WHERE false',
        "reconciliation": named("SELECT * FROM recon", _DAMAGED),
        "anti_missing_ids": named("SELECT DISTINCT SK_ID_CURR FROM f_applicant WHERE SK_ID_CURR NOT IN (SELECT SK_ID_CURR FROM stg_pos_cash_balance)"),
        "stratified_split": named("SELECT * FROM splits"),
        "split_summary": named(f"""SELECT '{FINE}' AS model_version, 'run' AS run_id, split, count(*) AS row_count,
  CAST(sum(TARGET) AS BIGINT) AS positive_count, CAST(count(*) - sum(TARGET) AS BIGINT) AS negative_count,
  {round6("sum(TARGET) / count(*)")} AS positive_rate, '{NOW}' AS created_at FROM splits GROUP BY split"""),
        "split_rows": named(f"""SELECT m.SK_ID_CURR, m.TARGET, split, {round6("ext_source_mean")} AS ext_source_mean,
  {round6("credit_to_income_ratio")} AS credit_to_income_ratio, late_payment_count, installment_payment_count, active_credit_count,
  CODE_GENDER, NAME_FAMILY_STATUS, applicant_age_band, CNT_CHILDREN, {round6("CNT_FAM_MEMBERS")} AS CNT_FAM_MEMBERS
FROM mart_v1 m JOIN splits s USING (SK_ID_CURR) JOIN f_diagnostics d ON d.SK_ID_CURR = m.SK_ID_CURR AND d.source_population = m.source_population"""),
        "score_bands": named(f"""SELECT {G}, SK_ID_CURR, probability, band, CASE band {" ".join(f"WHEN '{b}' THEN '{v[0]}'" for b, v in _BAND.items())} END AS risk_band,
  CASE band {" ".join(f"WHEN '{b}' THEN '{v[1]}'" for b, v in _BAND.items())} END AS recommended_action
FROM (SELECT *, CASE WHEN probability < threshold_low THEN 'approve' WHEN probability < threshold_high THEN 'manual_review' ELSE 'high_risk' END AS band FROM predictions, balanced_pair)"""),
        "score_decile": named("SELECT * FROM deciles", deciles),
        "lift_by_decile": named(_lift(), deciles),
        "calibration_bins": named(f"""SELECT {G}, bin_id, applicant_count, {round6("average_predicted_score")} AS average_predicted_score,
  {round6("observed_default_rate")} AS observed_default_rate, {round6("calibration_error")} AS calibration_error FROM bins""", bins),
        "bin_error_summary": named(_wide("bin_errors", *compared_columns[-3:]), bins),
        "roc_auc": named(_wide("bundle", "roc_auc"), pb),
        "average_precision": named(_wide("bundle", "pr_auc"), pb),
        "brier_minmax": named(_wide("bundle", *bundle_names), pb),
        "precision_recall_at_rate": named(_rates(), pb),
        "metric_bundle": named(_long(), pb),
        "labels_metrics": named(_long(), documents),
        "roc_points": named(curve.format(columns=f"{round6('(seen - tp) / NULLIF(neg, 0)')} AS false_positive_rate, {round6('tp / NULLIF(pos, 0)')} AS true_positive_rate"), pb),
        "pr_points": named(curve.format(columns=f"{round6('tp / seen')} AS precision, {round6('tp / NULLIF(pos, 0)')} AS recall"), pb),
        "scenario_thresholds": named(f"SELECT scenario_name, {round6('threshold_low')} AS threshold_low, {round6('threshold_high')} AS threshold_high FROM pairs"),
        "tied_thresholds": named(f"SELECT scenario_name, {round6('threshold_low')} AS threshold_low, {round6('threshold_high')} AS threshold_high FROM pairs", {
            "tied": f"""SELECT CASE WHEN SK_ID_CURR % 10 <> 0 THEN 0.5 ELSE probability / 2 END AS probability
FROM predictions WHERE split = 'validation' AND model_version = '{FINE}'""",
            "cut": " UNION ALL ".join(
                f"SELECT '{s}' AS scenario_name, quantile_cont(probability, {lo}) AS low, quantile_cont(probability, {hi}) AS high FROM tied"
                for s, (lo, hi) in SCENARIOS.items()
            ),
            "levels": """SELECT probability, row_number() OVER (ORDER BY probability) - 1 AS i, count(*) OVER () - 1 AS last
FROM (SELECT DISTINCT probability FROM tied)""",
        }),
        "threshold_metrics": named(_policy_rows()),
        "confusion_matrix": named(f"""SELECT {G}, scenario_name, true_label, predicted_label,
  count(*) FILTER (WHERE target = true_label AND (band = 'high_risk')::INT = predicted_label) AS count
FROM banded, ({cells}) GROUP BY {G}, scenario_name, true_label, predicted_label"""),
        "segment_performance": named(f"""SELECT {G}, segment_name, segment_value, n AS applicant_count, {round6("positive_rate")} AS observed_default_rate,
  {round6("average_score")} AS average_score, {round6("roc_auc")} AS roc_auc, {round6("pr_auc")} AS pr_auc, {round6("brier_score")} AS brier_score FROM bundle""",
            _SEGMENTS, _bundle("segment_long", f"{G}, segment_name, segment_value")),
        "platt_apply": named(f"SELECT *, {_calibrated('probability')} AS calibrated FROM predictions"),
        "calibration_comparison": named(f"""SELECT '{FINE}_' || model_version AS model_version, '{FINE}' AS base_model_version,
  model_version AS calibration_method, split, {", ".join(f"{round6(f'CAST({c} AS DOUBLE)')} AS {c}" for c in compared_columns)},
  '{NOW}' AS created_at FROM bundle JOIN bin_errors USING ({G})""", _COMPARED, _bundle("compared"), _bins("compared")),
        "risk_scores": named("SELECT * FROM score_table"),
        "linear_contributions": named(f"""SELECT SK_ID_CURR, source_population,
  {round6("0.25 * (coalesce(bureau_credit_count, 0) - 10)::DOUBLE")} AS bureau_credit_count,
  {round6("-0.5 * (coalesce(AMT_ANNUITY, 0) - 20000)")} AS AMT_ANNUITY FROM mart_v1"""),
        "feature_importance": named(f"""SELECT '{FINE}' AS model_version, label AS feature_name, 'mean_abs_shap' AS importance_type,
  {round6("v")} AS importance_value, CAST(row_number() OVER (ORDER BY v DESC, label) AS INTEGER) AS rank
FROM (SELECT label, avg(abs(v)) AS v FROM parts GROUP BY ALL) WHERE v > 0"""),
        "top_reasons": named("SELECT * FROM reasons"),
        "merge_reasons": named("""SELECT s.* REPLACE (CASE WHEN s.scoring_population = 'holdout_test' THEN r.top_reason_1 END AS top_reason_1,
  CASE WHEN s.scoring_population = 'holdout_test' THEN r.top_reason_2 END AS top_reason_2,
  CASE WHEN s.scoring_population = 'holdout_test' THEN r.top_reason_3 END AS top_reason_3)
FROM score_table s LEFT JOIN reasons r ON s.applicant_id = r.applicant_id AND s.scoring_population = r.scoring_population"""),
        "stability_summary": named(_stability(), _runs()),
        "feature_set_winner": named("SELECT seed, feature_set, seed_validation_winner, " + ", ".join(RUN_METRICS) + " FROM marked", _runs()),
        "relabel_union": named(_long(), _ADJUSTED, _bundle("adjusted")),
        "replaced_partitions": named(_long(), _ADJUSTED, _bundle("adjusted")),
        "model_comparison": named(f"""SELECT metric_name, {round6("b")} AS baseline_metric_value, {round6("c")} AS trees_metric_value,
  {round6("c - b")} AS trees_minus_baseline, (SELECT CASE WHEN max(pr_auc) FILTER (WHERE model_version = '{FINE}') >=
    max(pr_auc) FILTER (WHERE model_version = '{COARSE}') THEN 'boosted_trees' ELSE 'logistic_regression' END FROM bundle WHERE split = 'validation') AS selected_model_type
FROM (SELECT metric_name, max(v) FILTER (WHERE model_version = '{COARSE}') AS b, max(v) FILTER (WHERE model_version = '{FINE}') AS c
FROM (UNPIVOT (SELECT model_version, {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in RANK_METRICS)} FROM bundle WHERE split = 'validation')
  ON {", ".join(RANK_METRICS)} INTO NAME metric_name VALUE v) GROUP BY ALL)""", pb),
    }
