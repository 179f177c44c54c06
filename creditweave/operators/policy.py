"""Risk bands, scenario thresholds and what each scenario would cost or earn."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditweave.functions.expressions import col, ratio
from creditweave.operators.metrics import GROUPS
from creditweave.operators.ordering import ranked
from creditweave.operators.quantiles import exact_quantiles
from creditweave.schemas import REPORTS
from creditweave.settings import SCENARIO_QUANTILES, BusinessAssumptions
from creditweave.sources.workspace import Stored, store, stored

# What each band is called in the score table and what follows from it.
BAND_ACTIONS = {
    "approve": ("low_risk", "approve"),
    "manual_review": ("medium_risk", "manual_review"),
    "high_risk": ("high_risk", "high_priority_review"),
}


class PolicyError(ValueError):
    """Thresholds are missing, out of range or not ordered."""


@dataclass(frozen=True)
class Thresholds:
    low: float
    high: float


def checked_pair(low: Any, high: Any, scenario: str) -> Thresholds:
    values = []
    for name, value in (("threshold_low", low), ("threshold_high", high)):
        try:
            number = float(value)
        except (TypeError, ValueError):
            raise PolicyError(f"{name} of {scenario} is not a number") from None
        if not math.isfinite(number) or not 0 <= number <= 1:
            raise PolicyError(f"{name} of {scenario} lies outside 0 to 1")
        values.append(number)
    if values[0] >= values[1]:
        raise PolicyError(f"The thresholds of {scenario} are not in rising order: {values}")
    return Thresholds(*values)


def risk_band(score: Column | str, pair: Thresholds) -> Column:
    s = col(score)
    return (
        F.when(s < pair.low, "approve").when(s < pair.high, "manual_review").when(
            s.isNotNull(), "high_risk"
        )
    )


def band_label(band: Column) -> Column:
    return _lookup(band, 0)


def band_action(band: Column) -> Column:
    return _lookup(band, 1)


def _lookup(band: Column, position: int) -> Column:
    pairs = [F.lit(v) for name, labels in BAND_ACTIONS.items() for v in (name, labels[position])]
    return F.create_map(*pairs)[band]


def scenario_thresholds(
    validation: DataFrame | Stored,
    configured: Mapping[str, Mapping[str, Any]] | None = None,
    score: str = "probability",
) -> dict[str, Thresholds]:
    """One pair per scenario: the configured one, else quantiles of the validation scores.

    When ties make both quantiles equal, neighbouring distinct scores are taken.
    """
    configured = configured or {}
    pairs: dict[str, Thresholds] = {}
    open_scenarios = []
    for scenario in SCENARIO_QUANTILES:
        entry = configured.get(scenario) or {}
        given = [entry.get("threshold_low"), entry.get("threshold_high")]
        if given == [None, None]:
            open_scenarios.append(scenario)
        elif None in given:
            raise PolicyError(f"Only one threshold is given for {scenario}")
        else:
            pairs[scenario] = checked_pair(*given, scenario)
    if open_scenarios:
        source = stored(validation, "validation")
        s = F.col(score)
        summary = source.frame.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("bad"),
            F.min(s).alias("low"),
            F.max(s).alias("high"),
        ).first()
        if not summary["n"]:
            raise PolicyError("No validation row to take thresholds from")
        if summary["bad"]:
            raise PolicyError(f"{summary['bad']} validation rows have no finite score")
        if summary["low"] == summary["high"]:
            raise PolicyError(f"All validation scores are {summary['low']}, so no threshold parts them")
        wanted = sorted({q for sc in open_scenarios for q in SCENARIO_QUANTILES[sc]})
        found = dict(zip(wanted, exact_quantiles(source, [score], wanted)[score], strict=True))
        for scenario in open_scenarios:
            low_q, high_q = SCENARIO_QUANTILES[scenario]
            low, high = found[low_q], found[high_q]
            if low >= high:
                low, high = _neighbouring_scores(source, score, low_q, high_q)
            pairs[scenario] = checked_pair(low, high, scenario)
    return {scenario: pairs[scenario] for scenario in SCENARIO_QUANTILES}


def _neighbouring_scores(
    source: Stored, score: str, low_q: float, high_q: float
) -> tuple[float, float]:
    scores = store(
        source.frame.groupBy(F.col(score).alias("value")).agg(F.lit(0).alias("_all")), "scores"
    )
    last = scores.rows - 1
    low_at = min(math.floor(low_q * last), last - 1)
    high_at = min(max(math.ceil(high_q * last), low_at + 1), last)
    rows = ranked(scores, ["_all"], [F.col("value").asc()]).where(
        F.col("rank").isin(low_at + 1, high_at + 1)
    )
    values = {r["rank"]: r["value"] for r in rows.select("rank", "value").collect()}
    return values[low_at + 1], values[high_at + 1]


def _band_counts(
    predictions: DataFrame, pairs: Mapping[str, Thresholds], groups: Sequence[str]
) -> DataFrame:
    """Rows per target and band for every scenario, as columns of one aggregation."""
    counts = []
    for scenario, pair in pairs.items():
        band = risk_band("probability", pair)
        for target in (0, 1):
            for name in BAND_ACTIONS:
                hit = (band == name) & (F.col("target") == target)
                counts.append(F.count_if(hit).alias(f"{scenario}|{target}|{name}"))
    return predictions.groupBy(*groups).agg(F.count(F.lit(1)).alias("applicants"), *counts)


def threshold_metrics(
    predictions: DataFrame,
    pairs: Mapping[str, Thresholds],
    threshold_version: str,
    created_at: str,
    assumptions: BusinessAssumptions = BusinessAssumptions(),
    groups: Sequence[str] = GROUPS,
) -> DataFrame:
    """What each scenario approves, reviews and flags, and its expected value."""
    n = F.col("applicants")
    entries = []
    for scenario, pair in pairs.items():
        good, bad = F.col(f"{scenario}|0|approve"), F.col(f"{scenario}|1|approve")
        review = F.col(f"{scenario}|0|manual_review") + F.col(f"{scenario}|1|manual_review")
        caught = F.col(f"{scenario}|1|high_risk")
        flagged = F.col(f"{scenario}|0|high_risk") + caught
        defaults = bad + F.col(f"{scenario}|1|manual_review") + caught
        value = expected_value(good, bad, review, assumptions)
        entries.append(
            F.struct(
                F.lit(scenario).alias("scenario_name"),
                F.lit(pair.low).alias("threshold_low"),
                F.lit(pair.high).alias("threshold_high"),
                n.alias("applicant_count"),
                ratio(good + bad, n).alias("approval_rate"),
                ratio(review, n).alias("manual_review_rate"),
                ratio(flagged, n).alias("high_risk_rate"),
                good.alias("approved_good_count"),
                bad.alias("approved_bad_count"),
                review.alias("manual_review_count"),
                flagged.alias("high_risk_count"),
                ratio(bad, good + bad).alias("default_rate_approved"),
                ratio(caught, defaults).alias("high_risk_default_capture_rate"),
                value.alias("expected_value"),
                ratio(value, n).alias("expected_value_per_applicant"),
            )
        )
    rows = _band_counts(predictions, pairs, groups).select(
        *groups, F.explode(F.array(*entries)).alias("_e")
    )
    return rows.select(
        *groups,
        F.lit(threshold_version).alias("threshold_version"),
        "_e.*",
        F.lit(created_at).alias("created_at"),
    )


def expected_value(
    good: Column, bad: Column, review: Column, assumptions: BusinessAssumptions
) -> Column:
    return (
        good * F.lit(assumptions.margin_per_good)
        - bad * F.lit(assumptions.loss_per_bad)
        - review * F.lit(assumptions.review_cost)
    )


def confusion_matrix(
    predictions: DataFrame, pairs: Mapping[str, Thresholds], groups: Sequence[str] = GROUPS
) -> DataFrame:
    """Four cells per scenario, empty ones included; high_risk is the predicted default."""
    cells = []
    for scenario in pairs:
        for target in (0, 1):
            flagged = F.col(f"{scenario}|{target}|high_risk")
            passed = F.col(f"{scenario}|{target}|approve") + F.col(
                f"{scenario}|{target}|manual_review"
            )
            for predicted, count in ((0, passed), (1, flagged)):
                cells.append(
                    F.struct(
                        F.lit(scenario).alias("scenario_name"),
                        F.lit(target).alias("true_label"),
                        F.lit(predicted).alias("predicted_label"),
                        count.alias("count"),
                    )
                )
    table = (
        _band_counts(predictions, pairs, groups)
        .select(*groups, F.explode(F.array(*cells)).alias("_e"))
        .select(*groups, "_e.*")
    )
    return table.select(*REPORTS["model_confusion_matrix"]) if groups == GROUPS else table
