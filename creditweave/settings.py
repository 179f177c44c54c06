"""Job parameters. Every job takes one frozen ``Settings`` value."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names that appear in the data or in the report tables.
TRAIN_POPULATION = "application_train"
TEST_POPULATION = "application_test"
HOLDOUT_SCORING = "holdout_test"
UNLABELED_SCORING = "kaggle_test"
EVALUATION_SPLITS = ("train", "validation", "test")
REPORTING_SPLITS = ("validation", "test")
BASELINE_VERSION = "logistic_regression_baseline_v1"
BASELINE_TYPE = "logistic_regression"
TREES_VERSION = "boosted_trees_credit_risk_v1"
TREES_TYPE = "boosted_trees"
DASHBOARD_VERSION = "boosted_trees_credit_risk_post_v1"
MODEL_VERSIONS = {BASELINE_TYPE: BASELINE_VERSION, TREES_TYPE: TREES_VERSION}
SCENARIO_QUANTILES = {
    "growth_oriented": (0.85, 0.95),
    "balanced": (0.80, 0.90),
    "risk_averse": (0.70, 0.80),
}
SEGMENT_DIMENSIONS = (
    "CODE_GENDER",
    "NAME_FAMILY_STATUS",
    "applicant_age_band",
    "CNT_CHILDREN",
    "CNT_FAM_MEMBERS",
)

# Columns that no model may see, and the default business assumptions.
_EXCLUDED = {
    "identifiers": ("SK_ID_CURR", "SK_ID_PREV", "SK_ID_BUREAU"),
    "target": ("TARGET",),
    "sensitive_or_protected_status_like": (
        "CODE_GENDER",
        "NAME_FAMILY_STATUS",
        "DAYS_BIRTH",
        "applicant_age_years",
        "applicant_age_band",
        "employment_to_age_ratio",
        "CNT_CHILDREN",
        "CNT_FAM_MEMBERS",
    ),
}


@dataclass(frozen=True)
class BusinessAssumptions:
    margin_per_good: float = 1000.0
    loss_per_bad: float = 5000.0
    review_cost: float = 50.0


@dataclass(frozen=True)
class Settings:
    data_scope: str = "post_v1"
    seed: int = 42
    validation_size: float = 0.15
    test_size: float = 0.15
    class_weighting: bool = True
    tuning_enabled: bool = True
    max_candidates: int = 8
    review_capacity: float = 0.10
    threshold_version: str = "threshold_v1"
    thresholds: dict = field(default_factory=dict)
    assumptions: BusinessAssumptions = BusinessAssumptions()
    excluded: dict = field(default_factory=lambda: dict(_EXCLUDED))

    @property
    def post_v1(self) -> bool:
        return self.data_scope.startswith("post_v1")

    def exclusion_groups(self) -> dict[str, str]:
        """Column name -> the reason it must not enter a model."""
        groups = {"source_population": "metadata"}
        for group, names in self.excluded.items():
            groups.update(dict.fromkeys(names, group))
        return groups

    def forbidden_terms(self) -> list[str]:
        return sorted(self.exclusion_groups())
