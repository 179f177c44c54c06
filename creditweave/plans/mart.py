"""Applicant tables, derived feature families and the two feature marts.

Every history digest is hash-partitioned by the applicant key, so the chain of left joins
reuses that partitioning and only the applicants themselves are shuffled once more.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property, reduce, wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.functions.expressions import absent_count, at_least_zero, present_mean, ratio
from creditweave.operators import history as h
from creditweave.schemas import staging_name
from creditweave.settings import TEST_POPULATION, TRAIN_POPULATION

KEY = ["SK_ID_CURR", "source_population"]
EXTERNAL = ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")

APPLICANT_FEATURES = [
    "NAME_CONTRACT_TYPE",
    "FLAG_OWN_CAR",
    "FLAG_OWN_REALTY",
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "AMT_GOODS_PRICE",
    "credit_to_income_ratio",
    "annuity_to_income_ratio",
    "goods_price_to_income_ratio",
    "NAME_INCOME_TYPE",
    "NAME_EDUCATION_TYPE",
    "NAME_HOUSING_TYPE",
    "REGION_POPULATION_RELATIVE",
    "employment_length_days",
    "DAYS_REGISTRATION",
    "DAYS_ID_PUBLISH",
    "OWN_CAR_AGE",
    "OCCUPATION_TYPE",
    "REGION_RATING_CLIENT",
    "REGION_RATING_CLIENT_W_CITY",
    "HOUR_APPR_PROCESS_START",
    "ORGANIZATION_TYPE",
    "EXT_SOURCE_1",
    "EXT_SOURCE_2",
    "EXT_SOURCE_3",
    "ext_source_mean",
    "ext_source_min",
    "ext_source_max",
    "ext_source_missing_count",
    "DAYS_LAST_PHONE_CHANGE",
]
PRESSURE_FEATURES = (
    "external_score_credit_pressure",
    "external_score_annuity_pressure",
    "bureau_debt_to_income_ratio",
    "payment_shortfall_ratio",
)
RECENCY_FEATURES = (
    "bureau_balance_recent_dpd_rate_delta",
    "bureau_balance_recent_status_delta",
    "pos_cash_recent_dpd_rate_delta",
    "pos_cash_remaining_installment_ratio_delta",
    "credit_card_recent_utilization_delta",
    "credit_card_recent_balance_ratio_delta",
    "credit_card_recent_drawings_ratio_delta",
    "credit_card_recent_dpd_rate_delta",
)
LAST_K_FEATURES = (
    *h.LAST_INSTALLMENT_FEATURES,
    *h.LAST_POS_FEATURES,
    "pos_cash_last_3_dpd_rate_delta",
    "pos_cash_last_loan_dpd_rate",
    *h.LAST_CARD_FEATURES,
    "credit_card_last_3_utilization_delta",
)
V1_FEATURES = (
    *APPLICANT_FEATURES,
    *h.BUREAU_FEATURES,
    *h.PREVIOUS_FEATURES,
    *h.INSTALLMENT_FEATURES,
)
POST_V1_FEATURES = (
    *APPLICANT_FEATURES,
    *h.BUREAU_FEATURES,
    *h.BALANCE_FEATURES,
    *h.POS_FEATURES,
    *h.CARD_FEATURES,
    *RECENCY_FEATURES,
    *LAST_K_FEATURES,
    *h.PREVIOUS_FEATURES,
    *h.INSTALLMENT_FEATURES,
    *PRESSURE_FEATURES,
)


def both_populations(train: DataFrame, test: DataFrame) -> DataFrame:
    """Labeled and unlabeled applications in one frame; the unlabeled TARGET is NULL."""
    labeled = train.withColumn("source_population", F.lit(TRAIN_POPULATION))
    unlabeled = test.withColumn("source_population", F.lit(TEST_POPULATION)).withColumn(
        "TARGET", F.lit(None).cast("bigint")
    )
    return labeled.unionByName(unlabeled)


def applicant_static(train: DataFrame, test: DataFrame) -> DataFrame:
    derived = {
        "credit_to_income_ratio": ratio("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "annuity_to_income_ratio": ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "goods_price_to_income_ratio": ratio("AMT_GOODS_PRICE", "AMT_INCOME_TOTAL"),
        # 365243 marks "not employed", so only negative values are a duration.
        "employment_length_days": F.when(F.col("DAYS_EMPLOYED") < 0, -F.col("DAYS_EMPLOYED")),
        "ext_source_mean": present_mean(*EXTERNAL),
        "ext_source_min": F.least(*EXTERNAL),
        "ext_source_max": F.greatest(*EXTERNAL),
        "ext_source_missing_count": absent_count(*EXTERNAL),
    }
    return both_populations(train, test).select(
        *KEY, "TARGET", *[derived.get(c, F.col(c)).alias(c) for c in APPLICANT_FEATURES]
    )


def segment_diagnostics(train: DataFrame, test: DataFrame) -> DataFrame:
    """Segment fields for reports. They never enter the mart."""
    years = F.floor(-F.col("DAYS_BIRTH") / F.lit(365.25))
    band = (
        F.when(F.col("DAYS_BIRTH").isNull(), None)
        .when(years < 30, "under_30")
        .when(years < 45, "30_to_44")
        .when(years < 60, "45_to_59")
        .otherwise("60_plus")
    )
    return both_populations(train, test).select(
        *KEY,
        "TARGET",
        "CODE_GENDER",
        "NAME_FAMILY_STATUS",
        F.when(F.col("DAYS_BIRTH") < 0, years.cast("bigint")).alias("applicant_age_years"),
        band.alias("applicant_age_band"),
        "CNT_CHILDREN",
        "CNT_FAM_MEMBERS",
    )


def with_histories(base: DataFrame, *digests: DataFrame) -> DataFrame:
    """Left-join applicant-grain digests; applicants without history keep NULLs."""
    return reduce(lambda left, right: left.join(right, h.APPLICANT, "left"), digests, base)


def _pressure() -> dict:
    distance = F.lit(1.0) - F.col("ext_source_mean")
    shortfall = at_least_zero(F.lit(1.0) - F.col("payment_amount_ratio"))
    return {
        "external_score_credit_pressure": distance * F.col("credit_to_income_ratio"),
        "external_score_annuity_pressure": distance * F.col("annuity_to_income_ratio"),
        "bureau_debt_to_income_ratio": ratio("total_credit_debt", "AMT_INCOME_TOTAL"),
        "payment_shortfall_ratio": F.when(F.col("payment_amount_ratio").isNotNull(), shortfall),
    }


def _difference(left: str, right: str):
    return F.col(left) - F.col(right)


def _recency() -> dict:
    """Deltas between columns of two digests; the digests carry the other five."""
    return {
        "bureau_balance_recent_dpd_rate_delta": _difference(
            "bureau_balance_recent_dpd_1plus_rate", "bureau_balance_dpd_1plus_rate"
        ),
        "pos_cash_recent_dpd_rate_delta": _difference(
            "pos_cash_recent_dpd_month_rate", "pos_cash_dpd_month_rate"
        ),
        "credit_card_recent_dpd_rate_delta": _difference(
            "credit_card_recent_dpd_month_rate", "credit_card_dpd_month_rate"
        ),
    }


def _last_k() -> dict:
    return {
        "pos_cash_last_3_dpd_rate_delta": _difference(
            "pos_cash_last_3_dpd_rate", "pos_cash_dpd_month_rate"
        ),
        "credit_card_last_3_utilization_delta": _difference(
            "credit_card_last_3_credit_utilization", "credit_card_avg_credit_utilization"
        ),
    }


def _project(frame: DataFrame, lead: list[str], names, derived: Mapping) -> DataFrame:
    return frame.select(*lead, *[derived.get(n, F.col(n)).alias(n) for n in names])


def _digest(build: Callable[[FeatureTables], DataFrame]) -> cached_property:
    """A member that a stored copy may stand in for."""

    @wraps(build)
    def member(self: FeatureTables) -> DataFrame:
        name = build.__name__
        return self.given[name] if name in self.given else build(self)

    return cached_property(member)


_V1_DIGESTS = ("applicants", "bureau", "previous", "installments")
_LATER_DIGESTS = ("balance", "pos", "cards", "last_installments", "last_pos", "last_cards")


@dataclass(frozen=True)
class FeatureTables:
    """All feature tables over one set of staging frames, each built on first use.

    Nothing is computed here: the members are plans, and a mart built from several of them
    is one plan in which Spark prunes and shares what it can.
    """

    staging: Mapping[str, DataFrame]
    given: Mapping[str, DataFrame] = field(default_factory=dict)

    def keep(
        self, save: Callable[[str, DataFrame], DataFrame], post_v1: bool = True
    ) -> FeatureTables:
        """The same tables over saved digests.

        For jobs that write several tables: every source is then read once (twice where the
        latest rows are ranked), and the tables are joins of applicant-grain copies.
        """
        names = _V1_DIGESTS + (_LATER_DIGESTS if post_v1 else ())
        return FeatureTables(self.staging, {n: save(n, getattr(self, n)) for n in names})

    def source(self, name: str) -> DataFrame:
        try:
            return self.staging[staging_name(name)]
        except KeyError:
            raise ValueError(f"Missing staging table: {staging_name(name)}") from None

    @_digest
    def applicants(self) -> DataFrame:
        return applicant_static(self.source("application_train"), self.source("application_test"))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return segment_diagnostics(
            self.source("application_train"), self.source("application_test")
        )

    @_digest
    def bureau(self) -> DataFrame:
        return h.bureau_digest(self.source("bureau"))

    @_digest
    def balance(self) -> DataFrame:
        return h.balance_digest(self.source("bureau_balance"), self.source("bureau"))

    @_digest
    def previous(self) -> DataFrame:
        return h.previous_digest(self.source("previous_application"))

    @_digest
    def pos(self) -> DataFrame:
        return h.pos_digest(self.source("pos_cash_balance"))

    @_digest
    def cards(self) -> DataFrame:
        return h.card_digest(self.source("credit_card_balance"))

    @_digest
    def installments(self) -> DataFrame:
        return h.installment_digest(self.source("installments_payments"))

    @_digest
    def last_installments(self) -> DataFrame:
        return h.last_installments(self.source("installments_payments"))

    @_digest
    def last_pos(self) -> DataFrame:
        return h.last_pos_months(self.source("pos_cash_balance"))

    @_digest
    def last_cards(self) -> DataFrame:
        return h.last_card_months(self.source("credit_card_balance"))

    @cached_property
    def risk_pressure(self) -> DataFrame:
        joined = with_histories(self.applicants, self.bureau, self.installments)
        return _project(joined, KEY, PRESSURE_FEATURES, _pressure())

    @cached_property
    def recency(self) -> DataFrame:
        joined = with_histories(self.applicants.select(*KEY), self.balance, self.pos, self.cards)
        return _project(joined, KEY, RECENCY_FEATURES, _recency())

    @cached_property
    def last_k(self) -> DataFrame:
        joined = with_histories(
            self.applicants.select(*KEY),
            self.last_installments,
            self.last_pos,
            self.pos,
            self.last_cards,
            self.cards,
        )
        return _project(joined, KEY, LAST_K_FEATURES, _last_k())

    @cached_property
    def mart_v1(self) -> DataFrame:
        joined = with_histories(self.applicants, self.bureau, self.previous, self.installments)
        return joined.select(*KEY, "TARGET", *V1_FEATURES)

    @cached_property
    def mart_post_v1(self) -> DataFrame:
        """168 features. The derived families are expressions over the same joined row."""
        joined = with_histories(
            self.applicants,
            self.bureau,
            self.balance,
            self.pos,
            self.cards,
            self.previous,
            self.installments,
            self.last_installments,
            self.last_pos,
            self.last_cards,
        )
        derived = {**_pressure(), **_recency(), **_last_k()}
        return _project(joined, [*KEY, "TARGET"], POST_V1_FEATURES, derived)

    def mart(self, post_v1: bool = True) -> DataFrame:
        return self.mart_post_v1 if post_v1 else self.mart_v1

    def named(self, post_v1: bool = True) -> dict[str, DataFrame]:
        """Feature tables by name, in build order."""
        tables = {
            "f_applicant_static": self.applicants,
            "segment_diagnostics": self.diagnostics,
            "f_bureau_agg": self.bureau,
        }
        if post_v1:
            tables |= {
                "f_bureau_balance_agg": self.balance.select(h.APPLICANT, *h.BALANCE_FEATURES),
                "f_pos_cash_agg": self.pos.select(h.APPLICANT, *h.POS_FEATURES),
                "f_credit_card_agg": self.cards.select(h.APPLICANT, *h.CARD_FEATURES),
            }
        tables |= {
            "f_previous_application_agg": self.previous,
            "f_installments_agg": self.installments,
        }
        if post_v1:
            tables |= {
                "f_risk_pressure_features": self.risk_pressure,
                "f_recency_deterioration_features": self.recency,
                "f_last_k_temporal_features": self.last_k,
            }
        return tables | {"mart_credit_risk_features": self.mart(post_v1)}

