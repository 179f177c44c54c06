import pytest
from pyspark.sql import functions as F

from creditweave.operators import history
from creditweave.plans.mart import POST_V1_FEATURES, V1_FEATURES, FeatureTables
from tests.fixtures import GOLDEN


@pytest.fixture(scope="module")
def tables(staging):
    return FeatureTables(staging)


def test_golden_mart_row(tables):
    row = tables.mart_post_v1.where("SK_ID_CURR = 100001").first().asDict()
    for name, expected in GOLDEN.items():
        assert row[name] == pytest.approx(expected), name


def test_feature_counts():
    assert len(V1_FEATURES) == len(set(V1_FEATURES)) == 68
    assert len(POST_V1_FEATURES) == len(set(POST_V1_FEATURES)) == 168


def test_zero_income_gives_null_ratios(tables):
    row = tables.mart_post_v1.where("SK_ID_CURR = 100002").first()
    for name in ("credit_to_income_ratio", "annuity_to_income_ratio",
                 "goods_price_to_income_ratio", "bureau_debt_to_income_ratio"):
        assert row[name] is None
    assert row["employment_length_days"] is None
    assert row["ext_source_mean"] is None and row["ext_source_missing_count"] == 3
    assert row["bureau_credit_count"] is None


@pytest.mark.parametrize("post_v1", [True, False])
def test_populations_and_grain(tables, post_v1):
    rows = tables.mart(post_v1).select("SK_ID_CURR", "source_population", "TARGET").collect()
    assert len(rows) == len({(r[0], r[1]) for r in rows}) == 3
    assert {r[0]: r[2] for r in rows} == {100001: 0, 100002: 1, 200001: None}


def test_v1_scope_needs_no_later_sources(staging):
    from creditweave.schemas import V1_SOURCES, staging_name

    only = {staging_name(s): staging[staging_name(s)] for s in V1_SOURCES}
    assert FeatureTables(only).mart_v1.count() == 3
    with pytest.raises(ValueError, match="stg_bureau_balance"):
        FeatureTables(only).mart_post_v1


def test_derived_tables_equal_mart_columns(tables):
    mart = tables.mart_post_v1.orderBy("SK_ID_CURR").collect()
    for table in (tables.risk_pressure, tables.recency, tables.last_k):
        for ours, full in zip(table.orderBy("SK_ID_CURR").collect(), mart, strict=True):
            assert ours.asDict().items() <= full.asDict().items()


def test_diagnostics(tables):
    rows = {r["SK_ID_CURR"]: r for r in tables.diagnostics.collect()}
    assert rows[100001]["applicant_age_years"] == 32
    assert rows[100001]["applicant_age_band"] == "30_to_44"
    assert rows[200001]["applicant_age_band"] == "45_to_59"


def test_duplicate_bureau_record_counts_twice(staging):
    bureau = staging["stg_bureau"].where("SK_ID_BUREAU = 1")
    twice = history.balance_digest(staging["stg_bureau_balance"], bureau.union(bureau)).first()
    assert twice["bureau_balance_month_count"] == 6
    assert twice["bureau_balance_bureau_count"] == 1
    assert twice["bureau_balance_avg_numeric_status"] == pytest.approx(1.0)


def test_hot_applicant_is_reduced_before_the_shuffle(spark, staging):
    """Last-k limits groups on the map side, and the result is exact."""
    rows = spark.range(5000).select(
        F.expr("id % 1 + 7").alias("SK_ID_CURR"),
        (F.col("id") % 50).alias("SK_ID_PREV"),
        F.col("id").alias("NUM_INSTALMENT_NUMBER"),
        (-F.col("id") % 100).cast("double").alias("DAYS_INSTALMENT"),
        F.lit(0.0).alias("DAYS_ENTRY_PAYMENT"),
        F.lit(1.0).alias("AMT_INSTALMENT"),
        F.lit(1.0).alias("AMT_PAYMENT"),
    )
    latest = history.latest_rows(
        rows, ("DAYS_INSTALMENT", "SK_ID_PREV", "NUM_INSTALMENT_NUMBER"), 3
    )
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    got = [r["NUM_INSTALMENT_NUMBER"] for r in latest.orderBy("recency").collect()]
    assert got == [4900, 4800, 4700]


def test_means_of_quotients_do_not_depend_on_the_order_of_rows(spark):
    paid = [float(7919 * i % 10007 + 1) for i in range(60)]
    rows = [(1, p, 13.0) for p in paid] + [(2, p, 13.0) for p in reversed(paid)]
    rows += [(3, p, 13.0) for p in sorted(paid)] + [(4, None, 3.0), (5, 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "SK_ID_CURR long, AMT_PAYMENT double, AMT_INSTALMENT double").coalesce(1)
    payments = frame.withColumns({c: F.lit(0.0) for c in ("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT")})
    found = {r[0]: r["avg_payment_to_instalment_ratio"] for r in history.installment_digest(payments).collect()}
    assert found[1] == found[2] == found[3] == pytest.approx(sum(paid) / 780, rel=1e-14)
    assert found[4] is None and found[5] is None
    previous = frame.withColumnsRenamed({"AMT_PAYMENT": "AMT_CREDIT", "AMT_INSTALMENT": "AMT_APPLICATION"})
    previous = previous.withColumns({"NAME_CONTRACT_STATUS": F.lit("approved"), "DAYS_DECISION": F.lit(0)})
    found = {r[0]: r["avg_credit_to_application_ratio"] for r in history.previous_digest(previous).collect()}
    assert found[1] == found[2] == found[3]
