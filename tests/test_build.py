"""Ingestion, feature build, splits, contracts and inventories."""

import re

import pytest
from pyspark.sql import functions as F

from creditweave.functions.labels import feature_label, forbidden_text
from creditweave.operators import contracts, inventory, splits
from creditweave.plans.build import BuildError, build_features
from creditweave.plans.mart import FeatureTables
from creditweave.schemas import REPORTS, SOURCES
from creditweave.settings import Settings
from creditweave.sources import reports, staging as st
from creditweave.sources.workspace import store
from tests.fixtures import ROWS


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    paths = {}
    for name, rows in ROWS.items():
        paths[name] = str(folder / f"{name}.csv")
        spark.createDataFrame(rows, SOURCES[name]).coalesce(1).write.option("header", True).csv(paths[name])
    return paths


def test_ingestion_reconciles_and_repeats(spark, files, tmp_path):
    for _ in range(2):
        frames, summary = st.ingest(spark, files, str(tmp_path / "parquet"))
        rows = {r["source_name"]: r for r in summary.collect()}
        assert summary.columns == list(REPORTS["ingestion_summary"])
        for name, source in ROWS.items():
            r = rows[name]
            assert r["csv_rows"] == r["parquet_rows"] == r["staged_rows"] == len(source)
    assert "TARGET" in frames["stg_application_train"].columns
    assert "TARGET" not in frames["stg_application_test"].columns
    assert spark.table("stg_bureau").count() == 3
    again = st.load_staging(spark, str(tmp_path / "parquet"))
    assert FeatureTables(again).mart_v1.count() == 3


def test_missing_files_are_listed_before_any_output(spark, files, tmp_path):
    broken = {**files, "bureau": "/none/a.csv", "bureau_balance": "/none/b.csv"}
    with pytest.raises(st.SourceError, match="bureau .*bureau_balance"):
        st.ingest(spark, broken, str(tmp_path / "parquet"))
    assert not (tmp_path / "parquet").exists()


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    path = str(tmp_path / "b.csv")
    spark.createDataFrame([("x", "0", -1, 7)], "extra string, STATUS string, MONTHS_BALANCE int, SK_ID_BUREAU int"
                          ).write.option("header", True).csv(path)
    row = st.read_csv(spark, path, SOURCES["bureau_balance"]).first()
    assert row.asDict() == {"SK_ID_BUREAU": 7, "MONTHS_BALANCE": -1, "STATUS": "0"}
    with pytest.raises(st.SourceError, match="missing columns"):
        st.read_csv(spark, path, SOURCES["bureau"])


@pytest.fixture(scope="module")
def build(staging, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("features"))
    return build_features(staging, folder, folder + "/reports")


def test_build_reports(spark, build):
    assert build.mart.count() == 3
    assert build.data_inventory.count() == 17
    profile = {r["table_name"]: r for r in build.profile.collect()}
    assert len(profile) == 12
    assert profile["mart_credit_risk_features"]["column_count"] == 171
    assert profile["mart_credit_risk_features"]["duplicate_key_count"] == 0
    tables = {r["table_name"]: r for r in build.data_inventory.collect()}
    assert tables["stg_installments_payments"]["duplicate_grain_key_count"] == 1
    assert tables["mart_credit_risk_features"]["target_null_count"] == 1
    assert tables["stg_bureau_balance"]["distinct_applicant_count"] is None
    columns = {(r["table_name"], r["column_name"]): r for r in build.feature_inventory.collect()}
    ratio = columns["mart_credit_risk_features", "credit_to_income_ratio"]
    assert ratio["missing_count"] == 1 and ratio["is_model_feature"]
    assert columns["segment_diagnostics", "CODE_GENDER"]["exclusion_group"].startswith("sensitive")
    assert columns["mart_credit_risk_features", "TARGET"]["exclusion_group"] == "target"
    assert len(contracts.model_features(build.mart)) == 168


def test_build_needs_all_staging(staging, tmp_path):
    with pytest.raises(BuildError, match="stg_bureau"):
        build_features({k: v for k, v in staging.items() if k != "stg_bureau"}, str(tmp_path))


def test_violations_are_collected(build):
    mart = build.mart
    broken = mart.unionByName(mart.where("SK_ID_CURR = 100001")).withColumn(
        "TARGET", F.when(F.col("SK_ID_CURR") == 200001, 1).otherwise(F.lit(None).cast("long")))
    tables = {**build.tables, contracts.MART: store(broken).frame}
    with pytest.raises(contracts.ContractError) as error:
        contracts.require_contracts(tables)
    for part in ("duplicate grain keys", "train TARGET is null", "test TARGET is not null",
                 "staging=2, mart=3"):
        assert part in str(error.value)
    with pytest.raises(contracts.ContractError, match="f_pos_cash_agg"):
        contracts.require_contracts({k: v for k, v in tables.items() if k != "f_pos_cash_agg"})
    strange = mart.withColumn("source_population", F.lit("other"))
    found = {r["check"] for r in contracts.mart_violations(strange, Settings()).collect()}
    assert "unexpected source_population" in found
    assert contracts.mart_violations(mart.limit(0), Settings()).first()["check"] == "mart is empty"


def test_profile_counts_applicants_outside_the_key(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 11)], "SK_ID_CURR long, SK_ID_PREV long")
    row = inventory.profile("t", rows, ["SK_ID_PREV"]).first()
    assert (row["row_count"], row["distinct_applicant_count"], row["duplicate_key_count"]) == (3, 2, 1)


def test_column_counts(spark):
    rows = spark.createDataFrame([(0.0, "a"), (-0.0, None), (None, "")], "x double, s string")
    got = {r["column_name"]: (r["row_count"], r["missing_count"], r["distinct_value_count"])
           for r in inventory.column_counts(rows).collect()}
    assert got == {"x": (3, 1, 1), "s": (3, 1, 2)}


def test_stratified_split(spark):
    rows = spark.range(40).select(F.col("id").alias("SK_ID_CURR"), (F.col("id") % 2).alias("TARGET"))
    got = splits.stratified_split(rows).collect()
    count = {}
    for r in got:
        count[r["split"], r["TARGET"]] = count.get((r["split"], r["TARGET"]), 0) + 1
    assert count == {("train", 0): 14, ("train", 1): 14, ("validation", 0): 3,
                     ("validation", 1): 3, ("test", 0): 3, ("test", 1): 3}
    assert len({r["SK_ID_CURR"] for r in got}) == 40
    same = splits.stratified_split(rows.repartition(7)).collect()
    assert sorted(same) == sorted(got)
    other = splits.stratified_split(rows, Settings(seed=1)).collect()
    assert sorted(other) != sorted(got)


def test_split_quotas_need_both_classes():
    with pytest.raises(splits.SplitError):
        splits.split_quotas({0: 10}, Settings())
    with pytest.raises(splits.SplitError):
        splits.split_quotas({0: 10, 1: 1}, Settings())
    quotas = splits.split_quotas({0: 91, 1: 9}, Settings())
    assert sum(a + b for a, b in quotas.values()) == 30


def test_split_rows_must_reconcile(spark):
    saved = spark.createDataFrame([(1, "test"), (2, "test"), (3, "test")], "SK_ID_CURR long, split string")
    rows = spark.createDataFrame([(1, 0, "test"), (2, 0, "test")], "SK_ID_CURR long, TARGET int, split string")
    with pytest.raises(splits.SplitError, match=r"missing from the mart \(1\).*\[3\]"):
        splits.require_split_rows(rows, saved)


def test_labels(spark):
    rows = spark.createDataFrame(
        [("bureau_credit_count", None), ("NAME_INCOME_TYPE", "State__servant"), ("_", None)],
        "f string, c string")
    got = [r[0] for r in rows.select(feature_label("f", "c")).collect()]
    assert got == ["Bureau credit count", "Name income type: State servant", "Unknown feature"]
    texts = spark.createDataFrame([("Higher risk: Code  gender",), ("Fine",)], "t string")
    assert forbidden_text(texts, ["t"], ["CODE_GENDER", "TARGET"]).first()["term"] == "code gender"


def test_report_csv_header_is_enforced(spark, tmp_path):
    from pyspark.sql import types as T

    rows = spark.createDataFrame([("full", 1, "x")], "feature_set string, feature_rank int, feature_name string")
    assert reports.write_csv(rows, "selected_features", str(tmp_path / "s")) == 1
    assert reports.read_csv_report(spark, str(tmp_path / "s"), rows.schema).collect() == rows.collect()
    with pytest.raises(reports.ReportError):
        reports.read_csv_report(spark, str(tmp_path / "s"), T.StructType(rows.schema.fields[:2]))
    with pytest.raises(reports.ReportError, match="feature_rank"):
        reports.in_report_order(rows.drop("feature_rank"), "selected_features")


def test_same_splits(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "SK_ID_CURR long, split string")
    contracts.require_same_splits(one, one.repartition(3))
    with pytest.raises(contracts.ContractError):
        contracts.require_same_splits(one, one.where("SK_ID_CURR = 1"))
    with pytest.raises(contracts.ContractError):
        contracts.require_same_surface({"feature_columns": ["a"]}, {"feature_columns": ["b"]})


def test_every_violation_is_in_the_report_table(spark):
    found = spark.range(2500).selectExpr(
        "if(id % 2 = 0, 'odd grain', 'late row') as check", "concat('key ', id) as detail", "id as n"
    )
    with pytest.raises(contracts.ContractError, match="2500 violations") as error:
        contracts.raise_violations(found, "The rows are wrong")
    path = re.search(r"all in (\S+):", str(error.value))[1]
    assert spark.read.parquet(path).count() == 2500
    contracts.raise_violations(found.limit(0), "Nothing is wrong")


def test_missing_ids_are_the_smallest(spark):
    drawn = spark.range(40).selectExpr("id as SK_ID_CURR", "'train' as split", "id % 2 as TARGET")
    with pytest.raises(splits.SplitError, match=r"\[10, 11, 12, 13, 14, 15, 16, 17, 18, 19\]"):
        splits.require_split_rows(drawn.where("SK_ID_CURR < 10"), drawn)


def test_duplicate_keys_are_counted_in_bounded_tasks(spark, monkeypatch):
    from creditweave.operators import inventory

    monkeypatch.setattr(inventory, "KEYS_IN_TASK", 50, raising=False)
    rows = [(i, "a") for i in range(1000)] + [(7, "a"), (8, "b"), (None, "a"), (None, "a"), (None, None)]
    found = inventory.duplicate_keys(spark.createDataFrame(rows, "i int, k string").repartition(3), ["i", "k"])
    assert sorted(found.collect(), key=str) == sorted([(7, "a", 2), (None, "a", 2)], key=str)
    # As many tasks as the rows need, whatever the session's shuffle partitions are.
    assert found.rdd.getNumPartitions() == 21
