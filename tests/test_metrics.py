import random

import pytest
from pyspark.sql import functions as F

from creditweave.operators import metrics as m
from creditweave.operators.ordering import ranked
from creditweave.operators import quantiles
from creditweave.operators.quantiles import exact_quantiles
from creditweave.sources.workspace import store
from tests import brute

SCHEMA = "model_version string, split string, SK_ID_CURR long, target int, probability double"


def sample(n, digits, seed):
    rnd = random.Random(seed)
    return [(i * 7 % n, int(rnd.random() < 0.3), round(rnd.random(), digits)) for i in range(n)]


CASES = {
    "train": sample(403, 6, 1),
    "validation": sample(257, 1, 2),  # heavy ties
    "test": sample(7, 2, 3),  # fewer rows than bins
    "one_class": [(i, 0, i / 20) for i in range(20)],
    "constant": [(i, i % 2, 0.5) for i in range(50)],
}


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [("m", s, *r) for s, part in CASES.items() for r in part]
    return store(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_metric_bundle(predictions):
    got = {r["split"]: r for r in m.metric_bundle(
        m.riskiest_first(predictions), capacity=0.2).collect()}
    for split, rows in CASES.items():
        pairs = [(p, y) for _, y, p in rows]
        row, base = got[split], sum(y for _, y in pairs) / len(pairs)
        assert row["roc_auc"] == pytest.approx(brute.roc_auc(pairs), abs=1e-12)
        assert row["pr_auc"] == pytest.approx(brute.average_precision(pairs), abs=1e-12)
        assert row["brier_score"] == pytest.approx(sum((p - y) ** 2 for p, y in pairs) / len(pairs))
        chosen = brute.top(rows, 0.1)
        precision = sum(r[1] for r in chosen) / len(chosen)
        assert row["precision_at_top_decile"] == pytest.approx(precision)
        assert row["top_decile_lift"] == (pytest.approx(precision / base) if base else None)
        caught = sum(r[1] for r in brute.top(rows, 0.2))
        expected = caught / sum(y for _, y in pairs) if base else 0.0
        assert row["recall_at_manual_review_capacity"] == pytest.approx(expected)
        assert row["min_predicted_probability"] == min(p for p, _ in pairs)


@pytest.mark.parametrize("descending", [True, False])
def test_rank_bins(predictions, descending):
    rows = m.with_tenth(predictions, "b", descending).collect()
    assert len(rows) == sum(map(len, CASES.values()))
    for split, part in CASES.items():
        assert {r["SK_ID_CURR"]: r["b"] for r in rows if r["split"] == split} == brute.bins(
            part, descending
        )


def test_running_sums_do_not_depend_on_partitions(spark, predictions):
    def result():
        rows = ranked(predictions, ["split"], m.risk_order(), ["target"])
        return sorted(rows.collect())

    expected = sorted(ranked(predictions, ["split"], m.risk_order(), ["target"]).collect())
    for partitions in ("1", "3", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert result() == expected
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_lift_and_bins(predictions):
    lift = m.lift_by_decile(m.with_tenth(predictions, "decile", True)).collect()
    bins = m.calibration_bins(m.with_tenth(predictions, "bin_id", False))
    assert len(lift) == bins.count() == 10 * len(CASES)
    for split, part in CASES.items():
        deciles = sorted((r for r in lift if r["split"] == split), key=lambda r: r["decile"])
        assert sum(r["applicant_count"] for r in deciles) == len(part)
        if split != "one_class":
            assert deciles[-1]["cumulative_default_capture_rate"] == pytest.approx(1.0)
    empty = [r for r in lift if r["split"] == "test" and not r["applicant_count"]]
    assert len(empty) == 3 and all(r["average_score"] is None for r in empty)
    errors = {r["split"]: r for r in m.bin_errors(bins).collect()}
    rows = [r for r in bins.collect() if r["split"] == "train"]
    weighted = sum(abs(r["calibration_error"]) * r["applicant_count"] for r in rows) / 403
    assert errors["train"]["weighted_calibration_error"] == pytest.approx(weighted)


def test_curves(predictions):
    curve = m.score_curve(m.riskiest_first(predictions).where("split = 'validation'"))
    roc = m.roc_points(curve).orderBy(F.desc("threshold")).collect()
    assert len(roc) == 11
    assert (roc[-1]["false_positive_rate"], roc[-1]["true_positive_rate"]) == (1.0, 1.0)
    pr = m.pr_points(curve).orderBy("threshold").first()
    assert pr["recall"] == 1.0


def test_selection_rate_must_be_positive(predictions):
    for rate in (0, 1.5):
        with pytest.raises(ValueError):
            m.at_rate(m.riskiest_first(predictions), [rate])


@pytest.mark.parametrize("stop, known", [(3, False), (40, True), (10_000, False), (10_000, True)])
def test_exact_quantiles(spark, monkeypatch, stop, known):
    """Wherever the search stops, the result is the interpolated quantile."""
    monkeypatch.setattr(quantiles, "SORTED_VALUES", stop)
    rnd = random.Random(5)
    smooth = [rnd.gauss(0, 100) for _ in range(2000)]
    tied = [float(rnd.choice([1, 2, 2, 2, 5])) for _ in range(2000)]
    sparse = [v if i % 9 == 0 else None for i, v in enumerate(smooth)]
    rows = spark.createDataFrame(
        list(zip(smooth, tied, sparse, [None] * 2000)), "a double, b double, c double, d double"
    )
    qs = [0.0, 0.5, 0.7, 0.95, 1.0]
    rows = store(rows) if known else rows
    got = exact_quantiles(rows, ["a", "b", "c", "d"], qs)
    for name, values in (("a", smooth), ("b", tied), ("c", [v for v in sparse if v is not None])):
        assert got[name] == pytest.approx([brute.quantile(values, q) for q in qs])
    assert got["d"] == [None] * 5


def test_invalid_probabilities(spark):
    rows = spark.createDataFrame([(0.5,), (None,), (1.1,), (float("nan"),)], "probability double")
    assert m.invalid_probabilities(rows).count() == 3


def test_null_groups_keep_their_rows(spark):
    rows = [(None if i % 4 == 0 else f"g{i % 3}", i, i % 2, (i * 7 % 20) / 20) for i in range(60)]
    frame = spark.createDataFrame(rows, "g string, SK_ID_CURR long, target int, probability double")
    got = ranked(frame.repartition(5), ["g"], m.risk_order(), ["target"]).collect()
    assert len(got) == 60
    for group in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[3], r[1]))
        placed = {r["SK_ID_CURR"]: r for r in got if r["g"] == group}
        for rank, row in enumerate(mine, 1):
            found = placed[row[1]]
            assert (found["rank"], found["group_rows"]) == (rank, len(mine))
            assert found["running_target"] == sum(r[2] for r in mine[:rank])


def test_no_window_holds_a_whole_group(spark):
    frame = spark.range(4000).selectExpr(
        "if(id % 10 = 0, 'cold', 'hot') as g", "id as SK_ID_CURR", "1 as target", "(id % 97) / 97D as probability"
    )
    got = ranked(frame, ["g"], m.risk_order(), ["target"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("_part" in line for line in windows)
    assert got.where("g = 'hot'").agg(F.max("rank")).first()[0] == 3600


def test_curve_of_distinct_scores_equals_that_of_the_ranking(spark, predictions):
    rows = getattr(predictions, "frame", predictions)
    rows = rows.unionByName(rows.withColumn("probability", F.lit(0.5)))
    want = m.score_curve(m.riskiest_first(rows))
    got = m.distinct_scores(rows).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_quantiles_of_not_a_number(spark, monkeypatch):
    """NaN is the largest value; sketches pass over it."""
    monkeypatch.setattr(quantiles, "SORTED_VALUES", 2)
    rows = spark.createDataFrame([(float(i),) for i in range(20)] + [(float("nan"),)] * 30, "a double")
    got = exact_quantiles(rows, ["a"], [0.0, 0.2, 0.9])["a"]
    assert got[0] == 0.0 and got[1] == pytest.approx(9.8) and got[2] != got[2]


def test_no_task_sees_the_sketches_of_all_columns(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED_VALUES", 10)
    plans = []
    real = quantiles._pivots

    def seen(frame, searches):
        found = real(frame, searches)
        plans.append((len(searches), found))
        return found

    monkeypatch.setattr(quantiles, "_pivots", seen)
    rows = spark.range(5000).selectExpr("id * 1D AS a", "id * 2D AS b", "CAST(NULL AS DOUBLE) AS c").repartition(5)
    assert exact_quantiles(rows, ["a", "b", "c"], [0.5]) == {"a": [2499.5], "b": [4999.0], "c": [None]}
    # Both ranks of each column, each with two values of its own around it.
    assert plans and all(n == len(found) and all(low <= high for low, high in found) for n, found in plans)
