import numpy as np
import pytest
from pyspark.sql import functions as F

from creditweave.operators import calibration as cal
from creditweave.operators import encoding, models, reasons
from creditweave.settings import Settings
from creditweave.sources.workspace import store
from tests.fixtures import synthetic_mart

FEATURES = ["credit_to_income_ratio", "bureau_credit_count", "optional_numeric_feature",
            "payment_amount_ratio", "category_feature"]


@pytest.fixture(scope="module")
def train(spark):
    rows = synthetic_mart(spark).where("TARGET IS NOT NULL")
    # A signal, so that the fits are not all noise.
    return store(rows.withColumn("payment_amount_ratio",
                                 F.col("payment_amount_ratio") - F.col("TARGET") * F.lit(0.2)))


def test_encoder_statistics(spark, train):
    encoder = encoding.fit_encoder(train, FEATURES, scaled=False)
    assert encoder.numeric == tuple(FEATURES[:4]) and encoder.categorical == ("category_feature",)
    values = sorted(i / 10 for i in range(80) if i % 6)
    assert encoder.fills["optional_numeric_feature"] == pytest.approx(np.median(values))
    assert encoder.vocabulary["category_feature"] == ["high", "low", "medium"]
    assert encoder.modes["category_feature"] == "low"  # 27 low, 27 medium, 26 high
    assert encoder.labels(spark)[-1] == "Category feature: Medium"


def test_unseen_category_encodes_to_zeros(spark, train):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    encoder = encoding.fit_encoder(train, FEATURES, scaled=False)
    rows = train.frame.limit(1).withColumn("category_feature", F.lit("new"))
    vector = PipelineModel(encoder.stages(spark)).transform(rows).select(
        vector_to_array("features").alias("v")).first()["v"]
    assert len(vector) == 7 and vector[4:] == [0.0, 0.0, 0.0]


def test_all_missing_column_is_kept(spark):
    rows = store(spark.createDataFrame([(1.0, None, "a", None), (3.0, None, "b", None)],
                                       "x double, gone double, c string, empty string"))
    encoder = encoding.fit_encoder(rows, ["x", "gone", "c", "empty"], scaled=True)
    assert encoder.fills == {"x": 2.0, "gone": 0.0} and encoder.scales["gone"] == (0.0, 1.0)
    assert encoder.modes == {"c": "a", "empty": "missing"}
    # Vocabularies of different length: 2 numbers, 2 + 1 categories.
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    found = PipelineModel(encoder.stages(spark)).transform(rows.frame)
    assert sorted(r[0] for r in found.select(vector_to_array("features")).collect()) == [
        [-1.0, 0.0, 1.0, 0.0, 1.0], [1.0, 0.0, 0.0, 1.0, 1.0]]


def test_logistic_optimum_and_contributions(spark, train):
    model = models.fit_logistic(train, FEATURES)
    rows = train.frame.select("SK_ID_CURR", "TARGET", *FEATURES)
    from pyspark.ml.functions import vector_to_array

    encoded = model.encoded(rows).select("TARGET", vector_to_array("features").alias("v")).collect()
    x, y = np.array([r["v"] for r in encoded]), np.array([r["TARGET"] for r in encoded])
    beta, b0 = np.array(model.classifier.coefficients), model.classifier.intercept
    p = 1 / (1 + np.exp(-(x @ beta + b0)))
    # At the optimum of sum(w * loss) + |beta|^2 / 2 the gradient vanishes (balanced: w = 1).
    assert np.abs(x.T @ (p - y) + beta).max() < 1e-3
    assert abs((p - y).sum()) < 1e-3
    found = models.logistic_contributions(model, rows, rows, ["SK_ID_CURR"])
    parts = np.array([r["contributions"] for r in found.collect()])
    margins = x @ beta + b0
    assert parts.sum(1) + margins.mean() == pytest.approx(margins)


def test_logistic_fit_needs_few_passes(spark):
    # Two columns that nearly agree: gradient steps take hundreds of passes and stop short.
    rows = spark.range(4000).selectExpr(
        "id AS SK_ID_CURR", "CAST(crc32(CAST(id AS STRING)) % 5 = id % 2 AS INT) AS TARGET",
        "CAST(id % 97 AS DOUBLE) AS a", "id % 97 + 0.01 * (id % 13) AS b", "pow(id % 89, 6) AS c",
        "CASE WHEN id % 50 = 0 THEN 'x' ELSE 'y' END AS d")
    rows, names, context = store(rows), ["a", "b", "c", "d"], spark.sparkContext
    encoder = encoding.fit_encoder(rows, names, scaled=False)
    context.setJobGroup("logistic", "logistic")
    model = models.fit_logistic(rows, names, encoder=encoder)
    jobs = context.statusTracker().getJobIdsForGroup("logistic")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 60
    assert model.encoder == encoding.fit_encoder(rows, names, scaled=True)
    from pyspark.ml.functions import vector_to_array

    found = model.encoded(rows.frame).select("TARGET", vector_to_array("features").alias("v")).collect()
    x, y = np.array([r["v"] for r in found]), np.array([r["TARGET"] for r in found])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = np.array(model.classifier.coefficients)
    errors = w * (1 / (1 + np.exp(-(x @ beta + model.classifier.intercept))) - y)
    assert np.abs(x.T @ errors + beta).max() / len(y) < 1e-9 and abs(errors.mean()) < 1e-9


def test_wide_logistic_fit_agrees(train, monkeypatch):
    narrow = models.fit_logistic(train, FEATURES)
    monkeypatch.setattr(models, "MOST_CURVED", 0)
    wide = models.fit_logistic(train, FEATURES)
    assert np.array(narrow.classifier.coefficients) == pytest.approx(np.array(wide.classifier.coefficients), abs=1e-4)
    assert narrow.classifier.intercept == pytest.approx(wide.classifier.intercept, abs=1e-4)


def test_tree_rows_are_dealt_evenly(spark, train):
    # One large and some small files, as a join leaves them.
    skewed = store(train.frame.repartitionByRange(4, F.col("SK_ID_CURR") < 70, "SK_ID_CURR"))
    encoded, _, _ = models.encode_training(skewed, FEATURES)
    sizes = [r[1] for r in encoded.frame.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) <= min(sizes) + 4


@pytest.fixture(scope="module")
def trees(train):
    encoded, encoder, stages = models.encode_training(train, FEATURES)
    candidate = models.tree_candidates(1.0)[3]
    assert candidate.name == "shallow_calibrated" and models.tree_depth(candidate.params) == 3
    few = models.Candidate(candidate.name, candidate.source, candidate.params | {"n_estimators": 4})
    return models.fit_trees(encoded.frame, encoder, few, 7, stages)


def brute_shapley(tree, weight, row, width):
    """Shapley values from the definition, over all subsets of the tree's features."""
    from itertools import combinations
    from math import factorial

    def expected(node, known):
        if node.subtreeDepth() == 0:
            return node.prediction()
        split, left, right = node.split(), node.leftChild(), node.rightChild()
        feature = split.featureIndex()
        if feature in known:
            if split.getClass().getSimpleName() == "ContinuousSplit":
                go_left = row[feature] <= split.threshold()
            else:
                go_left = row[feature] in list(split.leftCategories())
            return expected(left if go_left else right, known)
        n, m = left.impurityStats().count(), right.impurityStats().count()
        return (expected(left, known) * n + expected(right, known) * m) / (n + m)

    def used(node):
        if node.subtreeDepth() == 0:
            return set()
        return {node.split().featureIndex()} | used(node.leftChild()) | used(node.rightChild())

    root = tree._call_java("rootNode")
    names, out = sorted(used(root)), np.zeros(width)
    for f in names:
        rest = [g for g in names if g != f]
        for k in range(len(rest) + 1):
            for s in combinations(rest, k):
                w = factorial(k) * factorial(len(names) - k - 1) / factorial(len(names))
                out[f] += w * weight * (expected(root, {*s, f}) - expected(root, set(s)))
    return out


def test_tree_contributions_are_shapley_values(train, trees):
    from pyspark.ml.functions import vector_to_array

    rows = train.frame.select("SK_ID_CURR", *FEATURES)
    found = {r["SK_ID_CURR"]: np.array(r["contributions"])
             for r in models.tree_contributions(trees, rows, ["SK_ID_CURR"]).collect()}
    gbt, width = trees.classifier, len(trees.encoder.positions())
    vectors = trees.encoded(rows).select("SK_ID_CURR", vector_to_array("features").alias("v"))
    for row in vectors.limit(6).collect():
        expected = sum(brute_shapley(t, 2 * w, row["v"], width)
                       for t, w in zip(gbt.trees, gbt.treeWeights))
        assert found[row["SK_ID_CURR"]] == pytest.approx(expected)
    # The sum differs from the log-odds by a constant.
    scored = trees.with_probability(rows).select("SK_ID_CURR", "probability").collect()
    gaps = [np.log(r[1] / (1 - r[1])) - found[r[0]].sum() for r in scored]
    assert max(gaps) - min(gaps) < 1e-9


def test_candidate_prefix_and_weights():
    full = models.tree_candidates(2.0, Settings())
    assert [c.name for c in full][:2] == ["baseline_current", "regularized_low_learning_rate"]
    assert len(full) == 8 and full[4].params["scale_pos_weight"] == pytest.approx(2.7)
    assert full[0].params["n_estimators"] == 300 and full[0].params["max_depth"] is None
    assert len(models.tree_candidates(1.0, Settings(max_candidates=3))) == 3
    assert len(models.tree_candidates(1.0, Settings(tuning_enabled=False))) == 1
    with pytest.raises(models.ModelError):
        models.tree_candidates(1.0, Settings(max_candidates=0))


SCORES = "SK_ID_CURR long, target int, probability double"


def test_sigmoid_keeps_ranks_and_isotonic_is_monotone(spark):
    rows = spark.createDataFrame(
        [(i, int((i * 37) % 100 < i), (i + 1) / 102) for i in range(100)], SCORES)
    fitted = cal.fit_calibrators(rows)
    x = np.log([(i + 1) / (101 - i) for i in range(100)])
    y = np.array([int((i * 37) % 100 < i) for i in range(100)])
    p = 1 / (1 + np.exp(-(fitted.intercept + fitted.slope * x)))
    assert abs((x * (p - y)).sum() + fitted.slope) < 1e-3 and abs((p - y).sum()) < 1e-3
    for method in cal.METHODS:
        got = [r["calibrated"] for r in
               cal.apply_method(rows, method, fitted).orderBy("probability").collect()]
        assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1
    outside = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0)], SCORES)
    assert cal.apply_method(outside, cal.ISOTONIC, fitted).count() == 2


@pytest.mark.parametrize("brier, expected", [
    ((0.175, 0.0665, 0.0663), "sigmoid"), ((0.175, 0.0700, 0.0663), "isotonic"),
    ((0.0666, 0.0665, 0.0663), "uncalibrated")])
def test_calibration_choice(brier, expected):
    assert cal.choose_method(dict(zip(cal.METHODS, brier))) == expected


def test_calibration_choice_needs_all_methods():
    with pytest.raises(cal.CalibrationError, match="isotonic"):
        cal.choose_method({"uncalibrated": 0.1, "sigmoid": 0.1})


def test_reasons_are_positive_distinct_and_padded(spark):
    rows = spark.createDataFrame(
        [(1, [0.1, 0.5, 0.4, 0.2]), (2, [-1.0, 0.0, 0.3, -0.1]), (3, [-1.0] * 4)],
        "applicant_id long, contributions array<double>")
    got = {r[0]: list(r[1:]) for r in reasons.top_reasons(rows, ["A", "B", "B", "C"]).collect()}
    assert got[1] == ["Higher risk: B", "Higher risk: C", "Higher risk: A"]
    assert got[2] == ["Higher risk: B", None, None] and got[3] == [None] * 3
    table = reasons.feature_importance(rows, ["A", "B", "B", "C"], "m").orderBy("rank").collect()
    assert [(r["feature_name"], r["rank"]) for r in table] == [("B", 1), ("A", 2), ("C", 3)]


def test_too_many_categories_are_an_error(spark, monkeypatch):
    from creditweave.operators import encoding

    rows = spark.range(30).selectExpr("concat('c', id % 7) as text", "cast(id as double) as number")
    kept = store(rows)
    assert encoding.fit_encoder(kept, ["text", "number"], False).vocabulary["text"] == [f"c{i}" for i in range(7)]
    monkeypatch.setattr(encoding, "MOST_CATEGORIES", 6)
    with pytest.raises(ValueError, match="text has 7 categories"):
        encoding.fit_encoder(kept, ["text", "number"], False)
