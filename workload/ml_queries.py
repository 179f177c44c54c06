"""Fitted models, encoders, ingestion and export on the given tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.functions.expressions import logit, sigmoid
from creditweave.operators import calibration as cal
from creditweave.operators import encoding, metrics, models, policy, reasons, scoring
from creditweave.operators.quantiles import exact_quantiles
from creditweave.operators.splits import stratified_split
from creditweave.plans.mart import V1_FEATURES
from creditweave.plans.training import predict, run_training
from creditweave.settings import TRAIN_POPULATION, Settings
from creditweave.sources.reports import export_dashboard
from creditweave.sources.staging import ingest
from creditweave.sources.workspace import Stored, new_path, store
from workload import model_queries as mq
from workload.oracle_features import V1, compose, round6
from workload.oracle_models import KINDS, named, segment_count_sql
from workload.queries import tables, tidy
from workload.staging import spark_staging

def split_mart(spark, sf_dir) -> tuple[Stored, Stored]:
    """(all labeled rows with their split, the training part) of the v1 mart."""
    mart = tables(spark, sf_dir).mart_v1.where(F.col("source_population") == TRAIN_POPULATION)
    labeled = store(mart.select("SK_ID_CURR", "TARGET", *V1_FEATURES), "labeled")
    drawn = stratified_split(labeled).select("SK_ID_CURR", "split")
    rows = store(labeled.frame.join(drawn, "SK_ID_CURR"), "split-rows")
    return rows, store(rows.frame.where("split = 'train'"), "train")


def logistic_model(spark, sf_dir):
    rows, train = split_mart(spark, sf_dir)
    return rows, models.fit_logistic(train, V1_FEATURES)


def trees_model(spark, sf_dir):
    rows, train = split_mart(spark, sf_dir)
    negatives, positives = models.class_sizes(train.frame)
    encoded, encoder, stages = models.encode_training(train, V1_FEATURES)
    candidate = models.tree_candidates(negatives / positives)[3]
    return rows, models.fit_trees(encoded.frame, encoder, candidate, 42, stages)


def _measured(rows: Stored, model: models.FittedModel, name: str) -> DataFrame:
    kept = store(predict(model, rows.frame, name), "predictions")
    return metrics.metric_rows(metrics.metric_bundle(metrics.riskiest_first(kept)), mq.NOW)


def logistic_fit(spark, sf_dir):
    return tidy(_measured(*logistic_model(spark, sf_dir), "logistic"))


def gbt_fit(spark, sf_dir):
    return tidy(_measured(*trees_model(spark, sf_dir), "trees"))


def tree_contributions(spark, sf_dir):
    """Importance of the tree model's features over all labeled applicants."""
    rows, model = trees_model(spark, sf_dir)
    found = models.tree_contributions(model, rows.frame, ["SK_ID_CURR"])
    kept = store(found, "contributions").frame
    return tidy(reasons.feature_importance(kept, model.encoder.labels(spark), "trees"))


def tree_additivity(spark, sf_dir):
    """Labeled applicants, and those whose contributions and base add up to the model's log-odds."""
    rows, model = trees_model(spark, sf_dir)
    paths = models.tree_paths(model, spark)
    found = models.tree_contributions(model, rows.frame, ["SK_ID_CURR"], paths)
    scored = model.with_probability(rows.frame).select("SK_ID_CURR", "probability")
    margin = F.lit(paths.base) + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    same = F.abs(margin - F.log(F.col("probability") / (1 - F.col("probability")))) < 1e-9
    return found.join(scored, "SK_ID_CURR").agg(
        F.count(F.lit(1)).alias("applicants"), F.count_if(same).alias("additive")
    )


def training_run(spark, sf_dir):
    """The whole training job on the v1 mart with the first candidate; metric rows."""
    mart = store(tables(spark, sf_dir).mart_v1, "mart").frame
    settings = Settings(data_scope="v1", max_candidates=1)
    done = run_training(mart, new_path(spark, "models"), settings, "run")
    return tidy(done.tables["model_metrics_summary"].drop("created_at"))


def isotonic_fit(spark, sf_dir):
    kept = mq.predictions(spark, sf_dir).frame.where(f"model_version = '{mq.FINE}'")
    fitted = cal.Calibrators(0.0, 1.0, cal.fit_isotonic(kept.where("split = 'validation'")))
    return tidy(cal.apply_method(kept.where("split <> 'train'"), cal.ISOTONIC, fitted))


def sigmoid_fit(spark, sf_dir):
    kept = mq.predictions(spark, sf_dir).frame.where(f"model_version = '{mq.FINE}'")
    fitted = cal.fit_sigmoid(kept.where("split = 'validation'"))
    return tidy(cal.apply_method(kept.where("split <> 'train'"), cal.SIGMOID, fitted))


def sigmoid_optimum(spark, sf_dir):
    """Whether the gradient vanishes at the fitted sigmoid, over all validation rows."""
    kept = mq.predictions(spark, sf_dir).frame.where(f"model_version = '{mq.FINE}' AND split = 'validation'")
    fitted = cal.fit_sigmoid(kept)
    x = logit("probability")
    error = sigmoid(F.lit(fitted.intercept) + F.lit(fitted.slope) * x) - F.col("target")
    slope = F.avg(error * x) + F.lit(fitted.slope) / F.count(F.lit(1))
    return kept.agg(
        F.count(F.lit(1)).alias("validation_rows"),
        ((F.abs(F.avg(error)) < 1e-5) & (F.abs(slope) < 1e-5)).alias("at_optimum"),
    )


def logistic_optimum(spark, sf_dir):
    """Whether every component of the gradient vanishes at the fitted baseline."""
    rows, model = logistic_model(spark, sf_dir)
    train = rows.frame.where("split = 'train'")
    negatives, positives = models.class_sizes(train)
    n = negatives + positives
    weight = F.when(F.col("TARGET") == 1, n / (2.0 * positives)).otherwise(n / (2.0 * negatives))
    values = vector_to_array(F.col(encoding.FEATURES))
    errors = model.encoded(model.with_probability(train)).select(
        (weight * (F.col("probability") - F.col("TARGET"))).alias("e"),
        F.posexplode(F.array_insert(values, 1, F.lit(1.0))).alias("place", "x"),
    )
    # The intercept, at place 0, has no penalty.
    beta = F.array(F.lit(0.0), *[F.lit(float(c)) for c in model.classifier.coefficients])
    slopes = errors.groupBy("place").agg((F.sum(F.col("e") * F.col("x")) / n).alias("mean"))
    slopes = slopes.select(F.abs(F.col("mean") + F.element_at(beta, F.col("place") + 1) / n).alias("size"))
    return slopes.agg(
        F.lit(n).cast("long").alias("train_rows"), (F.max("size") < 1e-4).alias("at_optimum")
    )


def median_mode_impute(spark, sf_dir):
    """The fill value of every v1 feature over all applicants."""
    mart = store(tables(spark, sf_dir).mart_v1.select(*V1_FEATURES), "mart")
    numeric, categorical = encoding.column_kinds(mart.frame, V1_FEATURES)
    medians = exact_quantiles(mart, numeric, [0.5])
    rows = [(c, medians[c][0]) for c in numeric]
    found = spark.createDataFrame(rows, "column_name string, median double")
    modes = encoding.modes(encoding.category_counts(mart.frame, categorical))
    return tidy(found.unionByName(modes, allowMissingColumns=True))


HOT = ("NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE")
UNSEEN = "Pensioner"


def one_hot_unknown(spark, sf_dir):
    """Encode all applicants with a vocabulary that has never seen one income type."""
    mart = store(tables(spark, sf_dir).mart_v1.select("SK_ID_CURR", *HOT), "mart")
    known = store(mart.frame.where(f"NAME_INCOME_TYPE <> '{UNSEEN}'"), "known")
    encoder = encoding.fit_encoder(known, HOT, scaled=False)
    vectors = PipelineModel(encoder.stages(spark)).transform(mart.frame)
    values = vectors.select("SK_ID_CURR", vector_to_array(encoding.FEATURES).alias("v"))
    names = [f"{c}_{v}".replace(" ", "_").replace("/", "_") for c, v in encoder.positions()]
    return values.select(
        "SK_ID_CURR", *[F.col("v")[i].cast("int").alias(n) for i, n in enumerate(names)]
    )


def scored_features(spark, sf_dir):
    scores = mq.score_table(spark, sf_dir).frame
    joined = scoring.scored_features(scores, tables(spark, sf_dir).mart_v1, mq.FINE, list(mq.DRIVERS))
    return tidy(joined)


def ingest_roundtrip(spark, sf_dir):
    """All sources written as CSV, ingested, and reconciled."""
    files = {}
    for name, frame in spark_staging(spark, sf_dir).items():
        source = name.removeprefix("stg_")
        files[source] = new_path(spark, source)
        frame.write.option("header", True).csv(files[source])
    _, summary = ingest(spark, files, new_path(spark, "parquet"), created_at=mq.NOW)
    return summary.select("source_name", "staging_table", "csv_rows", "parquet_rows", "staged_rows")


def dashboard_export(spark, sf_dir):
    """The eight dashboard tables of the closed-form score, written as CSV; rows per table."""
    given = mq.base(spark, sf_dir)
    kept = mq.predictions(spark, sf_dir, given)
    reported = store(kept.frame.where("split <> 'train'"), "reported")
    pairs = mq.thresholds(kept)
    scores, rows, labels = mq.contributions(spark, sf_dir, given)
    bundle = {
        "credit_risk_scores": reasons.merge_reasons(scores, reasons.top_reasons(rows, labels)),
        "model_metrics_summary": metrics.metric_rows(
            metrics.metric_bundle(metrics.riskiest_first(kept)), mq.NOW
        ),
        "model_threshold_metrics": policy.threshold_metrics(reported.frame, pairs, "threshold_v1", mq.NOW),
        "model_lift_by_decile": metrics.lift_by_decile(metrics.with_tenth(reported, "decile", True)),
        "model_calibration_bins": mq.bins(reported),
        "model_confusion_matrix": policy.confusion_matrix(reported.frame, pairs),
        "model_feature_importance": reasons.feature_importance(rows, labels, mq.FINE),
        "segment_performance_summary": mq.segment_query(spark, sf_dir, given),
    }
    counts = export_dashboard(bundle, new_path(spark, "dashboard"), relabel=(mq.FINE, "dashboard"))
    return spark.createDataFrame(sorted(counts.items()), "table_name string, row_count long")


def ml_queries() -> dict:
    return {
        "logistic_fit": logistic_fit,
        "gbt_fit": gbt_fit,
        "tree_contributions": tree_contributions,
        "tree_additivity": tree_additivity,
        "training_run": training_run,
        "isotonic_fit": isotonic_fit,
        "sigmoid_fit": sigmoid_fit,
        "sigmoid_optimum": sigmoid_optimum,
        "logistic_optimum": logistic_optimum,
        "median_mode_impute": median_mode_impute,
        "one_hot_unknown": one_hot_unknown,
        "scored_features": scored_features,
        "ingest_roundtrip": ingest_roundtrip,
        "dashboard_export": dashboard_export,
    }


# The monotone fit at a score is the largest, over starts at or below it, of the smallest mean
# of a run of scores from that start to an end at or above it.
_ISOTONIC = f"""SELECT p.* REPLACE ({round6("p.probability")} AS probability), {round6("""CASE WHEN low.x IS NULL THEN high.y WHEN high.x IS NULL OR low.x = high.x THEN low.y
  ELSE low.y + (high.y - low.y) * (p.probability - low.x) / (high.x - low.x) END""")} AS calibrated
FROM (SELECT * FROM predictions WHERE model_version = '{mq.FINE}' AND split <> 'train') p
ASOF LEFT JOIN steps low ON p.probability >= low.x ASOF LEFT JOIN steps high ON p.probability <= high.x"""
_STEPS = {
    "validation_scores": f"""SELECT x, row_number() OVER (ORDER BY x) AS place, s, n,
  sum(s) OVER (ORDER BY x) AS upto_s, sum(n) OVER (ORDER BY x) AS upto_n
FROM (SELECT probability AS x, CAST(sum(target) AS DOUBLE) AS s, count(*) AS n FROM predictions
  WHERE model_version = '{mq.FINE}' AND split = 'validation' GROUP BY 1)""",
    "runs": """SELECT a.place AS start, b.place AS place, b.x,
  (b.upto_s - a.upto_s + a.s) / (b.upto_n - a.upto_n + a.n) AS mean
FROM validation_scores a JOIN validation_scores b ON a.place <= b.place""",
    "lowest": """SELECT start, x, min(mean) OVER (PARTITION BY start ORDER BY place DESC) AS low FROM runs""",
    "steps": """SELECT x, max(low) AS y FROM lowest GROUP BY x""",
}


def ml_oracles() -> dict[str, str]:
    texts = [c for c in V1 if KINDS.get(c) == "string"]
    fills = [
        f"SELECT '{c}' AS column_name, {round6(f'CAST(median({c}) AS DOUBLE)')} AS median, CAST(NULL AS VARCHAR) AS mode FROM mart_v1"
        for c in V1
        if c not in texts
    ] + [
        f"""SELECT '{c}', CAST(NULL AS DOUBLE), (SELECT {c} FROM mart_v1 WHERE {c} IS NOT NULL
  GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
        for c in texts
    ]
    categories = {
        "NAME_EDUCATION_TYPE": ("Higher education", "Incomplete higher", "Secondary / secondary special"),
        "NAME_INCOME_TYPE": ("Commercial associate", "State servant", "Working"),
    }
    hot = ", ".join(
        f"CAST({c} = '{v}' AS INTEGER) AS \"{(c + '_' + v).replace(' ', '_').replace('/', '_')}\""
        for c, values in categories.items()
        for v in values
    )
    sources = [f"stg_{s}" for s in (
        "application_train", "application_test", "bureau", "bureau_balance", "previous_application",
        "pos_cash_balance", "credit_card_balance", "installments_payments")]
    ingested = " UNION ALL ".join(
        f"SELECT '{s.removeprefix('stg_')}' AS source_name, '{s}' AS staging_table, (SELECT count(*) FROM {s}) AS csv_rows, "
        f"(SELECT count(*) FROM {s}) AS parquet_rows, (SELECT count(*) FROM {s}) AS staged_rows"
        for s in sources
    )
    exported = {
        "credit_risk_scores": "(SELECT count(*) FROM score_table)",
        "model_metrics_summary": "CAST(48 AS BIGINT)",
        "model_threshold_metrics": "CAST(12 AS BIGINT)",
        "model_lift_by_decile": "CAST(40 AS BIGINT)",
        "model_calibration_bins": "CAST(40 AS BIGINT)",
        "model_confusion_matrix": "CAST(48 AS BIGINT)",
        "model_feature_importance": "(SELECT count(*) FROM (SELECT label FROM parts GROUP BY ALL HAVING avg(abs(v)) > 0))",
        "segment_performance_summary": segment_count_sql(),
    }
    return {
        "isotonic_fit": named(_ISOTONIC, _STEPS),
        "sigmoid_optimum": named(f"""SELECT count(*) AS validation_rows, TRUE AS at_optimum FROM predictions
WHERE model_version = '{mq.FINE}' AND split = 'validation'"""),
        "logistic_optimum": named(f"""SELECT count(*) AS train_rows, TRUE AS at_optimum FROM predictions
WHERE model_version = '{mq.FINE}' AND split = 'train'"""),
        "tree_additivity": compose("""SELECT count(*) AS applicants, count(*) AS additive
FROM mart_v1 WHERE source_population = 'application_train'"""),
        "median_mode_impute": compose(" UNION ALL ".join(fills)),
        "one_hot_unknown": compose(f"SELECT SK_ID_CURR, {hot} FROM mart_v1"),
        "scored_features": named(f"""SELECT t.applicant_id, t.scoring_population, t.model_version, t.threshold_version,
  {round6("t.score")} AS score, {round6("s.ext_source_mean")} AS ext_source_mean, {round6("s.credit_to_income_ratio")} AS credit_to_income_ratio,
  s.late_payment_count, s.installment_payment_count, s.active_credit_count
FROM score_table t JOIN scored s ON s.SK_ID_CURR = t.applicant_id"""),
        "ingest_roundtrip": compose(ingested),
        "dashboard_export": named(
            " UNION ALL ".join(f"SELECT '{t}' AS table_name, {n} AS row_count" for t, n in exported.items())
        ),
    }
