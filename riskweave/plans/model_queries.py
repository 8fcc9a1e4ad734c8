"""Queries on models: fitted on the supplied tables.

A fitted model has no SQL counterpart, its contract has: which rows are scored, that labels are known, that
probabilities and importances sum to one, that attributions add up.  Queries give the rows with those checks beside
them, and SQL gives the same rows from the tables.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.operators import attribution, evaluate, evidence, features, matrix, models, rules
from riskweave.plans.flows import materialise_vectors
from riskweave.plans.oracle import with_findings
from riskweave.plans.registry import query
from riskweave.session import materialise, scratch_dir, spread
from riskweave.sources.corpus import corpus_table, table

WIDTH = 64
NAMES = [f"feature_{i}" for i in range(WIDTH)]


def vectors(spark, folder):
    """``id, features, label, part`` from the embeddings, ten classes."""
    rows = spread(table(spark, folder, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label"
    )
    split = matrix.stratified_split(rows, seed=42).withColumn("features", array_to_vector("x")).drop("x")
    return materialise_vectors(split)


def code_vectors(spark, folder):
    """``id, features, label, part``: code features against the template's severity."""
    samples = corpus_table(spark, folder)
    rows = matrix.labelled(samples).withColumnRenamed("file_id", "id")
    split = matrix.stratified_split(rows, seed=42, test_size=0.3)
    assembled = matrix.assemble(matrix.fill_missing(split, features.ALL_FEATURES), features.ALL_FEATURES)
    return materialise_vectors(assembled.select("id", "features", "label", "part"))


def parts(rows):
    return rows.where("part = 'train'"), rows.where("part = 'test'")


def fit(rows, kind, config=None, names=NAMES):
    return models.VulnerabilityDetector(kind, config).fit(rows, names)


_TEST = """src AS (SELECT vec_id AS id, label FROM embeddings),
test AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) AS place,
  count(*) OVER (PARTITION BY label) AS size FROM src) WHERE place <= floor(0.2::DOUBLE * size))"""
_COUNTS = f"WITH {_TEST} SELECT count(*) AS n_rows, count(*) AS n_valid, true AS beats_majority FROM test"


def _beats_majority(scored):
    """Whether predictions on the rows fitted are right more often than the largest class alone would be.

    The supplied labels are independent of the vectors, so only what was fitted can tell a fitted model from a
    constant one.
    """
    # One row per label, a closed set.
    labels = scored.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("hits"))
    return labels.agg((F.sum("hits") > F.max("n")).alias("beats_majority"))


def _share(value):
    return value.between(0, 1)


def _importance(table):
    """Number of features, how many have a share of nought or more, and whether the shares sum to one."""
    value = F.col("importance")
    return table.agg(F.count("*").alias("n_features"), F.count_if(value >= 0).alias("n_valid"), (F.abs(F.sum(value) - 1.0) < 1e-6).alias("sums_to_one"))


_WIDTH = "SELECT max(len(embedding))::BIGINT AS n_features, max(len(embedding))::BIGINT AS n_valid, true AS sums_to_one FROM embeddings"


def _contract(scored, fitted):
    """Rows scored, and rows whose probabilities sum to one with a known label predicted."""
    total = F.aggregate("proba", F.lit(0.0), lambda t, p: t + p)
    valid = (F.abs(total - 1.0) < 1e-6) & F.col("prediction").between(0, 9) & (F.size("proba") == 10)
    counts = scored.agg(F.count("*").alias("n_rows"), F.count_if(valid).alias("n_valid"))
    return counts.join(_beats_majority(fitted))  # one row each


def _kind(name, kind, config=None):
    @query(name, _COUNTS)
    def _(spark, folder):
        train, test = parts(vectors(spark, folder))
        detector = fit(train, kind, config)
        return _contract(detector.transform(test), detector.transform(train))


@query("l01a_gradient_boosting", f"SELECT *, 100::BIGINT AS n_rounds, true AS loss_falls FROM ({_COUNTS})")
def _(spark, folder):
    """A hundred rounds of ten trees of depth six; the loss on the rows fitted falls with each round."""
    train, test = parts(vectors(spark, folder))
    detector = fit(train, "gradient_boosting")
    losses = detector.softmax.losses
    falls = all(after < before for before, after in zip(losses, losses[1:]))
    checks = _contract(detector.transform(test), detector.transform(train))
    return checks.withColumns({"n_rounds": F.lit(len(losses)).cast("long"), "loss_falls": F.lit(falls)})


_kind("l01b_random_forest", "random_forest")
_kind("l01c_logistic_regression", "logistic_regression")
_kind("l01d_neural_network", "neural_network")


@query("l02_predict", f"WITH {_TEST} SELECT id, label, true AS known FROM test")
def _(spark, folder):
    train, test = parts(vectors(spark, folder))
    return fit(train, "logistic_regression").predict(test).select("id", "label", F.col("prediction").between(0, 9).alias("known"))


@query("l02a_predict_on_findings", with_findings("SELECT file_id, finding_no, rule_id, true AS known, true AS confident FROM found"))
def _(spark, folder):
    samples = matrix.labelled(corpus_table(spark, folder)).withColumnRenamed("file_id", "id")
    rows = materialise_vectors(matrix.assemble(samples, features.ALL_FEATURES).select("id", "features", "label"))
    detector = fit(rows, "random_forest", names=list(features.ALL_FEATURES))
    found = rules.findings(corpus_table(spark, folder))
    known = F.col("ml_prediction").isin(detector.classes).alias("known")
    # The likeliest of k classes has a share of 1 / k at least.
    confident = F.col("ml_confidence").between(1 / len(detector.classes) - 1e-9, 1).alias("confident")
    return models.predict_findings(found, detector).select("file_id", "finding_no", "rule_id", known, confident)


@query("l03_predict_proba", f"WITH {_TEST} SELECT id, k::INTEGER AS label, true AS valid, true AS sums_to_one FROM test, range(10) AS r(k)")
def _(spark, folder):
    train, test = parts(vectors(spark, folder))
    scored = fit(train, "logistic_regression").predict_proba(test)
    whole = F.abs(F.aggregate("proba", F.lit(0.0), lambda t, p: t + p) - 1.0) < 1e-6
    rows = scored.select("id", whole.alias("sums_to_one"), F.posexplode("proba").alias("label", "probability"))
    return rows.select("id", "label", _share(F.col("probability")).alias("valid"), "sums_to_one")


@query("l04_feature_importance", _WIDTH)
def _(spark, folder):
    train, _ = parts(vectors(spark, folder))
    return _importance(fit(train, "random_forest").importance_table(spark))


@query("l04b_feature_importance_permutation", _WIDTH.replace(", true AS sums_to_one", ""))
def _(spark, folder):
    train, _ = parts(vectors(spark, folder))
    # Losses of accuracy: from nought on, without a common sum.
    return _importance(fit(train, "neural_network").importance_table(spark)).drop("sums_to_one")


_SECTIONS = f"""WITH {_TEST}, classes AS (
  SELECT label::VARCHAR AS class, count(*)::DOUBLE AS support FROM test GROUP BY label
  UNION ALL SELECT c, (SELECT count(*) FROM test) FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) AS v(c))
SELECT 'classification_report' AS section, class, metric, CASE WHEN metric = 'support' THEN support END AS support, true AS valid
FROM classes, (VALUES ('precision'), ('recall'), ('f1'), ('support')) AS m(metric)
UNION ALL SELECT 'accuracy', '', 'accuracy', NULL, true"""


@query("l05_evaluate", _SECTIONS)
def _(spark, folder):
    train, test = parts(vectors(spark, folder))
    found = fit(train, "logistic_regression").evaluate(test)
    is_support = F.col("metric") == "support"
    return found.select("section", "class", "metric", F.when(is_support, F.col("value")).alias("support"), (is_support | _share(F.col("value"))).alias("valid"))


@query("l06_cross_validation", "SELECT f::INTEGER AS fold, true AS valid FROM range(5) AS r(f)")
def _(spark, folder):
    rows = vectors(spark, folder)
    scores = models.VulnerabilityDetector("logistic_regression").cross_validate(rows)
    return scores.select("fold", _share(F.col("accuracy")).alias("valid"))


def _ranker(spark, folder):
    found = rules.findings(corpus_table(spark, folder))
    found = materialise(found.withColumn("priority", rules.severity_label(F.col("severity"))), "findings")
    return found, models.VulnerabilityRanker().fit(found)


_RANKED = f"SELECT {len(features.ALL_FEATURES) + 2}::BIGINT AS n_features, {len(features.ALL_FEATURES) + 2}::BIGINT AS n_valid, true AS sums_to_one"


@query("l07_ranker_fit", _RANKED)
def _(spark, folder):
    _, ranker = _ranker(spark, folder)
    return _importance(ranker.detector.importance_table(spark))


# Priorities are the severities' labels, so an expected one lies between the least and the greatest of them.
_SCORED = "SELECT file_id, finding_no, rule_id, true AS valid FROM found"


@query("l08_rank_findings", with_findings(_SCORED))
def _(spark, folder):
    found, ranker = _ranker(spark, folder)
    classes = ranker.detector.classes
    valid = F.col("priority_score").between(min(classes) - 1e-9, max(classes) + 1e-9) & _share(F.col("priority_confidence"))
    return ranker.rank_vulnerabilities(found).select("file_id", "finding_no", "rule_id", valid.alias("valid"))


@query("l09_attach_prediction", with_findings("SELECT file_id, finding_no, severity, true AS known FROM found"))
def _(spark, folder):
    rows = code_vectors(spark, folder)
    detector = fit(rows, "logistic_regression", {"reg_param": 0.01}, list(features.ALL_FEATURES))
    found = rules.findings(corpus_table(spark, folder))
    known = F.col("ml_prediction").isin(detector.classes).alias("known")
    return models.predict_findings(found, detector).select("file_id", "finding_no", "severity", known)


@query("s13_model_save_load", f"WITH {_TEST} SELECT count(*) AS n_rows, count(*) AS n_same, true AS beats_majority FROM test")
def _(spark, folder):
    train, test = parts(vectors(spark, folder))
    detector = fit(train, "random_forest")
    path = scratch_dir(spark, "model")
    detector.save_model(spark, path)
    again = models.VulnerabilityDetector.load_model(spark, path)
    before = detector.predict(test).select("id", "prediction")
    after = again.predict(test).select("id", F.col("prediction").alias("reloaded"))
    counts = before.join(after, "id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("prediction") == F.col("reloaded")).alias("n_same")
    )
    return counts.join(_beats_majority(again.predict(train)))  # one row each


@query("e18_robustness", "SELECT e::DOUBLE AS epsilon, true AS valid, true AS drop_adds_up FROM (VALUES (0.01), (0.05), (0.1), (0.2)) AS v(e)")
def _(spark, folder):
    train, test = parts(vectors(spark, folder))
    detector = fit(train, "logistic_regression")
    found = evaluate.robustness(detector, test)
    # The baseline is the accuracy on the rows as they are, found without the noise levels: one row.
    clean = detector.predict(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("clean"))
    adds_up = F.abs(F.col("clean") - F.col("accuracy") - F.col("accuracy_drop")) < 1e-9
    return found.crossJoin(F.broadcast(clean)).select("epsilon", _share(F.col("accuracy")).alias("valid"), adds_up.alias("drop_adds_up"))


@query(
    "e24_learning_curve",
    f"""WITH ranked AS (SELECT row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS place,
  count(*) OVER (PARTITION BY label) AS size FROM embeddings)
SELECT f AS fraction, k::INTEGER AS fold, count(*) FILTER (place <= ceil(f * size) AND place % 5 <> k) AS n_train, true AS valid
FROM ranked, (VALUES {", ".join(f"({f}::DOUBLE)" for f in models.LEARNING_FRACTIONS)}) AS v(f), range(5) AS r(k) GROUP BY f, k""",
)
def _(spark, folder):
    curve = models.learning_curve(vectors(spark, folder), "logistic_regression", {"reg_param": 0.01})
    return curve.select("fraction", "fold", "n_train", (_share(F.col("train_accuracy")) & _share(F.col("test_accuracy"))).alias("valid"))


@query("e21_top_features", "SELECT count(*) AS n_features, count(*) AS n_top FROM range(15)")
def _(spark, folder):
    train, _ = parts(vectors(spark, folder))
    table = fit(train, "random_forest").importance_table(spark)
    top = evaluate.top_features(table, 15)
    # None that is left out is greater than one that is kept.
    least = top.agg(F.min("importance").alias("least"))
    above = table.crossJoin(F.broadcast(least)).agg(F.count_if(F.col("importance") >= F.col("least")).alias("n_top"))
    return top.agg(F.count("*").alias("n_features")).crossJoin(above)  # one row each


@query("e23_ranker_summary", with_findings("SELECT count(*) AS total_ranked, true AS valid FROM found"))
def _(spark, folder):
    found, ranker = _ranker(spark, folder)
    summary = evaluate.ranking_summary(ranker.rank_vulnerabilities(found))
    return summary.select("total_ranked", _share(F.col("avg_confidence")).alias("valid"))


def _means(rows):
    """Mean of each feature: one row of the vector's width."""
    from pyspark.ml.stat import Summarizer

    return rows.select(Summarizer.mean(F.col("features"))).first()[0]


def _adds_up(explained, raw):
    """``id, n_top, adds_up``: features kept, and whether base value and all values make the model's own output."""
    total = F.aggregate("shap_values", F.col("base_value"), lambda t, v: t + v)
    rows = explained.join(raw, "id")
    return rows.select("id", F.size("feature_importance").alias("n_top"), (F.abs(total - F.col("raw")) < 1e-9).alias("adds_up"))


def _margin(detector, rows, k=attribution.POSITIVE_CLASS):
    """``id, raw``: the linear margin of a class, by the model itself."""
    model = detector.models[0].copy().setRawPredictionCol("_raw")
    return model.transform(rows.select("id", "features")).select("id", vector_to_array("_raw")[k].alias("raw"))


@query("xs1_attribution_linear", f"WITH {_TEST} SELECT id, 10 AS n_top, true AS adds_up FROM test")
def _(spark, folder):
    train, test = parts(vectors(spark, folder))
    detector = fit(train, "logistic_regression")
    return _adds_up(attribution.linear_attribution(detector, test, _means(train)), _margin(detector, test))


@query("xs2_attribution_batch", "SELECT doc_id AS id, 10 AS n_top, true AS adds_up FROM documents ORDER BY doc_id LIMIT 10")
def _(spark, folder):
    rows = code_vectors(spark, folder)
    detector = fit(rows, "random_forest", names=list(features.ALL_FEATURES))
    return _adds_up(attribution.explain_batch(detector, rows), attribution.raw_output(detector, rows))


@query("xs3_tree_attribution", "SELECT vec_id AS id, 10 AS n_top, true AS adds_up FROM embeddings")
def _(spark, folder):
    """Exact attributions of a forest for every row."""
    rows = vectors(spark, folder)
    detector = fit(parts(rows)[0], "random_forest")
    return _adds_up(attribution.tree_attribution(detector, rows), attribution.raw_output(detector, rows))


@query("xs3b_boosted_attribution", "SELECT doc_id AS id, 10 AS n_top, true AS adds_up FROM documents")
def _(spark, folder):
    """Exact attributions of boosted trees for every file, safe ones against the rest."""
    rows = code_vectors(spark, folder).withColumn("label", (F.col("label") > 0).cast("int"))
    detector = fit(rows, "gradient_boosting", {"n_estimators": 20, "max_depth": 4}, list(features.ALL_FEATURES))
    return _adds_up(attribution.tree_attribution(detector, rows), attribution.raw_output(detector, rows))


@query(
    "xe3b_explain_with_attribution",
    with_findings("""SELECT 'total_explanations' AS metric, '' AS key, count(*)::DOUBLE AS total, true AS valid FROM found
  UNION ALL SELECT 'avg_confidence', '', NULL, true UNION ALL SELECT 'rule_evidence_count', '', NULL, true
  UNION ALL SELECT 'top_features', 'feature ' || k, NULL, true FROM range(1, 11) AS r(k)"""),
)
def _(spark, folder):
    rows = code_vectors(spark, folder)
    names = list(features.ALL_FEATURES)
    detector = fit(rows, "logistic_regression", {"reg_param": 0.01}, names)
    values = attribution.linear_attribution(detector, rows, _means(rows)).withColumnRenamed("id", "file_id")
    explained = evidence.explain(corpus_table(spark, folder), scope="file", attributions=values)
    found = evidence.explanation_summary(explained)
    is_top, is_total = F.col("metric") == "top_features", F.col("metric") == "total_explanations"
    # The ten strongest, by their place: which they are depends on the fit.
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "key"))
    return found.withColumn("place", place).select(
        "metric", F.when(is_top, F.concat(F.lit("feature "), "place")).otherwise(F.lit("")).alias("key"),
        F.when(is_total, F.col("value")).alias("total"), (F.col("value") >= 0).alias("valid"),
    )


def _means(rows):
    """Mean of each feature: one row of the vector's width."""
    from pyspark.ml.stat import Summarizer

    return rows.select(Summarizer.mean(F.col("features"))).first()[0]
