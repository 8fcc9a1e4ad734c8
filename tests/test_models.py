import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweave.operators import attribution, evaluate, models, rules
from riskweave.session import tune

CONFIGS = {
    "gradient_boosting": {"n_estimators": 2, "max_depth": 2},
    "random_forest": {"n_estimators": 5, "max_depth": 3},
    "logistic_regression": {},
    "neural_network": {"max_iter": 30, "hidden_layers": [8]},
}


@pytest.fixture(scope="module")
def data(spark):
    """Labels 0, 2 and 4: classes need not be consecutive."""
    tune(spark)
    rng = np.random.default_rng(0)
    x = rng.random((120, 4))
    y = (x[:, 0] * 2.999).astype(int) * 2
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(120)]
    return spark.createDataFrame(rows, "id int, x array<double>, label int").select(
        "id", array_to_vector("x").alias("features"), "label"
    ).cache()


@pytest.mark.parametrize("kind", list(models.MODEL_TYPES))
def test_contract(spark, data, kind, tmp_path):
    detector = models.VulnerabilityDetector(kind, CONFIGS[kind]).fit(data, list("abcd"))
    assert detector.is_fitted and detector.classes == [0, 2, 4]
    rows = detector.transform(data).collect()
    assert len(rows) == 120 and {r.prediction for r in rows} <= {0, 2, 4}
    assert all(abs(sum(r.proba) - 1) < 1e-6 for r in rows)
    assert np.mean([r.prediction == r.label for r in rows]) > 0.7
    importance = detector.get_feature_importance()
    assert set(importance) == set("abcd") and next(iter(importance)) == "a"
    assert list(importance.values()) == sorted(importance.values(), reverse=True)
    detector.save_model(spark, str(tmp_path / "m"))
    again = models.VulnerabilityDetector.load_model(spark, str(tmp_path / "m"))
    assert [r.prediction for r in again.predict(data).orderBy("id").collect()] == [r.prediction for r in sorted(rows, key=lambda r: r.id)]
    assert {r.section for r in detector.evaluate(data).collect()} == {"accuracy", "classification_report"}


def test_two_classes_and_errors(spark, data):
    two = data.withColumn("label", (F.col("label") > 0).cast("int"))
    detector = models.VulnerabilityDetector("gradient_boosting", CONFIGS["gradient_boosting"]).fit(two)
    assert len(detector.models) == 1 and len(detector.transform(two).first().proba) == 2
    with pytest.raises(ValueError):
        models.VulnerabilityDetector("oracle")
    with pytest.raises(ValueError):
        models.VulnerabilityDetector().transform(data)


def test_cross_validation(spark, data):
    scores = models.VulnerabilityDetector("logistic_regression").cross_validate(data, folds=3)
    summary = models.cross_validation_summary(scores).first()
    assert summary.folds == 3 and 0.5 < summary.mean_accuracy <= 1


def test_linear_attribution_adds_up(spark, data):
    detector = models.VulnerabilityDetector("logistic_regression", {"reg_param": 0.1}).fit(data, list("abcd"))
    means = np.mean([r.features.toArray() for r in data.collect()], axis=0)
    model = detector.models[0]
    got = {r.id: r for r in attribution.linear_attribution(detector, data, means).collect()}
    for r in data.take(10):
        margin = model.coefficientMatrix.toArray()[1] @ r.features.toArray() + model.interceptVector[1]
        assert got[r.id].base_value + sum(got[r.id].shap_values) == pytest.approx(margin)


def test_sampled_attribution_adds_up(spark, data):
    detector = models.VulnerabilityDetector("random_forest", CONFIGS["random_forest"]).fit(data, list("abcd"))
    background = attribution.normal_background(spark, 4, 20)
    rows = attribution.explain_batch(detector, data, background, max_samples=4).collect()
    proba = {r.id: r.proba[1] for r in detector.transform(data).collect()}
    assert [r.id for r in sorted(rows, key=lambda r: r.id)] == [0, 1, 2, 3]
    for r in rows:
        assert r.base_value + sum(r.shap_values) == pytest.approx(proba[r.id])
        assert set(r.feature_importance) == set("abcd")


class Linear:
    """A scorer whose exact values are known: weight times distance from the background mean."""

    feature_names, classes, weights = list("abcd"), [0, 1], [0.5, -0.2, 0.1, 0.0]

    def transform(self, rows):
        from pyspark.ml.functions import vector_to_array

        weighted = F.zip_with(vector_to_array("features"), F.array(*[F.lit(w) for w in self.weights]), lambda x, w: x * w)
        score = F.aggregate(weighted, F.lit(0.0), lambda t, v: t + v)
        return rows.withColumns({"proba": F.array(1 - score, score), "prediction": F.lit(1)})


def test_sampled_attribution_is_exact_for_a_linear_score(spark, data):
    background = attribution.normal_background(spark, 4, 15)
    mean = np.mean([r.z for r in background.collect()], axis=0)
    rows = {r.id: r for r in attribution.sampled_attribution(Linear(), data.limit(5), background).collect()}
    for r in data.limit(5).collect():
        assert np.allclose(rows[r.id].shap_values, np.array(Linear.weights) * (r.features.toArray() - mean))


def test_robustness(spark, data):
    detector = models.VulnerabilityDetector("logistic_regression").fit(data)
    rows = {r.epsilon: r for r in evaluate.robustness(detector, data, (0.01, 2.0)).collect()}
    assert rows[0.01].accuracy > rows[2.0].accuracy
    assert rows[2.0].accuracy_drop == pytest.approx(rows[2.0].baseline_accuracy - rows[2.0].accuracy)


def test_ranker(spark, tmp_path):
    tune(spark)
    codes = ["password = 'x'", "eval(y)", "input()", "md5(z)"] * 8
    table = spark.createDataFrame([(i, f"f{i}.py", c) for i, c in enumerate(codes)], "file_id int, file_path string, code string")
    found = rules.findings(table).withColumn("priority", rules.severity_label(F.col("severity")))
    ranker = models.VulnerabilityRanker({"n_estimators": 5, "max_depth": 3}, "random_forest").fit(found)
    ranked = ranker.rank_vulnerabilities(found).collect()
    assert ranked[0].severity == "critical" and ranked[-1].severity == "low"
    assert evaluate.ranking_summary(ranker.rank_vulnerabilities(found)).first().total_ranked == len(ranked)
    ranker.save_model(spark, str(tmp_path / "r"))
    again = models.VulnerabilityRanker.load_model(spark, str(tmp_path / "r"))
    assert again.rank_vulnerabilities(found).first().severity == "critical"
