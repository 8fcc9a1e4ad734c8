"""Severity detector and finding ranker on Spark ML."""

from __future__ import annotations

import json
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
    MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier,
    RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import evaluate
from riskweave.operators.boosting import SoftmaxBoosting
from riskweave.operators.features import ALL_FEATURES, all_features
from riskweave.operators.matrix import assemble
from riskweave.operators.ranks import shuffled_rank
from riskweave.operators.rules import severity_label

# Model names, defaults of detector and ranker, folds.
MODEL_TYPES = ("gradient_boosting", "random_forest", "logistic_regression", "neural_network")
DETECTOR_CONFIG = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6, "random_state": 42, "max_classes": 1000, "multi_class": "softmax"}
RANKER_CONFIG = {"n_estimators": 50, "learning_rate": 0.05, "max_depth": 4, "random_state": 42, "multi_class": "one_vs_rest"}
CV_FOLDS = 5
LEARNING_FRACTIONS = (0.1, 0.325, 0.55, 0.775, 1.0)

_MODELS = {
    "gradient_boosting": GBTClassificationModel,
    "random_forest": RandomForestClassificationModel,
    "logistic_regression": LogisticRegressionModel,
    "neural_network": MultilayerPerceptronClassificationModel,
}


class VulnerabilityDetector:
    """A classifier over a ``features`` vector and an integer ``label`` column.

    Boosting with more than two classes grows its trees under one softmax loss, or with config ``multi_class`` of
    ``one_vs_rest`` fits one model per class.
    """

    def __init__(self, model_type: str = "gradient_boosting", config: dict | None = None):
        if model_type not in MODEL_TYPES:
            raise ValueError(f"unknown model type: {model_type}")
        self.model_type = model_type
        self.config = {**DETECTOR_CONFIG, **(config or {})}
        self.is_fitted = False
        self.classes: list[int] = []
        self.feature_names: list[str] = []
        self.models: list = []
        self._importance: dict[str, float] | None = None
        self._fitted_on: DataFrame | None = None

    # -- fitting -----------------------------------------------------------------------------

    def _estimator(self, n_features: int):
        c = self.config
        if self.model_type == "gradient_boosting":
            return GBTClassifier(
                maxIter=c["n_estimators"], stepSize=c["learning_rate"], maxDepth=c["max_depth"], seed=c["random_state"]
            )
        if self.model_type == "random_forest":
            return RandomForestClassifier(numTrees=c["n_estimators"], maxDepth=c["max_depth"], seed=c["random_state"])
        if self.model_type == "logistic_regression":
            return LogisticRegression(maxIter=c.get("max_iter", 100), regParam=c.get("reg_param", 0.0), family="multinomial")
        hidden = c.get("hidden_layers", [64, 32])
        return MultilayerPerceptronClassifier(
            layers=[n_features, *hidden, len(self.classes)], maxIter=c.get("max_iter", 100), seed=c["random_state"]
        )

    def fit(self, rows: DataFrame, feature_names=None) -> "VulnerabilityDetector":
        # The distinct labels are the classes, held by the driver; config ``max_classes`` is how many may be.
        most = self.config["max_classes"]
        seen = rows.select(F.col("label").cast("int")).distinct().limit(most + 1).collect()
        if len(seen) > most:
            raise ValueError(f"more than {most} classes")
        self.classes = sorted(r[0] for r in seen)
        if not self.classes:
            raise ValueError("no rows to fit")
        n_features = len(rows.select("features").first()[0])
        self.feature_names = list(feature_names or [f"feature_{i}" for i in range(n_features)])
        place = F.array_position(F.array(*[F.lit(k) for k in self.classes]), F.col("label").cast("int")) - 1
        data = rows.select("features", place.cast("double").alias("label")).persist()
        try:
            estimator = self._estimator(n_features)
            if self.model_type == "gradient_boosting" and len(self.classes) > 2 and self.config["multi_class"] == "softmax":
                c = self.config
                self.models = [SoftmaxBoosting(len(self.classes), c["n_estimators"], c["learning_rate"], c["max_depth"]).fit(data)]
            elif self.model_type == "gradient_boosting":
                self.models = self._fit_per_class(estimator, data)
            else:
                self.models = [estimator.fit(data)]
        finally:
            data.unpersist()
        self._importance = None
        self._fitted_on = rows if self.model_type == "neural_network" else None
        self.is_fitted = True
        return self

    @property
    def softmax(self) -> SoftmaxBoosting | None:
        """The boosted trees of several classes, if that is what was fitted."""
        return self.models[0] if self.models and isinstance(self.models[0], SoftmaxBoosting) else None

    def _fit_per_class(self, estimator, data: DataFrame) -> list:
        """This boosting is binary: one model per class against the rest (one model for two classes)."""
        targets = [1] if len(self.classes) <= 2 else range(len(self.classes))

        def fit(k):
            return estimator.fit(data.withColumn("label", (F.col("label") == k).cast("double")))

        # As in OneVsRest: the driver only waits, the fits share the cluster.
        with ThreadPool(min(len(targets), self.config.get("parallelism", 4))) as pool:
            return pool.map(inheritable_thread_target(data.sparkSession)(fit), targets)

    # -- using -------------------------------------------------------------------------------

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``proba`` (one entry per class, summing to one) and ``prediction`` (a label)."""
        if not self.models:
            raise ValueError("the detector must be fitted first")
        if self.softmax:
            out = rows.withColumn("_raw", self.softmax.margins(rows.sparkSession, "features"))
            out = out.withColumn("_e", F.transform("_raw", lambda v: F.exp(v - F.array_max("_raw"))))
            total = F.aggregate("_e", F.lit(0.0), lambda t, v: t + v)
            proba = F.transform("_e", lambda v: v / total)
        elif self.model_type == "gradient_boosting":
            out, shares = rows, []
            for i, model in enumerate(self.models):
                model = model.copy()
                model.setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_prob{i}").setPredictionCol(f"_pred{i}")
                out = model.transform(out).withColumn(f"_p{i}", vector_to_array(f"_prob{i}")[1])
                shares.append(F.col(f"_p{i}"))
            if len(self.models) == 1:
                proba = F.array(1 - shares[0], shares[0]) if len(self.classes) > 1 else F.array(F.lit(1.0))
            else:
                total = sum(shares[1:], shares[0])
                proba = F.array(*[s / total for s in shares])
        else:
            model = self.models[0].copy()
            model.setRawPredictionCol("_raw").setProbabilityCol("_prob").setPredictionCol("_pred")
            out = model.transform(rows)
            proba = vector_to_array("_prob")
        out = out.withColumn("proba", proba)
        best = F.array_position("proba", F.array_max("proba")).cast("int") - 1
        label = F.get(F.array(*[F.lit(k) for k in self.classes]), best)
        return out.withColumn("prediction", label).select(*rows.columns, "proba", "prediction")

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.transform(rows).drop("proba")

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        return self.transform(rows).drop("prediction")

    def evaluate(self, rows: DataFrame) -> DataFrame:
        """``section, class, metric, value``: accuracy and the classification report."""
        preds = self.transform(rows).select(F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
        report = evaluate.report(preds)
        long = report.select(
            F.lit("classification_report").alias("section"), "class",
            F.inline(
                F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                          for m in ("precision", "recall", "f1", "support")])
            ),
        )
        accuracy = evaluate.overall(preds).where("metric = 'accuracy'").select(
            F.lit("accuracy").alias("section"), F.lit("").alias("class"), "metric", "value"
        )
        return accuracy.unionByName(long)

    def cross_validate(self, rows: DataFrame, folds: int = CV_FOLDS, id_col: str = "id") -> DataFrame:
        """``fold, accuracy`` for stratified folds; ``cross_validation_summary`` averages them."""
        placed = shuffled_rank(rows.select(id_col, "features", "label"), ["label"], self.config["random_state"], id_col)
        placed = placed.withColumn("fold", (F.col("rank") % folds).cast("int")).drop("rank", "group_size").persist()
        try:
            scores = None
            for fold in range(folds):
                model = VulnerabilityDetector(self.model_type, self.config).fit(
                    placed.where(F.col("fold") != fold), self.feature_names or None
                )
                hits = model.transform(placed.where(F.col("fold") == fold)).agg(
                    F.lit(fold).alias("fold"),
                    F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
                )
                scores = hits if scores is None else scores.unionByName(hits)
            # One number per fold.
            found = scores.collect()
        finally:
            placed.unpersist()
        return rows.sparkSession.createDataFrame(found, "fold int, accuracy double")

    # -- importance --------------------------------------------------------------------------

    def get_feature_importance(self) -> dict[str, float]:
        """Feature to score, best first."""
        if self._importance is None:
            if self.model_type == "neural_network":
                self._importance = self._permutation_importance(self._fitted_on)
            elif self.model_type == "logistic_regression":
                weights = abs(self.models[0].coefficientMatrix.toArray()).mean(axis=0)
            elif self.softmax:
                weights = self.softmax.importances
            else:
                weights = sum(m.featureImportances.toArray() for m in self.models) / len(self.models)
            if self._importance is None:
                self._importance = dict(zip(self.feature_names, (float(w) for w in weights)))
        return dict(sorted(self._importance.items(), key=lambda kv: (-kv[1], kv[0])))

    def importance_table(self, spark: SparkSession) -> DataFrame:
        rows = list(self.get_feature_importance().items())
        return spark.createDataFrame(rows, "feature string, importance double")

    def _permutation_importance(self, rows: DataFrame) -> dict[str, float]:
        """Accuracy lost when a feature's values are dealt out anew among the rows.

        Two hash orders of the rows, joined by rank, give every row a donor row; each feature is
        then swapped for the donor's in its own copy of the row.  The rows fitted on need an ``id``.
        """
        if "id" not in rows.columns:
            raise ValueError("permutation importance needs rows with an id")
        plain = rows.select("id", "label", vector_to_array("features").alias("x"))
        takers = shuffled_rank(plain, [], "taker", "id").select("rank", "label", "x")
        donors = shuffled_rank(plain, [], "donor", "id").select("rank", F.col("x").alias("z"))
        paired = takers.join(donors, "rank")
        n = len(self.feature_names)
        copies = paired.select("label", "x", "z", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))).alias("j"))
        swapped = copies.select(
            "label", "j",
            array_to_vector(
                F.transform("x", lambda v, i: F.when(i == F.col("j"), F.get(F.col("z"), i)).otherwise(v))
            ).alias("features"),
        )
        scores = {
            r["j"]: r["accuracy"]
            for r in self.transform(swapped)
            .groupBy("j")
            .agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
            .collect()  # one number per feature
        }
        return {name: max(0.0, scores[-1] - scores[i]) for i, name in enumerate(self.feature_names)}

    # -- storage -----------------------------------------------------------------------------

    def save_model(self, spark: SparkSession, path: str) -> None:
        about = {
            "model_type": self.model_type, "config": self.config, "classes": self.classes,
            "feature_names": self.feature_names, "n_models": len(self.models), "softmax": self.softmax is not None,
            "importance": self.get_feature_importance(),
        }
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        if self.softmax:
            self.softmax.save(spark, f"{path}/softmax")
            return
        for i, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/model{i}")

    @classmethod
    def load_model(cls, spark: SparkSession, path: str) -> "VulnerabilityDetector":
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        out = cls(about["model_type"], about["config"])
        out.classes, out.feature_names = about["classes"], about["feature_names"]
        out._importance = about["importance"]
        kind = _MODELS[out.model_type]
        out.models = [SoftmaxBoosting.load(spark, f"{path}/softmax")] if about.get("softmax") else [kind.load(f"{path}/model{i}") for i in range(about["n_models"])]
        out.is_fitted = True
        return out


def cross_validation_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("folds"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy")
    )


def in_prefix(fraction: float):
    """Whether a row of ``shuffled_rank`` is among the first ``fraction`` of its group; a larger fraction holds a smaller one's rows."""
    return F.col("rank") <= F.ceil(F.lit(float(fraction)) * F.col("group_size"))


def learning_curve(
    rows: DataFrame, model_type: str = "gradient_boosting", config: dict | None = None, fractions=LEARNING_FRACTIONS,
    folds: int = CV_FOLDS, id_col: str = "id",
) -> DataFrame:
    """``fraction, fold, n_train, train_accuracy, test_accuracy`` of models fitted on ever larger nested sets.

    Rows stand in the order of a hash within their label.  The fold says which are held out, the place in that
    order from which fraction on a row is learnt from.  A fraction without a row to learn from has null scores.
    """
    seed = {**DETECTOR_CONFIG, **(config or {})}["random_state"]
    placed = shuffled_rank(rows.select(id_col, "features", "label"), ["label"], seed, id_col)
    placed = placed.withColumn("fold", (F.col("rank") % folds).cast("int")).persist()

    def score(task):
        fraction, fold = task
        held = F.col("fold") == fold
        learn = placed.where(~held & in_prefix(fraction))
        if learn.isEmpty():
            return float(fraction), fold, 0, None, None
        model = VulnerabilityDetector(model_type, config).fit(learn)
        hit = (F.col("prediction") == F.col("label")).cast("double")
        scored = model.transform(placed.where(held | in_prefix(fraction)))
        got = scored.agg(F.count_if(~held), F.avg(F.when(~held, hit)), F.avg(F.when(held, hit))).first()
        return float(fraction), fold, *got

    tasks = [(fraction, fold) for fraction in fractions for fold in range(folds)]
    try:
        # The driver only waits, the fits share the cluster.
        with ThreadPool(min(len(tasks), (config or {}).get("parallelism", 4))) as pool:
            found = pool.map(inheritable_thread_target(rows.sparkSession)(score), tasks, chunksize=1)
    finally:
        placed.unpersist()
    return rows.sparkSession.createDataFrame(found, "fraction double, fold int, n_train bigint, train_accuracy double, test_accuracy double")


class VulnerabilityRanker:
    """Orders findings by expected priority: snippet features, severity and type into the detector."""

    def __init__(self, config: dict | None = None, model_type: str = "gradient_boosting"):
        self.detector = VulnerabilityDetector(model_type, {**RANKER_CONFIG, **(config or {})})
        self.types: StringIndexerModel | None = None

    def _features(self, found: DataFrame) -> DataFrame:
        with_code = found.withColumns(
            {"code": F.coalesce("code_snippet", F.lit("")), "severity_code": severity_label(F.col("severity"))}
        )
        measured = self.types.transform(all_features(with_code))
        return assemble(measured, self._names()).drop(*ALL_FEATURES, "severity_code", "type_code")

    @staticmethod
    def _names():
        return [*ALL_FEATURES, "severity_code", "type_code"]

    def fit(self, found: DataFrame, priority: str = "priority") -> "VulnerabilityRanker":
        self.types = StringIndexer(
            inputCol="vulnerability_type", outputCol="type_code", handleInvalid="keep", stringOrderType="alphabetAsc"
        ).fit(found)
        self.detector.fit(self._features(found).withColumn("label", F.col(priority).cast("int")), self._names())
        return self

    def rank_vulnerabilities(self, found: DataFrame) -> DataFrame:
        """Findings with ``priority_score`` and ``priority_confidence``, best first, equal ones by file and number.

        Equal scores are common, so only the whole key lets the range sort spread them over tasks.
        """
        scored = self.detector.transform(self._features(found)).drop("features")
        classes = F.array(*[F.lit(float(k)) for k in self.detector.classes])
        expected = F.aggregate(
            F.zip_with("proba", classes, lambda p, k: p * k), F.lit(0.0), lambda total, x: total + x
        )
        return scored.withColumns(
            {"priority_score": expected, "priority_confidence": F.array_max("proba")}
        ).orderBy(F.desc("priority_score"), F.desc("priority_confidence"), *[c for c in ("file_id", "file_path", "finding_no") if c in found.columns])

    def save_model(self, spark: SparkSession, path: str) -> None:
        self.types.write().overwrite().save(f"{path}/types")
        self.detector.save_model(spark, f"{path}/detector")

    @classmethod
    def load_model(cls, spark: SparkSession, path: str) -> "VulnerabilityRanker":
        out = cls()
        out.types = StringIndexerModel.load(f"{path}/types")
        out.detector = VulnerabilityDetector.load_model(spark, f"{path}/detector")
        return out


def predict_findings(found: DataFrame, detector: VulnerabilityDetector) -> DataFrame:
    """Findings with ``ml_prediction`` and ``ml_confidence`` from their snippets' features."""
    with_code = found.withColumn("code", F.coalesce("code_snippet", F.lit("")))
    scored = detector.transform(assemble(all_features(with_code), detector.feature_names))
    return scored.select(
        *found.columns, F.col("prediction").alias("ml_prediction"), F.array_max("proba").alias("ml_confidence")
    )
