"""Whole flows: scan a directory, train on a synthetic corpus, evaluate saved models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import evaluate, evidence, matrix, models, rules, summary, synth
from riskweave.operators.features import ALL_FEATURES
from riskweave.session import materialise, tune
from riskweave.sources import datasets, files

# Label names in label order.
LABEL_NAMES = ["safe", "low", "medium", "high", "critical"]


def scan_report(
    spark: SparkSession, root: str, output: str | None = None, kind: str = "json", severities=None, explain: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Findings below ``root`` (kept, so they are scanned once) and their counts by severity."""
    sources = files.source_files(tune(spark), root).where("code is not null").drop("problem")
    found = evidence.explain(sources) if explain else rules.findings(sources)
    if severities:
        found = rules.by_severity(found, severities)
    found = materialise(found, "findings")
    if output:
        plain = [c for c, t in found.dtypes if kind == "json" or not t.startswith(("array", "map"))]
        datasets.write_findings(found.select(*plain), output, kind)
    return found, summary.severity_counts(found)


def _vectors(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    scaled = matrix.scale_apply(matrix.fill_missing(rows, ALL_FEATURES), fitted, ALL_FEATURES)
    return matrix.assemble(scaled, ALL_FEATURES).drop(*ALL_FEATURES)


def measure(preds: DataFrame) -> DataFrame:
    """``section, metric, value`` of rows with ``id, y_true, y_pred, proba``.

    Ranking takes the chance of any finding as score and a label above zero as relevant.
    """
    ranked = preds.select("id", (F.col("y_true") > 0).cast("int").alias("y_true"), (1 - F.get("proba", F.lit(0))).alias("score"))
    recall = evaluate.recall_by_type(preds, LABEL_NAMES).select(F.col("type").alias("metric"), F.col("recall").alias("value"))
    alerts = evaluate.alert_volume(preds, LABEL_NAMES).select(F.col("type").alias("metric"), F.col("percentage").alias("value"))
    sections = {
        "detection_performance": evaluate.overall(preds).unionByName(evaluate.auc_one_vs_rest(preds)),
        "precision_at_k": evaluate.precision_at_k(ranked),
        "vulnerability_recall": recall,
        "false_positive_rate": evaluate.false_positive_rate(preds),
        "alert_volume": alerts,
    }
    out = None
    for name, metrics in sections.items():
        part = metrics.select(F.lit(name).alias("section"), "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


def _predictions(detector, rows: DataFrame) -> DataFrame:
    scored = detector.transform(rows).select("id", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"), "proba")
    return materialise(scored, "predictions")


def train(
    spark: SparkSession, output: str, num_vulnerable: int = 200, num_safe: int = 300, ratios=(0.7, 0.15, 0.15),
    seed=42, model_type: str = "gradient_boosting", config: dict | None = None, ranker_config: dict | None = None,
    ranker_type: str = "gradient_boosting",
) -> DataFrame:
    """Generate, keep, train, save and measure; returns the test scores."""
    tune(spark)
    datasets.write_dataset(synth.generate(spark, num_vulnerable, num_safe, ratios, seed), f"{output}/dataset")
    # From the JSON copy, which keeps every character.
    samples = spark.read.schema(datasets.SAMPLE_SCHEMA + ", split string").json(f"{output}/dataset/json")
    rows = materialise(matrix.labelled(samples).select("id", "split", "label", *ALL_FEATURES), "features")
    learn = rows.where("split = 'train'")
    matrix.scale_fit(learn, ALL_FEATURES).write.mode("overwrite").parquet(f"{output}/scale")
    fitted = spark.read.parquet(f"{output}/scale")
    detector = models.VulnerabilityDetector(model_type, config).fit(
        materialise_vectors(_vectors(learn, fitted)), list(ALL_FEATURES)
    )
    detector.save_model(spark, f"{output}/detector")
    code = samples.where("split = 'train'").select(F.col("id").alias("file_id"), "code")
    found = rules.findings(code).withColumn("priority", rules.severity_label(F.col("severity")))
    ranker = models.VulnerabilityRanker(ranker_config, ranker_type).fit(materialise(found, "findings"))
    ranker.save_model(spark, f"{output}/ranker")
    scores = materialise(measure(_predictions(detector, _vectors(rows.where("split = 'test'"), fitted))), "scores")
    datasets.write_results(scores, f"{output}/training_results")
    return scores


def materialise_vectors(rows: DataFrame) -> DataFrame:
    """Vectors are read once per training pass; keep them as plain arrays."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    kept = materialise(rows.withColumn("features", vector_to_array("features")), "vectors")
    return kept.withColumn("features", array_to_vector("features"))


def evaluate_models(
    spark: SparkSession, models_folder: str, output: str, num_vulnerable: int = 400, num_safe: int = 600, seed=42
) -> tuple[DataFrame, DataFrame]:
    """Score the saved detector on fresh samples; returns its scores and the leaderboard."""
    tune(spark)
    samples = synth.generate(spark, num_vulnerable, num_safe, (0.5, 0.25, 0.25), f"{seed}-evaluation")
    rows = matrix.stratified_split(matrix.labelled(samples), test_size=0.3, seed=seed)
    test = rows.where("part = 'test'").select("id", "label", *ALL_FEATURES)
    detector = models.VulnerabilityDetector.load_model(spark, f"{models_folder}/detector")
    vectors = materialise_vectors(_vectors(test, spark.read.parquet(f"{models_folder}/scale")))
    scores = measure(_predictions(detector, vectors))
    noise = evaluate.robustness(detector, vectors, seed=seed).select(
        F.lit("robustness").alias("section"), F.concat(F.lit("accuracy@"), F.col("epsilon").cast("string")).alias("metric"),
        F.col("accuracy").alias("value"),
    )
    scores = materialise(scores.unionByName(noise), "scores")
    board = evaluate.leaderboard(
        scores.where(F.col("section").isin("detection_performance", "precision_at_k")).select(
            F.lit("detector").alias("model"), "metric", "value"
        )
    )
    datasets.write_results(scores, f"{output}/evaluation_results")
    datasets.write_csv(board, f"{output}/leaderboard")
    return scores, board
