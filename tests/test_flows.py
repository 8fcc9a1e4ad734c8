from riskweave.plans import flows
from riskweave.sources import files


def test_scan_report(spark, tmp_path):
    table = spark.createDataFrame([("a/__init__.py", "eval(x)"), ("b.py", "input()")], "file_path string, code string")
    files.export_files(table, str(tmp_path / "src"))
    found, counts = flows.scan_report(spark, str(tmp_path / "src"), str(tmp_path / "out"), explain=True)
    assert {r.severity: r.n for r in counts.collect()} == {"high": 2, "low": 1}
    assert spark.read.json(str(tmp_path / "out")).count() == found.count() == 3
    only, _ = flows.scan_report(spark, str(tmp_path / "src"), str(tmp_path / "csv"), "csv", ["low"])
    assert only.count() == 1


def test_train_then_evaluate(spark, tmp_path):
    quick = {"n_estimators": 8, "max_depth": 5}
    scores = flows.train(
        spark, str(tmp_path / "m"), 120, 120, model_type="random_forest", config=quick, ranker_config=quick, ranker_type="random_forest"
    )
    got = {(r.section, r.metric): r.value for r in scores.collect()}
    assert got["detection_performance", "accuracy"] > 0.5
    assert got["precision_at_k", "precision@1"] in (0.0, 1.0)
    scores, board = flows.evaluate_models(spark, str(tmp_path / "m"), str(tmp_path / "r"), 150, 150)
    assert {r.section for r in scores.select("section").distinct().collect()} >= {"robustness", "alert_volume", "vulnerability_recall"}
    assert 0 < board.first().weighted_score <= 1
    assert spark.read.json(str(tmp_path / "r" / "evaluation_results")).count() == 6
