import numpy as np
import pytest

from riskweave.operators import evaluate

# Five predictions and the measures worked out from them.
TRUE, PRED, SCORE = [0, 1, 0, 1, 0], [0, 1, 0, 0, 1], [0.2, 0.7, 0.1, 0.4, 0.8]


@pytest.fixture(scope="module")
def five(spark):
    rows = [(i, t, p, s, [1 - s, s]) for i, (t, p, s) in enumerate(zip(TRUE, PRED, SCORE))]
    return spark.createDataFrame(rows, "id int, y_true int, y_pred int, score double, proba array<double>")


def metrics(df):
    return {r.metric: r.value for r in df.collect()}


def test_overall(five):
    got = metrics(evaluate.overall(five))
    assert got["accuracy"] == pytest.approx(0.6)
    for name in ("precision", "recall", "f1"):
        assert got[f"{name}_macro"] == pytest.approx(0.583333, abs=1e-6)
        assert got[f"{name}_weighted"] == pytest.approx(0.6)


def test_confusion_and_classes(five):
    cells = {(r.y_true, r.y_pred): r.n for r in evaluate.confusion_matrix(five).collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    per = {r["class"]: r for r in evaluate.per_class(five, ["safe"]).collect()}
    assert per["safe"].f1 == pytest.approx(2 / 3) and per["class_1"].precision == 0.5


def test_areas(five):
    assert evaluate.roc_auc(five).first().auc == pytest.approx(0.666667, abs=1e-6)
    assert evaluate.average_precision(five).first().average_precision == pytest.approx(0.583333, abs=1e-6)


def test_false_positive_rate(five):
    got = metrics(evaluate.false_positive_rate(five))
    assert got == {"fpr": pytest.approx(1 / 3), "tpr": 0.5, "fpr_at_target_tpr": None}


def test_precision_at_k_merges_cut_ks(spark):
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(TRUE, [0.9, 0.8, 0.7, 0.6, 0.5]))]
    scores = spark.createDataFrame(rows, "id int, y_true int, score double")
    assert metrics(evaluate.precision_at_k(scores)) == {"precision@1": 0.0, "precision@5": 0.4}


def test_recall_and_volume(five):
    got = {r.type: r for r in evaluate.recall_by_type(five, ["safe", "vulnerable"]).collect()}
    assert (got["vulnerable"].true_positives, got["vulnerable"].false_negatives) == (1, 1)
    volume = {r.type: (r["count"], r.percentage) for r in evaluate.alert_volume(five).collect()}
    assert volume == {"type_0": (3, pytest.approx(60.0)), "type_1": (2, pytest.approx(40.0))}
    assert evaluate.workload(five).first().workload_score == 0
    assert evaluate.workload(five, {"type_1": 2.5}).first().workload_score == 8.0
    assert evaluate.alert_density(five).first()[0] == 1000
    assert evaluate.alert_density(five.where("false")).first()[0] == 0


def brute_curve(y, s):
    """(threshold, fps, tps) by falling distinct score."""
    return [(t, sum(1 for a, b in zip(y, s) if b >= t and a == 0), sum(1 for a, b in zip(y, s) if b >= t and a == 1))
            for t in sorted(set(s), reverse=True)]


@pytest.mark.parametrize("tied", [False, True])
def test_curves_equal_brute_force(spark, tied):
    rng = np.random.default_rng(11)
    n = 400
    # With ties, a third of all rows share one score.
    s = [0.5 if tied and i % 3 == 0 else float(v) for i, v in enumerate(rng.integers(0, 90, n) / 100)]
    y = [int(v) for v in rng.random(n) < 0.4]
    scores = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, s))], "id int, y_true int, score double")
    points = brute_curve(y, s)
    p, q = sum(y), n - sum(y)
    pairs = [(a > b) + 0.5 * (a == b) for a, t in zip(s, y) if t for b, u in zip(s, y) if not u]
    assert evaluate.roc_auc(scores).first().auc == pytest.approx(sum(pairs) / len(pairs))
    ap, before = 0.0, 0
    for _, fps, tps in points:
        ap += (tps - before) / p * tps / (tps + fps)
        before = tps
    assert evaluate.average_precision(scores).first().average_precision == pytest.approx(ap)
    fps, tps = np.array([x[1] for x in points]), np.array([x[2] for x in points])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    want = [(np.inf, 0.0, 0.0)] + [(points[i][0], fps[i] / q, tps[i] / p) for i in np.flatnonzero(keep)]
    got = sorted((tuple(r) for r in evaluate.roc_curve(scores).collect()), reverse=True)
    assert np.allclose(np.array(got)[1:], np.array(want)[1:]) and got[0] == want[0]
    pr = [tuple(r) for r in evaluate.pr_curve(scores).collect()]
    assert (None, 1.0, 0.0) in pr and len(pr) == len(points) + 1
    for threshold, fp, tp in points:
        assert any(r[0] == threshold and r[1] == pytest.approx(tp / (tp + fp)) and r[2] == pytest.approx(tp / p) for r in pr if r[0] is not None)


def test_one_vs_rest_areas(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 120)
    proba = rng.dirichlet([1, 1, 1], 120)
    rows = [(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(y, proba))]
    got = metrics(evaluate.auc_one_vs_rest(spark.createDataFrame(rows, "id int, y_true int, proba array<double>")))
    areas = []
    for k in range(3):
        hit, miss = proba[y == k, k], proba[y != k, k]
        areas.append(np.mean((hit[:, None] > miss) + 0.5 * (hit[:, None] == miss)))
    assert got["auc_macro"] == pytest.approx(np.mean(areas))
    assert got["auc_weighted"] == pytest.approx(np.average(areas, weights=np.bincount(y)))


def test_leaderboard_orders_and_falls_back(spark):
    rows = [("a", "accuracy", 0.5), ("a", "auc_macro", 0.9), ("b", "accuracy", 0.8), ("b", "auc", 0.1), ("b", "auc_macro", 1.0)]
    board = evaluate.leaderboard(spark.createDataFrame(rows, "model string, metric string, value double")).collect()
    assert [(r.model, round(r.weighted_score, 6)) for r in board] == [("a", 0.33), ("b", 0.26)]


def test_noise_is_standard_normal_and_repeatable(spark):
    from pyspark.sql import functions as F

    draws = spark.range(20000).select(evaluate.gaussian(1, F.col("id")).alias("z"))
    a = [r.z for r in draws.collect()]
    b = [r.z for r in draws.repartition(3).collect()]
    assert abs(np.mean(a)) < 0.03 and abs(np.std(a) - 1) < 0.03 and sorted(a) == sorted(b)
