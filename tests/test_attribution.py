"""Exact tree attributions against all subsets of features."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweave.operators import attribution, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(300):
        x = [round(rng.gauss(0, 1), 1) for _ in range(4)]
        data.append((i, x, int(x[0] * x[1] > 0.2) + int(x[2] > 0.8) * (rng.random() < 0.8)))
    frame = spark.createDataFrame(data, "id long, x array<double>, label int")
    return frame.select("id", array_to_vector("x").alias("features"), "label").repartition(3).cache()


def expectation(paths, x, known):
    """The ensemble's mean over the fitted rows when only the features in ``known`` are given."""
    total = 0.0
    for leaf in range(len(paths.value)):
        p = paths.value[leaf]
        for j in range(paths.feature.shape[1]):
            f, low, high = paths.feature[leaf, j], paths.low[leaf, j], paths.high[leaf, j]
            if math.isinf(low) and math.isinf(high):
                continue
            p *= float(low < x[f] <= high) if f in known else paths.share[leaf, j]
        total += p
    return total


def by_subsets(paths, x):
    n, out = len(x), []
    for f in range(n):
        rest, value = [j for j in range(n) if j != f], 0.0
        for size in range(n):
            for s in itertools.combinations(rest, size):
                weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                value += weight * (expectation(paths, x, {*s, f}) - expectation(paths, x, set(s)))
        out.append(value)
    return out


CASES = [
    ("random_forest", {"n_estimators": 7, "max_depth": 5}, 1),
    ("random_forest", {"n_estimators": 3, "max_depth": 3}, 2),
    ("gradient_boosting", {"n_estimators": 4, "max_depth": 3}, 1),
]


@pytest.mark.parametrize("kind, config, k", CASES)
def test_tree_values_equal_all_subsets_and_add_up(spark, rows, kind, config, k):
    detector = models.VulnerabilityDetector(kind, config).fit(rows)
    paths = attribution.tree_paths(detector, spark, k)
    explained = attribution.tree_attribution(detector, rows, k)
    got = {r.id: r for r in explained.join(attribution.raw_output(detector, rows, k), "id").collect()}
    assert len(got) == 300
    assert all(abs(r.base_value + sum(r.shap_values) - r.raw) < 1e-9 for r in got.values())
    vectors = {r.id: r.features.toArray() for r in rows.collect()}
    for i in range(0, 300, 30):
        assert np.allclose(got[i].shap_values, by_subsets(paths, vectors[i]), atol=1e-12)


def test_parts_of_an_ensemble_add_up_and_batches_are_exact(spark, rows, monkeypatch):
    detector = models.VulnerabilityDetector("random_forest", {"n_estimators": 5, "max_depth": 4}).fit(rows)
    whole = {r.id: r.shap_values for r in attribution.tree_attribution(detector, rows).collect()}
    monkeypatch.setattr(attribution, "LEAVES", 7)
    monkeypatch.setattr(attribution, "CELLS", 50)
    parts = {r.id: r.shap_values for r in attribution.tree_attribution(detector, rows).collect()}
    assert all(np.allclose(whole[i], parts[i], atol=1e-12) for i in whole)
    batch = attribution.explain_batch(detector, rows, max_samples=4).collect()
    assert sorted(r.id for r in batch) == [0, 1, 2, 3] and all(np.allclose(r.shap_values, whole[r.id]) for r in batch)


def test_not_a_number_goes_right_and_nothing_gives_nothing(spark, rows):
    detector = models.VulnerabilityDetector("random_forest", {"n_estimators": 5, "max_depth": 4}).fit(rows)
    odd = spark.createDataFrame([(1, [float("nan"), 0.0, float("inf"), float("-inf")], 0)], "id long, x array<double>, label int")
    odd = odd.select("id", array_to_vector("x").alias("features"), "label")
    row = attribution.tree_attribution(detector, odd).join(attribution.raw_output(detector, odd), "id").first()
    assert abs(row.base_value + sum(row.shap_values) - row.raw) < 1e-9
    assert attribution.tree_attribution(detector, rows.where(F.lit(False))).collect() == []


def test_one_class_has_one_leaf(spark, rows):
    detector = models.VulnerabilityDetector("random_forest", {"n_estimators": 2, "max_depth": 2}).fit(rows.withColumn("label", F.lit(3)))
    row = attribution.tree_attribution(detector, rows).first()
    assert set(row.shap_values) == {0.0} and row.base_value == 1.0
