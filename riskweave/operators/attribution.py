"""Per-row attributions (Shapley values) of a fitted detector.

Linear models and tree ensembles are solved exactly, other models by sampled feature orders.

For a tree, the value of a set of features is the expectation of the tree when only they are known: a split on
another feature sends the row both ways, in the shares of the rows it was fitted on.  A leaf whose path splits on d
features then adds, for feature f of them,

    value * (o_f - z_f) * integral over u from 0 to 1 of the product over the others of z_j (1 - u) + o_j u

where z_j is the share that passes the path's splits on feature j and o_j says whether the row itself passes them.  The
integrand is a polynomial of degree d - 1, so a Gauss-Legendre rule of d // 2 + 1 points is exact, and the sum over
all subsets costs no more than the path is long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.evaluate import gaussian
from riskweave.session import scratch_dir

# Features kept per row, rows per batch, background rows, explained class.
TOP_FEATURES = 10
MAX_SAMPLES = 10
BACKGROUND_ROWS = 100
POSITIVE_CLASS = 1
# Leaves that one pass over the rows holds, and cells of rows by leaves by features worked on at a time.
LEAVES = 50_000
CELLS = 1_000_000


def _result(values: DataFrame, names) -> DataFrame:
    """``id, shap_values, feature_importance`` (strongest first), ``base_value``, ``prediction``."""
    named = F.zip_with(
        F.array(*[F.lit(n) for n in names]), "shap_values", lambda n, v: F.struct(-F.abs(v), n.alias("name"), v.alias("v"))
    )
    top = F.transform(F.slice(F.array_sort(named), 1, TOP_FEATURES), lambda s: F.struct(s["name"], s["v"]))
    return values.withColumn("feature_importance", F.map_from_entries(top)).select(
        "id", "shap_values", "feature_importance", "base_value", "prediction"
    )


def linear_attribution(detector, rows: DataFrame, means, class_index: int = POSITIVE_CLASS) -> DataFrame:
    """Exact values for a linear model: weight times distance from the mean, on the class margin."""
    model = detector.models[0]
    k = min(class_index, model.coefficientMatrix.numRows - 1)
    weights = [float(w) for w in model.coefficientMatrix.toArray()[k]]
    means = [float(m) for m in means]
    base = float(model.interceptVector[k]) + sum(w * m for w, m in zip(weights, means))
    w, m = F.array(*[F.lit(x) for x in weights]), F.array(*[F.lit(x) for x in means])
    distance = F.zip_with(vector_to_array("features"), m, lambda x, mean: x - mean)
    values = detector.transform(rows).withColumns(
        {"shap_values": F.zip_with(distance, w, lambda d, weight: d * weight), "base_value": F.lit(base)}
    )
    return _result(values, detector.feature_names)


@dataclass
class Paths:
    """Leaves of an ensemble by the intervals that their paths set, padded to one number of features."""

    feature: np.ndarray  # leaves x d; padding is feature 0 without bounds
    low: np.ndarray  # passes if above
    high: np.ndarray  # passes if not above
    share: np.ndarray  # of the fitted rows that pass the path's splits on the feature; 1 for padding
    value: np.ndarray  # leaves

    @property
    def base(self) -> float:
        """Expectation over the fitted rows."""
        return float((self.value * self.share.prod(axis=1)).sum())

    def part(self, a: int, b: int) -> Paths:
        return Paths(self.feature[a:b], self.low[a:b], self.high[a:b], self.share[a:b], self.value[a:b])

    def passes(self, x: np.ndarray) -> np.ndarray:
        """rows x leaves x d; what is not a number goes right, as in the trees."""
        cell = x[:, self.feature]
        return ~((cell <= self.low) & np.isfinite(self.low)) & ((cell <= self.high) | ~np.isfinite(self.high))

    def values(self, x: np.ndarray) -> np.ndarray:
        """Shapley values, rows x features."""
        n_rows, width = x.shape
        out = np.zeros((n_rows, width))
        if not self.feature.size:
            return out
        d = self.feature.shape[1]
        points, weights = np.polynomial.legendre.leggauss(d // 2 + 1)
        points, weights = (points + 1) / 2, weights / 2
        order = np.argsort(self.feature.ravel(), kind="stable")
        met, first = np.unique(self.feature.ravel()[order], return_index=True)
        step = max(1, CELLS // self.feature.size)
        for a in range(0, n_rows, step):
            o = self.passes(x[a : a + step]).astype(np.float64)
            total = np.zeros_like(o)
            for u, w in zip(points, weights):
                factor = self.share * (1 - u) + o * u
                total += w * factor.prod(axis=2, keepdims=True) / factor
            total *= (o - self.share) * self.value[:, None]
            flat = total.reshape(len(o), -1)[:, order]
            out[a : a + step, met] = np.add.reduceat(flat, first, axis=1)
        return out


def _tree_paths(nodes: list, weight: float, leaf_value) -> list[tuple[dict, float]]:
    """``({feature: (low, high, share)}, value)`` of each leaf of one tree."""
    by_id = {n["id"]: n for n in nodes}
    out, stack = [], [(by_id[0], {})]
    while stack:
        node, path = stack.pop()
        if node["leftChild"] < 0:
            out.append((path, weight * leaf_value(node)))
            continue
        if node["split"]["numCategories"] != -1:
            raise ValueError("a split on categories has no interval")
        f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((by_id[node["leftChild"]], (low, min(high, cut))), (by_id[node["rightChild"]], (max(low, cut), high))):
            stack.append((child, {**path, f: (*bounds, share * child["rawCount"] / node["rawCount"])}))
    return out


def tree_paths(detector, spark: SparkSession, class_index: int = POSITIVE_CLASS) -> Paths:
    """Leaves of a fitted forest (value: the class's share of a vote) or boosted ensemble (value: its part of the margin).

    The trees are the fitted model's own, which the driver holds; they are read back from its saved form.
    """
    k = min(class_index, len(detector.classes) - 1)
    if detector.softmax:
        return _padded([({}, float(detector.softmax.prior[k])), *(leaf for r in detector.softmax.rounds for leaf in _round_paths(r, k))])
    boosted = detector.model_type == "gradient_boosting"
    model = detector.models[k if boosted and len(detector.models) > 1 else 0]
    path = scratch_dir(spark, "trees")
    model.write().save(path)
    trees: dict[int, list] = {}
    for row in spark.read.parquet(f"{path}/data").toLocalIterator():
        trees.setdefault(row["treeID"], []).append(row["nodeData"].asDict(recursive=True))
    weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)

    def leaf_value(node):
        stats = node["impurityStats"]
        return node["prediction"] if boosted else stats[k] / sum(stats)

    leaves = [leaf for t, nodes in sorted(trees.items()) for leaf in _tree_paths(nodes, weights[t], leaf_value)]
    return _padded(leaves)


def _round_paths(r, k: int) -> list[tuple[dict, float]]:
    """Leaves of class ``k``'s tree of one round of boosting under a softmax loss."""
    out, stack = [], [(k, {})]
    while stack:
        node, path = stack.pop()
        f, cut, left = r.feature[node], r.threshold[node], r.left[node]
        if f < 0:
            out.append((path, r.value[node]))
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((left, (low, min(high, cut))), (left + 1, (max(low, cut), high))):
            stack.append((child, {**path, f: (*bounds, share * r.rows[child] / r.rows[node])}))
    return out


def _padded(leaves: list[tuple[dict, float]]) -> Paths:
    d = max(1, max(len(path) for path, _ in leaves))
    feature, low, high = np.zeros((len(leaves), d), np.int64), np.full((len(leaves), d), -np.inf), np.full((len(leaves), d), np.inf)
    share = np.ones((len(leaves), d))
    for i, (path_, _) in enumerate(leaves):
        for j, (f, (a, b, z)) in enumerate(path_.items()):
            feature[i, j], low[i, j], high[i, j], share[i, j] = f, a, b, z
    return Paths(feature, low, high, share, np.array([v for _, v in leaves]))


def _values_udf(held):
    def run(column: pa.Array) -> pa.Array:
        n = len(column)
        if not n:
            return pa.array([], pa.list_(pa.float64()))
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        found = held.value.values(x)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(found.ravel()))

    return F.arrow_udf(run, "array<double>").asNondeterministic()


def tree_attribution(detector, rows: DataFrame, class_index: int = POSITIVE_CLASS) -> DataFrame:
    """Exact values for forests (of the class's probability) and boosted trees (of the class's raw margin).

    ``base_value`` plus a row's values is that probability or margin.  A map over rows of any number; an ensemble of
    more than ``LEAVES`` leaves is broadcast in parts, whose values add up.
    """
    spark = rows.sparkSession
    paths = tree_paths(detector, spark, class_index)
    scored = detector.transform(rows).withColumn("_x", vector_to_array("features"))
    total = None
    for a in range(0, len(paths.value), LEAVES):
        found = _values_udf(spark.sparkContext.broadcast(paths.part(a, a + LEAVES)))(F.col("_x"))
        total = found if total is None else F.zip_with(total, found, lambda v, w: v + w)
    values = scored.withColumns({"shap_values": total, "base_value": F.lit(paths.base)})
    return _result(values, detector.feature_names)


def raw_output(detector, rows: DataFrame, class_index: int = POSITIVE_CLASS) -> DataFrame:
    """``id, raw``: what tree attributions add up to, by the model itself."""
    k = min(class_index, len(detector.classes) - 1)
    if detector.softmax:
        return rows.select("id", detector.softmax.margins(rows.sparkSession, "features")[k].alias("raw"))
    if detector.model_type != "gradient_boosting":
        return detector.transform(rows).select("id", F.get(F.col("proba"), F.lit(k)).alias("raw"))
    model = detector.models[k if len(detector.models) > 1 else 0].copy().setRawPredictionCol("_raw")
    return model.transform(rows.select("id", "features")).select("id", vector_to_array("_raw")[1].alias("raw"))


def normal_background(spark: SparkSession, width: int, rows: int = BACKGROUND_ROWS, seed=42) -> DataFrame:
    """``b, z``: standard normal rows."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: gaussian(seed, F.col("id"), j))
    return spark.range(rows).select(F.col("id").alias("b"), cells.alias("z"))


def sampled_attribution(
    detector, rows: DataFrame, background: DataFrame, seed=42, class_index: int = POSITIVE_CLASS
) -> DataFrame:
    """Sampled values for any model: one random feature order per background row.

    Each (row, background row) walks from the background to the row one feature at a time;
    a feature's value is the mean change of the class probability at its step.  All steps are
    scored in one pass of the model.  ``background`` is a fixed small sample (``b, z``).
    """
    width = len(detector.feature_names)
    k = min(class_index, len(detector.classes) - 1)
    every = F.sequence(F.lit(0), F.lit(width - 1))
    x = rows.select("id", vector_to_array("features").alias("x"))
    pairs = x.crossJoin(F.broadcast(background))
    order = F.transform(
        F.array_sort(F.transform(every, lambda j: F.struct(F.xxhash64(F.lit(seed), F.col("id"), F.col("b"), j), j.alias("j")))),
        lambda s: s["j"],
    )
    # Each feature's step, once per pair: the order turned round.
    turned = F.transform(
        F.array_sort(F.transform("order", lambda j, i: F.struct(j.alias("j"), (i + 1).alias("at")))), lambda s: s["at"]
    )
    ordered = pairs.withColumn("order", order).withColumn("place", turned)
    steps = ordered.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    mixed = F.transform("x", lambda v, i: F.when(F.get(F.col("place"), i) <= F.col("step"), v).otherwise(F.get(F.col("z"), i)))
    scored = detector.transform(steps.withColumn("features", array_to_vector(mixed)).drop("x", "z", "place"))
    value = F.get(F.col("proba"), F.lit(k))
    # The score after a step counts for that step's feature and against the next one's.
    gains = F.array(
        F.struct(F.get(F.col("order"), F.col("step") - 1).alias("j"), value.alias("gain")),
        F.struct(F.get(F.col("order"), F.col("step")).alias("j"), (-value).alias("gain")),
        F.struct(F.when(F.col("step") == 0, F.lit(-1)).alias("j"), value.alias("gain")),
    )
    n = background.count()
    parts = scored.select("id", "b", F.inline(gains)).where("j is not null")
    means = parts.groupBy("id", "j").agg((F.sum("gain") / n).alias("mean"))
    wide = means.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("j") >= 0, F.struct("j", "mean")))).alias("cells"),
        F.max(F.when(F.col("j") < 0, F.col("mean"))).alias("base_value"),
    )
    labels = detector.transform(rows).select("id", "prediction")
    values = wide.join(labels, "id").withColumn("shap_values", F.transform("cells", lambda c: c["mean"]))
    return _result(values, detector.feature_names)


TREE_MODELS = ("gradient_boosting", "random_forest")


def explain_batch(detector, rows: DataFrame, background: DataFrame | None = None, max_samples: int = MAX_SAMPLES, **options) -> DataFrame:
    """The first ``max_samples`` rows by id: exact for tree models, sampled for others or against a given background."""
    first = rows.orderBy("id").limit(max_samples)
    if background is None and detector.model_type in TREE_MODELS:
        return tree_attribution(detector, first, **options)
    if background is None:
        background = normal_background(rows.sparkSession, len(detector.feature_names))
    return sampled_attribution(detector, first, background, **options)
