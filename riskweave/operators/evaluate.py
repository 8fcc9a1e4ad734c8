"""Evaluation: every score from counts that one grouping makes small.

``by`` names columns such as a model name; each measure is then taken per value in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.operators.ranks import running_sums

# Default cut-offs, target rate, noise levels, leaderboard weights.
PRECISION_KS = (1, 5, 10, 20)
TARGET_TPR = 0.95
EPSILONS = (0.01, 0.05, 0.1, 0.2)
METRIC_WEIGHTS = {"accuracy": 0.3, "f1_macro": 0.3, "precision@5": 0.2, "auc": 0.2}
LEADERBOARD_METRICS = (
    "accuracy", "f1_macro", "precision_macro", "recall_macro", "auc",
    "precision@1", "precision@5", "precision@10",
)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_name(label: Column, names=None, prefix: str = "class_") -> Column:
    fallback = F.concat(F.lit(prefix), label.cast("string"))
    if not names:
        return fallback
    listed = F.array(*[F.lit(n) for n in names])
    return F.when(label < len(names), F.get(listed, label.cast("int"))).otherwise(fallback)


def confusion(preds: DataFrame, by=()) -> DataFrame:
    return preds.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def class_counts(preds: DataFrame, by=()) -> DataFrame:
    """Per label of either side: hits, true support, predictions, and the scores from them."""
    sides = confusion(preds, by).select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("y_true").alias("label"),
                    F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                ),
                F.struct(
                    F.col("y_pred").alias("label"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                ),
            )
        ),
    )
    counts = sides.groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return counts.withColumns(
        {
            "precision": _ratio(tp, predicted),
            "recall": _ratio(tp, support),
            "f1": _ratio(tp * 2, support + predicted),
        }
    )


def overall(preds: DataFrame, by=()) -> DataFrame:
    """``metric, value``: accuracy and the macro and weighted averages."""
    measures = [_ratio(F.sum("tp"), F.sum("support")).alias("accuracy")]
    for score in ("precision", "recall", "f1"):
        measures.append(F.avg(score).alias(f"{score}_macro"))
    for score in ("precision", "recall", "f1"):
        measures.append(_ratio(F.sum(F.col(score) * F.col("support")), F.sum("support")).alias(f"{score}_weighted"))
    names = ["accuracy"] + [f"{s}_{k}" for k in ("macro", "weighted") for s in ("precision", "recall", "f1")]
    wide = class_counts(preds, by).groupBy(*by).agg(*measures)
    return wide.select(
        *by, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]))
    )


def per_class(preds: DataFrame, names=None, by=()) -> DataFrame:
    """Scores of the labels that occur as truth."""
    return class_counts(preds, by).where("support > 0").select(
        *by, class_name(F.col("label"), names).alias("class"), "precision", "recall", "f1"
    )


def confusion_matrix(preds: DataFrame, by=()) -> DataFrame:
    """Every (true, predicted) pair of occurring labels with its count, zeros included."""
    counts = confusion(preds, by)
    labels = counts.groupBy(*by).agg(
        F.array_union(F.collect_set("y_true"), F.collect_set("y_pred")).alias("labels")
    )
    # A grid of classes by classes; rows of data play no part in its size.
    grid = labels.withColumn("y_true", F.explode("labels")).select(*by, "y_true", F.explode("labels").alias("y_pred"))
    return grid.join(counts, [*by, "y_true", "y_pred"], "left").na.fill(0, ["n"])


def confusion_pivot(preds: DataFrame, labels) -> DataFrame:
    """The matrix view: a row per true label, a column per predicted one."""
    wide = confusion_matrix(preds).groupBy("y_true").pivot("y_pred", list(labels)).agg(F.sum("n"))
    return wide.select("y_true", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"pred_{k}") for k in labels])


def report(preds: DataFrame, names=None) -> DataFrame:
    """``class, precision, recall, f1, support`` with the averages as rows of their own."""
    counts = class_counts(preds)
    total = F.sum("support")
    averages = counts.agg(
        _ratio(F.sum("tp"), total).alias("accuracy"),
        *[F.avg(s).alias(f"m_{s}") for s in ("precision", "recall", "f1")],
        *[_ratio(F.sum(F.col(s) * F.col("support")), total).alias(f"w_{s}") for s in ("precision", "recall", "f1")],
        total.alias("total"),
    )
    parts = {
        "accuracy": ["accuracy"] * 3,
        "macro avg": ["m_precision", "m_recall", "m_f1"],
        "weighted avg": ["w_precision", "w_recall", "w_f1"],
    }
    averages = averages.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("class"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                        F.col(f).alias("f1"), F.col("total").alias("support"),
                    )
                    for name, (p, r, f) in parts.items()
                ]
            )
        )
    )
    plain = F.col("label").cast("string") if not names else class_name(F.col("label"), names)
    rows = counts.select(plain.alias("class"), "precision", "recall", "f1", "support")
    return rows.unionByName(averages)


def _curve(scores: DataFrame, by=()) -> DataFrame:
    """Running true and false positives by falling score: one row per distinct score."""
    positive = F.col("y_true") == 1
    return running_sums(
        scores.select(*by, (-F.col("score")).alias("below"), "y_true"),
        by,
        "below",
        {
            "pos": F.count_if(positive),
            "neg": F.count_if(~positive),
        },
    ).withColumn("threshold", -F.col("below"))


def roc_auc(scores: DataFrame, by=()) -> DataFrame:
    """Exact area under the ROC curve; ties count half."""
    area = F.sum(F.col("neg") * (F.col("pos_upto") - F.col("pos") / 2.0))
    cells = F.max("pos_total").cast("double") * F.max("neg_total")
    return _curve(scores, by).groupBy(*by).agg(F.try_divide(area, cells).alias("auc"))


def average_precision(scores: DataFrame, by=()) -> DataFrame:
    step = F.col("pos") / F.col("pos_total") * (F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto")))
    return _curve(scores, by).where("pos > 0").groupBy(*by).agg(F.sum(step).alias("average_precision"))


def roc_curve(scores: DataFrame, by=()) -> DataFrame:
    """``threshold, fpr, tpr`` from (0, 0) at infinity; points inside a straight run are left out."""
    points = _curve(scores, by)
    first = (F.col("pos_upto") == F.col("pos")) & (F.col("neg_upto") == F.col("neg"))
    last = F.col("pos_next").isNull()
    bends = (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg"))
    kept = points.where(first | last | bends).select(
        *by, "threshold",
        F.try_divide(F.col("neg_upto"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("pos_upto"), F.col("pos_total")).alias("tpr"),
    )
    start = scores.select(*by).distinct() if by else scores.sparkSession.range(1).select()
    origin = start.select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(kept)


def pr_curve(scores: DataFrame, by=()) -> DataFrame:
    """``threshold, precision, recall``; the closing point (1, 0) has no threshold."""
    points = _curve(scores, by).select(
        *by, "threshold",
        (F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))).alias("precision"),
        F.coalesce(F.try_divide(F.col("pos_upto"), F.col("pos_total")), F.lit(1.0)).alias("recall"),
    )
    start = scores.select(*by).distinct() if by else scores.sparkSession.range(1).select()
    end = start.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def one_vs_rest(preds: DataFrame, by=()) -> DataFrame:
    """A binary score row per (row, class) from ``proba``."""
    return preds.select(*by, F.col("y_true").alias("_truth"), F.posexplode("proba").alias("label", "score")).select(
        *by, "label", (F.col("_truth") == F.col("label")).cast("int").alias("y_true"), "score"
    )


def auc_one_vs_rest(preds: DataFrame, by=()) -> DataFrame:
    """``metric, value``: the mean of the class areas, plain and weighted by prevalence."""
    areas = roc_auc(one_vs_rest(preds, by), [*by, "label"])
    support = preds.groupBy(*by, F.col("y_true").cast("int").alias("label")).agg(F.count("*").alias("support"))
    joined = areas.join(F.broadcast(support), [*by, "label"])
    wide = joined.groupBy(*by).agg(
        F.avg("auc").alias("auc_macro"),
        (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc_weighted"),
    )
    return wide.select(
        *by,
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auc_macro", "auc_weighted")])),
    )


def precision_at_k(scores: DataFrame, ks=PRECISION_KS, id_col: str = "id") -> DataFrame:
    """``k, precision`` over the best scores; k beyond the rows is cut to them, once.

    Only the best ``max(ks)`` rows ever meet in one task.
    """
    best = scores.orderBy(F.desc("score"), F.desc(id_col)).limit(max(ks)).select("score", id_col, "y_true")
    place = Window.orderBy(F.desc("score"), F.desc(id_col))
    ranked = best.withColumns({"place": F.row_number().over(place), "n": F.count("*").over(Window.partitionBy())})
    cut = F.explode(F.array_distinct(F.array(*[F.least(F.lit(k), F.col("n").cast("int")) for k in ks])))
    return (
        ranked.select("place", "y_true", cut.alias("k"))
        .where("place <= k")
        .groupBy("k")
        .agg((F.sum("y_true") / F.first("k")).alias("precision"))
        .select(F.concat(F.lit("precision@"), F.col("k").cast("string")).alias("metric"), F.col("precision").alias("value"))
    )


def precision_at_k_by(scores: DataFrame, by, ks=PRECISION_KS, id_col: str = "id") -> DataFrame:
    """``precision_at_k`` per value of ``by``; salted parts keep a large model in many tasks."""
    from riskweave.operators.ranks import top_per_group

    order = [F.desc("score"), F.desc(id_col)]
    best = top_per_group(scores, by, order, max(ks), id_col)
    whole = Window.partitionBy(*by)
    ranked = best.withColumns(
        {"place": F.row_number().over(whole.orderBy(*order)), "n": F.count("*").over(whole)}
    )
    cut = F.explode(F.array_distinct(F.array(*[F.least(F.lit(k), F.col("n").cast("int")) for k in ks])))
    return (
        ranked.select(*by, "place", "y_true", cut.alias("k"))
        .where("place <= k")
        .groupBy(*by, "k")
        .agg((F.sum("y_true") / F.first("k")).alias("value"))
        .select(*by, F.concat(F.lit("precision@"), F.col("k").cast("string")).alias("metric"), "value")
    )


def recall_by_type(preds: DataFrame, names=None) -> DataFrame:
    hit = F.col("y_true") == F.col("y_pred")
    counts = preds.groupBy("y_true").agg(
        F.count_if(hit).alias("true_positives"), F.count_if(~hit).alias("false_negatives"),
        F.count("*").alias("total_samples"),
    )
    return counts.select(
        class_name(F.col("y_true"), names, "type_").alias("type"),
        _ratio(F.col("true_positives"), F.col("total_samples")).alias("recall"),
        "true_positives", "false_negatives", "total_samples",
    )


def false_positive_rate(preds: DataFrame, target_tpr: float = TARGET_TPR) -> DataFrame:
    """``metric, value``: rates of the higher of two labels, or mean and spread over classes."""
    # Windows over one row per class.
    every = Window.partitionBy()
    counts = class_counts(preds).withColumns(
        {"total": F.sum("support").over(every), "classes": F.count("*").over(every)}
    )
    rates = counts.withColumn("fpr", _ratio(F.col("predicted") - F.col("tp"), F.col("total") - F.col("support")))
    wide = rates.agg(
        F.max("classes").alias("classes"),
        F.max_by("fpr", "label").alias("fpr"),
        F.max_by("recall", "label").alias("tpr"),
        F.avg("fpr").alias("fpr_macro"),
        F.stddev_pop("fpr").alias("fpr_std"),
    )
    row = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("value"))
    return wide.select(
        F.inline(
            F.when(
                F.col("classes") == 2,
                F.array(
                    row("fpr", F.col("fpr")), row("tpr", F.col("tpr")),
                    row("fpr_at_target_tpr", F.when(F.col("tpr") >= target_tpr, F.col("fpr"))),
                ),
            ).otherwise(F.array(row("fpr_macro", F.col("fpr_macro")), row("fpr_std", F.col("fpr_std"))))
        )
    )


def alert_volume(preds: DataFrame, names=None) -> DataFrame:
    """``type, count, percentage`` of the predicted labels."""
    counts = preds.groupBy("y_pred").agg(F.count("*").alias("count"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy()) * 100
    return counts.select(
        class_name(F.col("y_pred"), names, "type_").alias("type"), "count", share.alias("percentage")
    )


def workload(preds: DataFrame, weights: dict | None = None, names=None) -> DataFrame:
    """Predictions weighted by type (1.0 where none is given); zero when no weights are given."""
    counts = alert_volume(preds, names)
    if not weights:
        return counts.agg(F.sum("count").alias("total_alerts"), F.lit(0.0).alias("workload_score"))
    weight = F.coalesce(*[F.when(F.col("type") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(1.0))
    return counts.agg(
        F.sum("count").alias("total_alerts"), F.sum(F.col("count") * weight).alias("workload_score")
    )


def alert_density(preds: DataFrame) -> DataFrame:
    """Alerts per thousand as defined over predictions alone: 1000, or 0 without any."""
    n = F.count("*")
    return preds.agg((n / F.greatest(n, F.lit(1)) * 1000).alias("alerts_per_1000_lines"))


def finding_density(scanned: DataFrame) -> DataFrame:
    """Findings per thousand lines from rows with ``n_findings`` and ``line_count``."""
    return scanned.agg(
        F.sum("n_findings").alias("findings"),
        F.sum("line_count").alias("lines"),
        F.try_divide(F.sum("n_findings") * 1000.0, F.sum("line_count")).alias("findings_per_1000_lines"),
    )


def gaussian(seed, *cols) -> Column:
    """A standard normal draw fixed by the seed and the columns, so a retried task repeats it."""
    def unit(salt):
        bits = F.pmod(F.xxhash64(F.lit(f"{seed}|{salt}"), *cols), F.lit(2**52))
        return (bits + 0.5) / float(2**52)

    return F.sqrt(-2.0 * F.log(unit("radius"))) * F.cos(2.0 * F.pi() * unit("angle"))


def robustness(model, rows: DataFrame, epsilons=EPSILONS, seed=42, id_col: str = "id") -> DataFrame:
    """Accuracy under normal noise on every feature, for each noise level, in one pass."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    levels = F.explode(F.array(*[F.lit(float(e)) for e in (0.0, *epsilons)])).alias("epsilon")
    noisy = rows.select(
        id_col, "label", vector_to_array("features").alias("_x"), levels
    ).withColumn(
        "_x",
        F.transform(
            "_x",
            lambda x, i: x + F.col("epsilon") * gaussian(seed, F.col(id_col), F.col("epsilon"), i),
        ),
    ).select("label", "epsilon", array_to_vector("_x").alias("features"))
    scored = model.transform(noisy)
    accuracy = scored.groupBy("epsilon").agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")
    )
    # One row per noise level; level zero is the baseline.
    clean = F.max(F.when(F.col("epsilon") == 0, F.col("accuracy"))).over(Window.partitionBy())
    return accuracy.withColumn("baseline_accuracy", clean).where("epsilon > 0").select(
        "epsilon", "baseline_accuracy", "accuracy",
        (F.col("baseline_accuracy") - F.col("accuracy")).alias("accuracy_drop"),
        _ratio(F.col("accuracy"), F.col("baseline_accuracy")).alias("robustness_ratio"),
    )


def leaderboard(metrics: DataFrame, weights: dict | None = None) -> DataFrame:
    """``model, metric, value`` rows as one row per model, best weighted score first."""
    weights = METRIC_WEIGHTS if weights is None else weights
    wanted = list(dict.fromkeys([*LEADERBOARD_METRICS, "auc_macro"]))
    wide = metrics.groupBy("model").pivot("metric", wanted).agg(F.first("value"))
    wide = wide.withColumn("auc", F.coalesce("auc", "auc_macro")).na.fill(0.0, list(LEADERBOARD_METRICS))
    score = F.lit(0.0)
    for metric, weight in weights.items():
        if metric in LEADERBOARD_METRICS:
            score = score + F.col(f"`{metric}`") * F.lit(float(weight))
    columns = [F.col(f"`{m}`") for m in LEADERBOARD_METRICS]
    return wide.select("model", *columns, score.alias("weighted_score")).orderBy(F.desc("weighted_score"), "model")


def summary_report(metrics: DataFrame, timestamp: str | None = None) -> DataFrame:
    """One row: when, how many groups of measures, and the key measures.

    ``metrics`` holds ``section, metric, value``.
    """
    pick = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    at = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return metrics.agg(
        F.count_distinct("section").alias("total_metrics"),
        F.coalesce(pick("accuracy"), F.lit(0.0)).alias("accuracy"),
        F.coalesce(pick("f1_macro"), F.lit(0.0)).alias("f1_macro"),
        F.coalesce(pick("auc"), pick("auc_macro"), F.lit(0.0)).alias("auc"),
    ).select(at.alias("evaluation_timestamp"), "*")


def top_features(importance: DataFrame, k: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def comparison_grid(metrics: DataFrame, names) -> DataFrame:
    """Models by measures, zero where a model lacks one."""
    wide = metrics.groupBy("model").pivot("metric", list(names)).agg(F.first("value"))
    return wide.na.fill(0.0, list(names))


def ranking_summary(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.count("*").alias("total_ranked"), F.avg("priority_confidence").alias("avg_confidence"))
