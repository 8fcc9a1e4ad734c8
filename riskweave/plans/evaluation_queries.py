"""Queries on evaluation measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import evaluate, features, rules
from riskweave.plans.feature_queries import rounded
from riskweave.plans.golden import literal
from riskweave.plans.oracle import with_findings
from riskweave.plans.registry import query
from riskweave.sources.corpus import corpus_table, table

TYPE_NAMES = ["clean", "good"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def binary(spark, folder, threshold=0.5):
    """``id, y_true, score, y_pred``: quality against a length score."""
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    joined = table(spark, folder, "labels").select("doc_id", "quality").join(documents, "doc_id")
    return joined.select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y_true"),
        (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("score"),
    ).withColumn("y_pred", (F.col("score") >= threshold).cast("int"))


def multiclass(spark, folder):
    """``id, y_true, y_pred, proba``: event type against a banded value."""
    place = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), place.cast("int").alias("y_true"),
        F.least(F.lit(4), F.floor(F.col("value") / 50)).cast("int").alias("y_pred"),
    )
    nearness = [(5 - F.abs(F.lit(k) - F.col("y_pred"))).cast("double") for k in range(5)]
    total = sum(nearness[1:], nearness[0])
    return rows.withColumn("proba", F.array(*[n / total for n in nearness]))


def models(spark, folder):
    """Three score thresholds as three models."""
    cuts = F.explode(F.array(*[F.lit(t) for t in (0.3, 0.5, 0.7)])).alias("cut")
    rows = binary(spark, folder).select("id", "y_true", "score", cuts)
    return rows.select(
        "id", "y_true", "score", F.concat(F.lit("t"), F.format_string("%.1f", "cut")).alias("model"),
        (F.col("score") >= F.col("cut")).cast("int").alias("y_pred"),
    )


_BINARY = """bin AS (
  SELECT l.doc_id AS id, quality AS y_true, n_chars / (n_chars + 2000.0::DOUBLE) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
preds AS (SELECT *, (score >= 0.5::DOUBLE)::INTEGER AS y_pred FROM bin)"""
_NEAR = [f"(5 - abs({k} - y_pred))::DOUBLE" for k in range(5)]
_MULTI = f"""base AS (
  SELECT event_id AS id, (list_position({EVENT_TYPES!r}, event_type) - 1)::INTEGER AS y_true,
    least(4, floor(value / 50))::INTEGER AS y_pred FROM events),
preds AS (SELECT *, list_transform([{', '.join(_NEAR)}], lambda x: x / ({' + '.join(_NEAR)})) AS proba FROM base)"""
_CLASSES = """labels_seen AS (SELECT y_true AS label FROM preds UNION SELECT y_pred FROM preds),
counts AS (
  SELECT label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_true = label) AS support,
    count(*) FILTER (y_pred = label) AS predicted FROM labels_seen, preds GROUP BY label),
scores AS (
  SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
    coalesce(2.0::DOUBLE * tp / nullif(support + predicted, 0), 0) AS f1 FROM counts)"""
_CURVE = """keyed AS (SELECT score, sum((y_true = 1)::INTEGER) AS pos, sum((y_true <> 1)::INTEGER) AS neg FROM bin GROUP BY score),
curve AS (
  SELECT score, pos, neg, sum(pos) OVER o AS tps, sum(neg) OVER o AS fps, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
    lead(pos) OVER o AS next_pos, lead(neg) OVER o AS next_neg, row_number() OVER o AS place FROM keyed WINDOW o AS (ORDER BY score DESC))"""


def _sql(*parts):
    return "WITH " + ", ".join(parts[:-1]) + " " + parts[-1]


def _both(name, select, make, digits=("value",)):
    """The measure on the binary and on the multi-class set."""
    for suffix, source, data in (("", _BINARY, binary), ("_multiclass", _MULTI, multiclass)):
        def run(spark, folder, data=data):
            return rounded(make(data(spark, folder)), digits, 9)

        query(name + suffix, _sql(source, _CLASSES, select))(run)


def _long(metrics):
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, round(({sql})::DOUBLE, 9) AS value FROM scores" for m, sql in metrics.items())


ACCURACY = {"accuracy": "sum(tp)::DOUBLE / sum(support)"}
MACRO = {f"{s}_macro": f"avg({s})" for s in ("precision", "recall", "f1")}
WEIGHTED = {f"{s}_weighted": f"sum({s} * support) / sum(support)" for s in ("precision", "recall", "f1")}


def _overall(names):
    return lambda preds: evaluate.overall(preds).where(F.col("metric").isin(list(names)))


_both("e01_accuracy", _long(ACCURACY), _overall(ACCURACY))
_both("e02_macro_scores", _long(MACRO), _overall(MACRO))
_both("e03_weighted_scores", _long(WEIGHTED), _overall(WEIGHTED))
_PRF = ("precision", "recall", "f1")
_ROUND_PRF = ", ".join(f"round({s}, 9) AS {s}" for s in _PRF)


def _name_sql(column, prefix, names):
    arms = " ".join(f"WHEN {i} THEN {literal(n)}" for i, n in enumerate(names))
    return f"CASE {column} {arms} ELSE '{prefix}' || {column} END"


_both(
    "e04_per_class",
    f"SELECT {_name_sql('label', 'class_', TYPE_NAMES)} AS class, {_ROUND_PRF} FROM scores WHERE support > 0",
    lambda p: evaluate.per_class(p, TYPE_NAMES), _PRF,
)


@query("e05_roc_auc", _sql(_BINARY, _CURVE, "SELECT round((sum(neg * (tps - pos / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)))::DOUBLE, 9) AS auc FROM curve"))
def _(spark, folder):
    return rounded(evaluate.roc_auc(binary(spark, folder)), ["auc"], 9)


@query("e06_average_precision", _sql(_BINARY, _CURVE, "SELECT round(sum(pos::DOUBLE / p * (tps::DOUBLE / (tps + fps))), 9) AS average_precision FROM curve"))
def _(spark, folder):
    return rounded(evaluate.average_precision(binary(spark, folder)), ["average_precision"], 9)


@query(
    "e07_roc_curve",
    _sql(
        _BINARY, _CURVE,
        """SELECT round(score, 9) AS threshold, round(fps::DOUBLE / n, 9) AS fpr, round(tps::DOUBLE / p, 9) AS tpr FROM curve
        WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""",
    ),
)
def _(spark, folder):
    return rounded(evaluate.roc_curve(binary(spark, folder)), ["fpr", "tpr"], 9).withColumn(
        "threshold", F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(F.round("threshold", 9))
    )


@query(
    "e08_pr_curve",
    _sql(
        _BINARY, _CURVE,
        """SELECT round(score, 9) AS threshold, round(tps::DOUBLE / (tps + fps), 9) AS precision, round(tps::DOUBLE / p, 9) AS recall FROM curve
        UNION ALL SELECT NULL, 1.0, 0.0""",
    ),
)
def _(spark, folder):
    return rounded(evaluate.pr_curve(binary(spark, folder)), ["threshold", "precision", "recall"], 9)


_OVR = """long AS (SELECT y_true, unnest([0, 1, 2, 3, 4]) AS label, unnest(proba) AS score FROM preds),
keyed AS (SELECT label, score, sum((y_true = label)::INTEGER) AS pos, sum((y_true <> label)::INTEGER) AS neg FROM long GROUP BY ALL),
ran AS (SELECT *, sum(pos) OVER (PARTITION BY label ORDER BY score DESC) AS tps, sum(pos) OVER (PARTITION BY label) AS p,
  sum(neg) OVER (PARTITION BY label) AS n FROM keyed),
areas AS (SELECT label, max(p) AS support, sum(neg * (tps - pos / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)) AS auc FROM ran GROUP BY label)"""


@query(
    "e09_auc_one_vs_rest",
    _sql(
        _MULTI, _OVR,
        """SELECT 'auc_macro' AS metric, round(avg(auc), 9) AS value FROM areas
        UNION ALL SELECT 'auc_weighted', round(sum(auc * support) / sum(support), 9) FROM areas""",
    ),
)
def _(spark, folder):
    return rounded(evaluate.auc_one_vs_rest(multiclass(spark, folder)), ["value"], 9)


_both(
    "e10_confusion_matrix",
    """SELECT a.label AS y_true, b.label AS y_pred, count(p.y_true) AS n FROM labels_seen a CROSS JOIN labels_seen b
    LEFT JOIN preds p ON p.y_true = a.label AND p.y_pred = b.label GROUP BY ALL""",
    evaluate.confusion_matrix, (),
)


@query(
    "e10b_confusion_pivot",
    _sql(_MULTI, "SELECT y_true, " + ", ".join(f"count(*) FILTER (y_pred = {k}) AS pred_{k}" for k in range(5)) + " FROM preds GROUP BY y_true"),
)
def _(spark, folder):
    return evaluate.confusion_pivot(multiclass(spark, folder), range(5))


_both(
    "e11_classification_report",
    f"""SELECT label::VARCHAR AS class, {_ROUND_PRF}, support FROM scores
    UNION ALL SELECT 'accuracy', round(a, 9), round(a, 9), round(a, 9), n FROM (SELECT sum(tp)::DOUBLE / sum(support) AS a, sum(support)::BIGINT AS n FROM scores)
    UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::BIGINT FROM scores
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
      round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM scores""",
    evaluate.report, _PRF,
)


def _precision_sql(source, by=""):
    partition = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""ranked AS (SELECT {lead}y_true, row_number() OVER ({partition} ORDER BY score DESC, id DESC) AS place, count(*) OVER ({partition}) AS n FROM {source}),
    cuts AS (SELECT DISTINCT {lead}least(k, n)::INTEGER AS k FROM ranked, (VALUES (1), (5), (10), (20)) t(k))
    """


@query(
    "e12_precision_at_k",
    _sql(_BINARY, _precision_sql("preds"), "SELECT 'precision@' || k AS metric, sum(y_true) / k::DOUBLE AS value FROM ranked, cuts WHERE place <= k GROUP BY k"),
)
def _(spark, folder):
    return evaluate.precision_at_k(binary(spark, folder))


_both(
    "e13_recall_by_type",
    f"SELECT {_name_sql('label', 'type_', TYPE_NAMES)} AS type, round(recall, 9) AS recall, tp AS true_positives, support - tp AS false_negatives, support AS total_samples FROM scores WHERE support > 0",
    lambda p: evaluate.recall_by_type(p, TYPE_NAMES), ("recall",),
)
_FPR = "coalesce((predicted - tp)::DOUBLE / nullif((SELECT sum(support) FROM scores) - support, 0), 0)"


@query(
    "e14_false_positive_rate",
    _sql(
        _BINARY, _CLASSES,
        f"""SELECT 'fpr' AS metric, round({_FPR}, 9) AS value FROM scores WHERE label = 1
        UNION ALL SELECT 'tpr', round(recall, 9) FROM scores WHERE label = 1
        UNION ALL SELECT 'fpr_at_target_tpr', round(CASE WHEN recall >= 0.95 THEN {_FPR} END, 9) FROM scores WHERE label = 1""",
    ),
)
def _(spark, folder):
    return rounded(evaluate.false_positive_rate(binary(spark, folder)), ["value"], 9)


@query(
    "e14_false_positive_rate_multiclass",
    _sql(
        _MULTI, _CLASSES,
        f"""SELECT 'fpr_macro' AS metric, round(avg(fpr), 9) AS value FROM (SELECT {_FPR} AS fpr FROM scores)
        UNION ALL SELECT 'fpr_std', round(stddev_pop(fpr), 9) FROM (SELECT {_FPR} AS fpr FROM scores)""",
    ),
)
def _(spark, folder):
    return rounded(evaluate.false_positive_rate(multiclass(spark, folder)), ["value"], 9)


@query(
    "e15_alert_volume",
    _sql(_MULTI, "SELECT 'type_' || y_pred AS type, count(*) AS count, round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 6) AS percentage FROM preds GROUP BY y_pred"),
)
def _(spark, folder):
    return rounded(evaluate.alert_volume(multiclass(spark, folder)), ["percentage"])


WEIGHTS = {"type_0": 0.5, "type_3": 4.0}


@query(
    "e16_workload",
    _sql(_MULTI, "SELECT count(*) AS total_alerts, sum(CASE y_pred WHEN 0 THEN 0.5 WHEN 3 THEN 4.0 ELSE 1.0 END)::DOUBLE AS workload_score FROM preds"),
)
def _(spark, folder):
    return evaluate.workload(multiclass(spark, folder), WEIGHTS)


@query("e17_alert_density", _sql(_MULTI, "SELECT count(*)::DOUBLE / greatest(count(*), 1) * 1000 AS alerts_per_1000_lines FROM preds"))
def _(spark, folder):
    return evaluate.alert_density(multiclass(spark, folder))


@query(
    "e17b_finding_density",
    with_findings(
        """SELECT (SELECT count(*) FROM found) AS findings, count(*) AS lines,
        round((SELECT count(*) FROM found) * 1000.0::DOUBLE / count(*), 6) AS findings_per_1000_lines FROM line_table"""
    ),
)
def _(spark, folder):
    files = features.text_measures(corpus_table(spark, folder))
    counted = rules.scan(files).select(F.size("findings").alias("n_findings"), "line_count")
    return rounded(evaluate.finding_density(counted), ["findings_per_1000_lines"])


def board_metrics(spark, folder):
    rows = models(spark, folder)
    areas = evaluate.roc_auc(rows, ["model"]).select("model", F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    return (
        evaluate.overall(rows, ["model"])
        .unionByName(evaluate.precision_at_k_by(rows, ["model"]))
        .unionByName(areas)
    )


_BOARD = f"""{_BINARY.replace('preds AS', 'half AS')},
runs AS (SELECT id, y_true, score, model, (score >= cut)::INTEGER AS y_pred FROM bin, (VALUES ('t0.3', 0.3::DOUBLE), ('t0.5', 0.5::DOUBLE), ('t0.7', 0.7::DOUBLE)) v(model, cut)),
seen AS (SELECT model, y_true AS label FROM runs UNION SELECT model, y_pred FROM runs),
counts AS (SELECT s.model, label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_true = label) AS support,
  count(*) FILTER (y_pred = label) AS predicted FROM seen s JOIN runs r ON s.model = r.model GROUP BY s.model, label),
scores AS (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
  coalesce(2.0::DOUBLE * tp / nullif(support + predicted, 0), 0) AS f1 FROM counts),
perf AS (SELECT model, sum(tp)::DOUBLE / sum(support) AS accuracy, avg(f1) AS f1_macro, avg(precision) AS precision_macro, avg(recall) AS recall_macro FROM scores GROUP BY model),
{_CURVE},
area AS (SELECT sum(neg * (tps - pos / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)) AS auc FROM curve),
{_precision_sql('bin')},
top AS (SELECT k, sum(y_true) / k::DOUBLE AS v FROM ranked, cuts WHERE place <= k GROUP BY k),
board AS (SELECT model, accuracy, f1_macro, precision_macro, recall_macro, auc,
  coalesce((SELECT v FROM top WHERE k = 1), 0) AS "precision@1", coalesce((SELECT v FROM top WHERE k = 5), 0) AS "precision@5",
  coalesce((SELECT v FROM top WHERE k = 10), 0) AS "precision@10" FROM perf, area)"""
_BOARD_COLUMNS = evaluate.LEADERBOARD_METRICS
BOARD_SELECT = (
    "SELECT model, " + ", ".join(f'round("{m}", 9) AS "{m}"' for m in _BOARD_COLUMNS)
    + ', round(0.3 * accuracy + 0.3 * f1_macro + 0.2 * "precision@5" + 0.2 * auc, 9) AS weighted_score FROM board'
)


@query("e19_leaderboard", _sql(_BOARD, BOARD_SELECT))
def leaderboard(spark, folder):
    return rounded(evaluate.leaderboard(board_metrics(spark, folder)), [*_BOARD_COLUMNS, "weighted_score"], 9)


@query(
    "e20_summary_report",
    _sql(
        _BINARY, _CLASSES, _CURVE,
        """SELECT '2024-01-02T03:04:05' AS evaluation_timestamp, 2::BIGINT AS total_metrics,
        (SELECT round(sum(tp)::DOUBLE / sum(support), 9) FROM scores) AS accuracy, (SELECT round(avg(f1), 9) FROM scores) AS f1_macro,
        (SELECT round((sum(neg * (tps - pos / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)))::DOUBLE, 9) FROM curve) AS auc""",
    ),
)
def _(spark, folder):
    rows = binary(spark, folder)
    metrics = evaluate.overall(rows).unionByName(
        evaluate.roc_auc(rows).select(F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    ).withColumn("section", F.lit("detection_performance"))
    best = evaluate.precision_at_k(rows).withColumn("section", F.lit("precision_at_k"))
    report = evaluate.summary_report(metrics.unionByName(best), "2024-01-02T03:04:05")
    return rounded(report, ["accuracy", "f1_macro", "auc"], 9)


@query(
    "e22_comparison_grid",
    _sql(_BOARD, 'SELECT model, round(accuracy, 9) AS accuracy, round(f1_macro, 9) AS f1_macro, 0.0::DOUBLE AS specificity FROM board'),
)
def _(spark, folder):
    names = ["accuracy", "f1_macro", "specificity"]
    return rounded(evaluate.comparison_grid(evaluate.overall(models(spark, folder), ["model"]), names), names, 9)
