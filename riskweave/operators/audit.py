"""Audit events as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.pystr import py_fixed

# The default user, the labels of an event line and the warning severities.
ANONYMOUS = "anonymous"
WARNING_SEVERITIES = ("high", "critical")


def _events(df: DataFrame, event: str, fields: dict[str, Column], user, level: Column | None = None, at=None) -> DataFrame:
    """Rows of ``ts, level, event_type, fields, user_id, message, event_date``."""
    stamp = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    who = F.coalesce(user if isinstance(user, Column) else F.lit(user), F.lit(ANONYMOUS))
    pairs = []
    parts = []
    for name, value in fields.items():
        text = F.coalesce(value.cast("string"), F.lit("None"))
        pairs += [F.lit(name), text]
        parts.append(F.concat(F.lit(f"{name}: "), text))
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.concat(
        F.lit(f"{event} - "),
        F.concat_ws(", ", *parts, F.concat(F.lit("User: "), who), F.concat(F.lit("Timestamp: "), when)),
    )
    return df.withColumn("ts", stamp).select(
        "ts",
        (F.lit("INFO") if level is None else level).alias("level"),
        F.lit(event).alias("event_type"),
        F.create_map(*pairs).alias("fields"),
        who.alias("user_id"),
        line.alias("message"),
        F.to_date("ts").alias("event_date"),
    )


def analysis_start(files: DataFrame, user=None, at=None) -> DataFrame:
    return _events(files, "ANALYSIS_START", {"File": F.col("file_path")}, user, at=at)


def analysis_complete(scanned: DataFrame, user=None, at=None) -> DataFrame:
    """From scan rows: each file carries its own findings, so no join is needed."""
    fields = {"File": F.col("file_path"), "Vulnerabilities": F.size("findings")}
    return _events(scanned, "ANALYSIS_COMPLETE", fields, user, at=at)


def vulnerability_detected(found: DataFrame, user=None, at=None) -> DataFrame:
    fields = {
        "Type": F.col("vulnerability_type"), "Severity": F.col("severity"),
        "File": F.col("file_path"), "Line": F.col("line_number"),
    }
    return _events(found, "VULNERABILITY_DETECTED", fields, user, at=at)


def model_prediction(preds: DataFrame, model: str, user=None, at=None) -> DataFrame:
    fields = {
        "Model": F.lit(model), "Prediction": F.col("prediction"), "Confidence": py_fixed(F.col("confidence"), 3),
    }
    return _events(preds, "MODEL_PREDICTION", fields, user, at=at)


def pii_detected(protected: DataFrame, place: Column, user=None, at=None) -> DataFrame:
    """One event per type found in a row of ``pii.protect``."""
    rows = protected.withColumn("pii_type", F.explode("pii_types"))
    fields = {"Type": F.col("pii_type"), "File": place}
    return _events(rows, "PII_DETECTED", fields, user, F.lit("WARNING"), at=at)


def security_event(rows: DataFrame, user=None, at=None) -> DataFrame:
    """Rows with ``event``, ``description`` and ``severity``."""
    fields = {"Type": F.col("event"), "Description": F.col("description"), "Severity": F.col("severity")}
    level = F.when(F.col("severity").isin(*WARNING_SEVERITIES), "WARNING").otherwise("INFO")
    return _events(rows, "SECURITY_EVENT", fields, user, level, at=at)
