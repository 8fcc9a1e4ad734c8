"""Tables in and out: labelled sets, findings, scores, audit events, model folders."""

from __future__ import annotations

import logging
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import materialise
from riskweave.sources.commits import commit, committed, is_committed

logger = logging.getLogger(__name__)

# Split names, the sample schema, the renamed columns of a findings download.
SPLITS = ("train", "validation", "test")
SAMPLE_SCHEMA = (
    "id bigint, code string, vulnerability_type string, severity string, line_number int, "
    "description string, confidence double, rule_id string"
)
DOWNLOAD_COLUMNS = {
    "line_number": "Line",
    "severity": "Severity",
    "vulnerability_type": "Type",
    "description": "Description",
    "confidence": "Confidence",
    "code_snippet": "Code",
}
AUDIT_SCHEMA = "ts timestamp, level string, event_type string, fields map<string,string>, user_id string, message string, event_date date"
# Code holds line ends, quotes and backslashes: quote by doubling, never by backslash.
_CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}
# Leading and trailing blanks and empty strings are part of the text.
_CSV_WRITE = {
    "header": True, "escape": '"', "quoteAll": True, "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**_CSV_WRITE).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.options(**_CSV).schema(schema).csv(path)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_dataset(samples: DataFrame, folder: str) -> None:
    """A CSV and a JSON folder per split, from one computation of the samples."""
    samples = materialise(samples, "samples")
    columns = [c for c in samples.columns if c != "split"]
    for kind in ("csv", "json"):
        writer = samples.select(*columns, "split").write.mode("overwrite").partitionBy("split")
        if kind == "csv":
            writer.options(**_CSV_WRITE).csv(f"{folder}/csv")
        else:
            writer.json(f"{folder}/json")


def read_dataset(spark: SparkSession, folder: str, schema: str = SAMPLE_SCHEMA) -> DataFrame:
    """The splits of a CSV dataset with their ``split``; a missing one is logged and left out."""
    parts = []
    for split in SPLITS:
        path = f"{folder}/csv/split={split}"
        try:
            parts.append(read_csv(spark, path, schema).withColumn("split", F.lit(split)))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            logger.warning("split not found: %s", path)
    if not parts:
        return spark.createDataFrame([], schema + ", split string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_findings(found: DataFrame, path: str, kind: str = "json") -> str | None:
    """Findings as JSON or CSV; an empty table leaves no CSV."""
    if kind == "json":
        return write_json(found, path)
    if kind != "csv":
        raise ValueError(f"unknown format: {kind}")
    found = materialise(found, "findings")
    if found.isEmpty():
        logger.warning("no findings to save")
        return None
    return write_csv(found, path)


def download_view(found: DataFrame) -> DataFrame:
    return found.select(*[F.col(c).alias(name) for c, name in DOWNLOAD_COLUMNS.items()])


def write_results(metrics: DataFrame, path: str) -> str:
    """Scores (``section, metric, value``) as JSON rows, one nested record per section."""
    nested = metrics.groupBy("section").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("values")
    )
    return write_json(nested, path)


def append_audit(events: DataFrame, path: str) -> str:
    """Append events to a Parquet table kept by day."""
    events.write.mode("append").partitionBy("event_date").parquet(path)
    return path


def append_audit_once(events: DataFrame, path: str, batch: str) -> bool:
    """Add the events of a batch, by day, unless the table at ``path`` has that batch; tells whether it was added.

    The batch's name is committed after its events.  What an attempt left that died before is overwritten, and
    ``read_audit`` does not see it.
    """
    if not batch:
        raise ValueError("a batch needs a name")
    spark = events.sparkSession
    if is_committed(spark, path, batch):
        return False
    events.write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/events/batch={quote(batch, safe='')}")
    commit(spark, path, batch)
    return True


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Events of the committed batches with their ``batch``."""
    schema = AUDIT_SCHEMA + ", batch string"
    done = committed(spark, path).select(F.col("name").alias("batch")).distinct()
    if done.isEmpty():
        return spark.createDataFrame([], schema)
    events = spark.read.schema(schema).parquet(f"{path}/events")
    return events.join(done, "batch", "left_semi")
