"""Scans of a tree that is scanned again and again: only files whose content changed are parsed and matched.

A run hashes every file and joins the hashes with those of the last committed run by path.  Paths are kept
relative to the root, so a tree may move, or be a new snapshot elsewhere.  Below the ``state`` folder stand

* ``manifest/run=N``: ``path, hash, size, problem, scanned_run`` of every file the run saw;
* ``changes/run=N``: ``path, status`` of files ``added``, ``changed`` or ``removed`` since the run before;
* ``findings/run=N``: the findings of the files scanned in run N;
* ``commits``: the runs that are whole.  A run that died is repeated under its number and leaves no trace.

One run at a time may work on a state.  A file that changes while a run reads it is seen as changed by the next.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.text import content_hash
from riskweave.operators.rules import findings
from riskweave.session import materialise, tune
from riskweave.sources import files
from riskweave.sources.commits import commit, committed, read_if_there

MANIFEST = "path string, hash string, size bigint, problem string, scanned_run bigint"
CHANGES = "path string, status string"


def last_run(spark: SparkSession, state: str) -> tuple[int, str] | None:
    """Number and options of the last whole run."""
    number = F.col("name").cast("bigint")
    row = committed(spark, state).select(number.alias("run"), "about").orderBy(F.desc("run")).first()
    return (row["run"], row["about"]) if row else None


def manifest(spark: SparkSession, state: str, run: int | None = None) -> DataFrame:
    """The files of a run, the last one unless told otherwise; empty before the first."""
    if run is None:
        run = (last_run(spark, state) or (0, ""))[0]
    return read_if_there(spark, f"{state}/manifest/run={run}", MANIFEST)


def changes(spark: SparkSession, state: str, run: int | None = None) -> DataFrame:
    """``path, status`` of what a run, the last one unless told otherwise, found different from the one before."""
    if run is None:
        run = (last_run(spark, state) or (0, ""))[0]
    return read_if_there(spark, f"{state}/changes/run={run}", CHANGES)


def current_findings(spark: SparkSession, state: str) -> DataFrame:
    """Findings of all files of the last run, each from the run that scanned it last; none before the first run."""
    last = last_run(spark, state)
    if last is None:
        raise ValueError(f"no scan committed in {state}")
    found = spark.read.parquet(f"{state}/findings")
    seen = manifest(spark, state, last[0]).select(F.col("path").alias("file_path"), F.col("scanned_run").alias("run"))
    return found.withColumn("run", F.col("run").cast("bigint")).join(seen, ["file_path", "run"], "left_semi").drop("run")


def _hashed(paths: DataFrame, start: int) -> DataFrame:
    """``path`` below the root, ``hash, size, problem`` of files; contents stay in the task that read them."""
    read = files.read_files(paths)
    return read.select(
        F.substr("path", F.lit(start)).alias("path"),
        content_hash(F.col("content"), "sha256").alias("hash"),
        F.octet_length("content").cast("bigint").alias("size"),
        "problem",
    )


def scan_changes(spark: SparkSession, root: str, state: str, **options) -> int:
    """Scan what changed below ``root`` since the last run and commit the run; returns its number.

    Other ``options`` than the last run's scan every file anew.  An unreadable file keeps its reason in the
    manifest and is tried again by every run.
    """
    tune(spark)
    root = files.qualified(spark, root)
    base = (root if files._is_remote(root) else files._local(root)).rstrip("/") + "/"
    about = json.dumps(options, sort_keys=True, default=str)
    last = last_run(spark, state)
    run = last[0] + 1 if last else 1
    paths = files.list_files(spark, root).where(F.rlike("path", F.lit(r"[^/]\.py$")))
    now = materialise(_hashed(paths, len(base) + 1), "hashed")
    before = manifest(spark, state, last[0] if last else 0).select(
        "path", F.col("hash").alias("old_hash"), "scanned_run", F.lit(True).alias("was")
    )
    joined = now.withColumn("is", F.lit(True)).join(before, "path", "full_outer")
    unlike = F.col("hash").isNull() | ~F.col("hash").eqNullSafe(F.col("old_hash"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(unlike, "changed").otherwise("same")
    joined = materialise(joined.withColumn("status", status), "compared")
    anew = (F.col("status") != "same") | F.lit(bool(last) and last[1] != about)
    seen = joined.where("status <> 'removed'").withColumn("scanned_run", F.when(anew, F.lit(run).cast("bigint")).otherwise(F.col("scanned_run")))
    seen.select("path", "hash", "size", "problem", "scanned_run").write.mode("overwrite").parquet(f"{state}/manifest/run={run}")
    joined.where("status <> 'same'").select("path", "status").write.mode("overwrite").parquet(f"{state}/changes/run={run}")
    scanned = manifest(spark, state, run).where(F.col("scanned_run") == run).select(F.concat(F.lit(base), "path").alias("path"))
    code = files.decode(files.read_files(scanned)).where("code is not null")
    name = F.substr("path", F.lit(len(base) + 1))
    found = findings(code.select(name.alias("file_id"), name.alias("file_path"), "code"), **options)
    found.write.mode("overwrite").parquet(f"{state}/findings/run={run}")
    commit(spark, state, str(run), about)
    return run
