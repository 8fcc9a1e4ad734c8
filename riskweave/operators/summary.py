"""Aggregations over findings and labelled sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.operators.ranks import exact_quantiles


def _grouping_sets(df: DataFrame, sets, *measures) -> DataFrame:
    """Several group counts in one pass."""
    view = [[F.col(name) for name in group] for group in sets]
    names = sorted({name for group in sets for name in group})
    return df.groupingSets(view, *[F.col(n) for n in names]).agg(F.grouping_id().alias("_gid"), *measures)


def finding_summary(found: DataFrame) -> DataFrame:
    """``metric, key, value``: the total, the counts by severity and type, the files affected.

    One pass: a file's own grouping set becomes one row per file, counted in the second step.
    Without findings the total of zero is the only row.
    """
    sets = [["severity"], ["vulnerability_type"], ["file_path"], []]
    counts = _grouping_sets(found, sets, F.count("*").alias("value"))
    # Grouping columns in name order: file_path 4, severity 2, vulnerability_type 1.
    gid = F.col("_gid")
    rows = counts.select(
        F.when(gid == 7, "total").when(gid == 5, "by_severity").when(gid == 6, "by_type")
        .otherwise("files_affected").alias("metric"),
        F.when(gid == 5, F.col("severity")).when(gid == 6, F.col("vulnerability_type")).otherwise("").alias("key"),
        F.when(gid != 3, F.col("value")).when(F.col("file_path").isNotNull(), 1).otherwise(0).alias("value"),
    )
    zero = found.sparkSession.range(1).select(
        F.lit("total").alias("metric"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("value")
    )
    return rows.unionByName(zero).groupBy("metric", "key").agg(F.sum("value").alias("value"))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n")).orderBy("severity")


def headline(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.avg("confidence").alias("avg_confidence"),
    )


def distribution(found: DataFrame, column: str) -> DataFrame:
    """Count and percentage share of each value."""
    counts = found.groupBy(column).agg(F.count("*").alias("n"))
    # The window runs over one row per value, not over the findings.
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", share)


def histogram(found: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, bin_start, n`` over equal bins; bin 0 and bin ``bins + 1`` hold what lies outside."""
    width = (high - low) / bins
    place = F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return (
        found.groupBy(place.alias("bin"))
        .agg(F.count("*").alias("n"))
        .select("bin", (F.lit(float(low)) + (F.col("bin") - 1) * F.lit(width)).alias("bin_start"), "n")
    )


def per_file(found: DataFrame) -> DataFrame:
    return found.groupBy("file_path").agg(F.count("*").alias("n_findings"))


def dataset_stats(samples: DataFrame) -> DataFrame:
    """``split, metric, key, value`` of a labelled corpus: sizes, type and severity counts, confidence."""
    kinds = _grouping_sets(
        samples,
        [["split", "vulnerability_type"], ["split", "severity"], ["split"]],
        F.count("*").alias("n"),
        F.avg("confidence").alias("confidence"),
    )
    # Grouping columns in name order: severity 4, split 2, vulnerability_type 1.
    whole = F.col("_gid") == 5
    rows = F.when(
        whole,
        F.array(
            F.struct(F.lit("total_samples").alias("metric"), F.lit("").alias("key"), F.col("n").cast("double").alias("value")),
            F.struct(F.lit("avg_confidence").alias("metric"), F.lit("").alias("key"), F.col("confidence").alias("value")),
        ),
    ).otherwise(
        F.array(
            F.struct(
                F.when(F.col("_gid") == 4, "vulnerability_types").otherwise("severity_distribution").alias("metric"),
                F.coalesce("vulnerability_type", "severity").alias("key"),
                F.col("n").cast("double").alias("value"),
            )
        )
    )
    return kinds.select("split", F.inline(rows))


def labelled_stats(rows: DataFrame, features, label: str = "label") -> DataFrame:
    """``metric, key, value``: samples, features, label counts and each feature's description.

    Quartiles interpolate linearly and are exact; no task holds a whole column.
    """
    features = list(features)
    sizes = rows.agg(F.count("*").alias("n")).select(
        F.inline(
            F.array(
                F.struct(F.lit("samples").alias("metric"), F.lit("").alias("key"), F.col("n").cast("double").alias("value")),
                F.struct(F.lit("features").alias("metric"), F.lit("").alias("key"), F.lit(float(len(features))).alias("value")),
            )
        )
    )
    labels = rows.groupBy(label).agg(F.count("*").alias("n")).select(
        F.lit("label_distribution").alias("metric"), F.col(label).cast("string").alias("key"),
        F.col("n").cast("double").alias("value"),
    )
    long = rows.select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("double").alias("x")) for f in features]))
    )
    moments = long.groupBy("key").agg(
        F.count("x").cast("double").alias("count"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    described = moments.select(
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col("key"), F.col(m).alias("value"))
                      for m in ("count", "mean", "std", "min", "max")])
        )
    )
    quartiles = exact_quantiles(long, ["key"], "x", (0.25, 0.5, 0.75)).select(
        F.concat((F.col("q") * 100).cast("int").cast("string"), F.lit("%")).alias("metric"), "key", "value"
    )
    return sizes.unionByName(labels).unionByName(described).unionByName(quartiles)
