"""Exact ranks and running sums without a window over a whole group.

A window over a hot group sorts it in one task.  Here each group is cut into buckets of its
sort key, windows run per (group, bucket), and the totals of earlier buckets, a table of at most
``buckets`` rows per group, are added.  The number of buckets follows the session's shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.session import materialise


def join_null_safe(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Inner join on ``keys`` in which null equals null; the keys come from ``left``."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def _parts(df: DataFrame) -> int:
    """As many parts as the session shuffles into, which is how a cluster states its size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shuffled_rank(df: DataFrame, groups, seed, id_col: str, buckets: int | None = None) -> DataFrame:
    """Add ``rank`` (1-based, exact) and ``group_size`` in the order of md5(seed | id).

    The hash is uniform, so equal slices of its range are evenly filled buckets for every group.  The input
    is written once, since its ranks need it twice.  A null group is a group.
    """
    groups = list(groups)
    buckets = buckets or 4 * _parts(df)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    # The leading 32 bits of the hash, scaled to the number of buckets.
    lead = F.conv(F.substring("_order", 1, 8), 16, 10).cast("bigint")
    keyed = df.withColumn("_order", order).withColumn(
        "_bucket", F.shiftright(lead * F.lit(buckets).cast("bigint"), 32).cast("int")
    )
    keyed = materialise(keyed, "ranked")
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*groups, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(
            *groups,
            "_bucket",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias("group_size"),
        )
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_order", id_col)
    return (
        join_null_safe(keyed.withColumn("_place", F.row_number().over(inside)), offsets, [*groups, "_bucket"])
        .withColumn("rank", F.col("_before") + F.col("_place"))
        .drop("_order", "_bucket", "_before", "_place")
    )


def running_sums(
    df: DataFrame, groups, order: str, sums: dict[str, Column], buckets: int | None = None
) -> DataFrame:
    """One row per (group, distinct ``order``) with sums, running sums and totals, ascending.

    For each name in ``sums``: ``name``, ``name_upto`` (this key included), ``name_total`` and
    ``name_next`` (the value at the next key, null at the last).  Equal keys collapse before any
    window, so a key holding a third of all rows is one row here.  The collapsed keys are dealt by
    range into ``buckets`` parts (the session's shuffle partitions) and written once with the number
    of their part, so every later step sees the same cuts.  A null group is a group.
    """
    groups = list(groups)
    names = list(sums)
    keys = df.groupBy(*groups, order).agg(*[sums[n].alias(n) for n in names])
    dealt = keys.repartitionByRange(buckets or _parts(df), *groups, order)
    placed = materialise(dealt.withColumn("_bucket", F.spark_partition_id()), "placed")

    whole = Window.partitionBy(*groups)
    ordered = whole.orderBy("_bucket")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*groups, "_bucket").agg(
        *[F.sum(n).alias(n) for n in names],
        F.min_by(F.struct(*names), F.struct(order)).alias("_first"),
    )
    offsets = totals.select(
        *groups,
        "_bucket",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in names],
        F.lead("_first").over(ordered).alias("_following"),
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select(
        *groups,
        order,
        "_bucket",
        *names,
        *[F.sum(n).over(upto).alias(f"_upto_{n}") for n in names],
        F.lead(F.struct(*names)).over(inside).alias("_next"),
    )
    following = F.coalesce(F.col("_next"), F.col("_following"))
    return join_null_safe(local, offsets, [*groups, "_bucket"]).select(
        *groups,
        order,
        *names,
        *[(F.col(f"_before_{n}") + F.col(f"_upto_{n}")).alias(f"{n}_upto") for n in names],
        *[F.col(f"{n}_total") for n in names],
        *[following[n].alias(f"{n}_next") for n in names],
    )


def exact_quantiles(df: DataFrame, groups, value: str, shares) -> DataFrame:
    """Linearly interpolated quantiles per group: ``groups, q, value``.

    The two order statistics around each quantile are picked from running counts, so no task
    holds a group's values.
    """
    groups = list(groups)
    counted = running_sums(
        df.where(F.col(value).isNotNull()), groups, value, {"n": F.count("*")}
    )
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("n_total") - 1)).alias("at"))
                for q in shares
            ]
        )
    )
    low, high = F.floor(F.col("w.at")), F.ceil(F.col("w.at"))
    first, last = F.col("n_upto") - F.col("n"), F.col("n_upto") - 1
    hits = counted.select(*groups, value, "n", "n_upto", wanted.alias("w")).where(
        ((first <= low) & (low <= last)) | ((first <= high) & (high <= last))
    )
    fraction = F.max(F.col("w.at") - low)
    a, b = F.min(value), F.max(value)
    return hits.groupBy(*groups, F.col("w.q").alias("q")).agg(
        (a + (b - a) * fraction).alias("value")
    )


def top_per_group(df: DataFrame, groups, order, limit: int, salt_by: str, salts: int | None = None) -> DataFrame:
    """The first ``limit`` rows of every group, exact, with a hot group cut into salted parts first."""
    salt = F.pmod(F.xxhash64(salt_by), F.lit(salts or _parts(df)))
    part = Window.partitionBy(*groups, "_salt").orderBy(*order)
    whole = Window.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_place", F.row_number().over(part))
        .where(F.col("_place") <= limit)
        .withColumn("_place", F.row_number().over(whole))
        .where(F.col("_place") <= limit)
        .drop("_salt", "_place")
    )


def chunks(df: DataFrame, order: str, size: int, buckets: int | None = None) -> DataFrame:
    """Consecutive runs of ``size`` rows in the order of a unique numeric column.

    ``chunk, members``: each chunk collects at most ``size`` values.
    """
    placed = running_sums(df.select(order), [], order, {"n": F.count("*")}, buckets)
    chunk = F.floor((F.col("n_upto") - 1) / F.lit(size)).cast("bigint")
    return placed.groupBy(chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(order)).alias("members")
    )
