"""What has been written whole: a small table of names, appended to only after the data they stand for.

A run that dies before its commit leaves data that nobody reads and that the next attempt overwrites.  One
writer at a time may work under one name; writers of different names do not meet.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "name string, about string, at timestamp"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder, or an empty table where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """``name, about, at`` of everything committed below ``folder``."""
    return read_if_there(spark, f"{folder}/commits", COMMITS)


def is_committed(spark: SparkSession, folder: str, name: str) -> bool:
    return not committed(spark, folder).where(F.col("name") == name).isEmpty()


def commit(spark: SparkSession, folder: str, name: str, about: str = "") -> None:
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(about).alias("about"), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").parquet(f"{folder}/commits")
