"""Files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.pystr import py_strip, split_lines


def lines(files: DataFrame) -> DataFrame:
    """``file_id, line_number, line, snippet`` with lines numbered from one."""
    return files.select(
        "file_id", F.posexplode(split_lines(F.col("code"))).alias("pos", "line")
    ).select(
        "file_id",
        (F.col("pos") + 1).alias("line_number"),
        "line",
        py_strip(F.col("line")).alias("snippet"),
    )
