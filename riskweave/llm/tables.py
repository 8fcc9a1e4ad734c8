"""Broadcast behind a check of size, and row identity, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted size is below this; larger sides are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def small_side(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its rows fit the limit, else leave it to the join."""
    return F.broadcast(table) if table.count() * row_bytes <= limit else table


def text_key(text: Column) -> Column:
    """Tells rows that share an id but not a text apart; null and empty differ."""
    return F.xxhash64(F.lit("text"), text)


def free_name(taken: list[str], wish: str) -> str:
    """A column name that no given column has, whatever its case."""
    lower = {name.lower() for name in taken}
    while wish.lower() in lower:
        wish += "_"
    return wish


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A few fixed rows as a DataFrame of literals."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
