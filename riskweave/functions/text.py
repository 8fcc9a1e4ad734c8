"""Scalar helpers (sizes, durations, names, checks, nested records)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.pystr import java_regex, py_fixed

# Unit names, thresholds and patterns of the helper functions.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://[^\s/$.?#].[^\s]*$"
BAD_FILENAME_CHARS = r'[<>:"/\\|?*]'


def format_file_size(size: Column) -> Column:
    """Bytes in the largest unit up to TB, one decimal; zero is ``0B``."""
    value = size.cast("double")
    last = len(SIZE_UNITS) - 1
    scaled, unit = value / 1024.0**last, F.lit(SIZE_UNITS[last])
    for power in reversed(range(last)):
        fits = value < 1024.0 ** (power + 1)
        scaled = F.when(fits, value / 1024.0**power).otherwise(scaled)
        unit = F.when(fits, F.lit(SIZE_UNITS[power])).otherwise(unit)
    text = F.when(size == 0, F.lit("0B")).otherwise(F.concat(py_fixed(scaled, 1), unit))
    return F.when(size.isNotNull(), text)


def format_duration(seconds: Column) -> Column:
    """Seconds below a minute, minutes below an hour, else hours; one decimal."""
    value = seconds.cast("double")
    scaled = (
        F.when(value < 60, value).when(value < 3600, value / 60.0).otherwise(value / 3600.0)
    )
    unit = F.when(value < 60, "s").when(value < 3600, "m").otherwise("h")
    return F.when(seconds.isNotNull(), F.concat(py_fixed(scaled, 1), unit))


def sanitize_filename(name: Column) -> Column:
    clean = F.btrim(F.regexp_replace(name, BAD_FILENAME_CHARS, "_"), F.lit(" ."))
    return F.when(clean == "", F.lit("untitled")).otherwise(clean)


def safe_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """The quotient, or ``default`` for a zero denominator; null inputs stay null."""
    return F.when(denominator == 0, F.lit(float(default))).otherwise(
        F.try_divide(numerator, denominator)
    )


def clamp(value: Column, low, high) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))


def is_valid_email(value: Column) -> Column:
    return F.rlike(value, F.lit(java_regex(EMAIL, ignore_case=False)))


def is_valid_url(value: Column) -> Column:
    return F.rlike(value, F.lit(java_regex(URL, ignore_case=False)))


def truncate_string(text: Column, max_length: int, suffix: str = "...") -> Column:
    # A negative slice bound drops characters from the end, as in Python.
    keep = max_length - len(suffix)
    head = F.substring(text, 1, keep) if keep >= 0 else F.substring(
        text, F.lit(1), F.greatest(F.length(text) + keep, F.lit(0))
    )
    return F.when(F.length(text) <= max_length, text).otherwise(F.concat(head, F.lit(suffix)))


def has_extension(path: Column, extensions) -> Column:
    """Whether the path's suffix, in any case, is one of ``extensions``."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return suffix.isin([e.lower() for e in extensions])


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    makers = {
        "md5": F.md5,
        "sha1": F.sha1,
        "sha224": lambda c: F.sha2(c, 224),
        "sha256": lambda c: F.sha2(c, 256),
        "sha384": lambda c: F.sha2(c, 384),
        "sha512": lambda c: F.sha2(c, 512),
    }
    if algorithm not in makers:
        raise ValueError(f"unsupported hash algorithm: {algorithm}")
    return makers[algorithm](content)


def flatten_columns(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as top-level columns named by their path."""

    def walk(schema: T.StructType, path: tuple):
        for field in schema.fields:
            here = path + (field.name,)
            if isinstance(field.dataType, T.StructType):
                yield from walk(field.dataType, here)
            else:
                yield here

    def pick(path):
        column = F.col(f"`{path[0]}`")
        for part in path[1:]:
            column = column.getField(part)
        return column.alias(sep.join(path))

    return df.select(*[pick(path) for path in walk(df.schema, ())])


def unflatten_columns(df: DataFrame, sep: str = ".") -> DataFrame:
    """Columns named by a path as nested structs: the inverse of ``flatten_columns``."""
    tree: dict = {}
    for name in df.columns:
        node = tree
        *parents, leaf = name.split(sep)
        for part in parents:
            node = node.setdefault(part, {})
        node[leaf] = F.col(f"`{name}`")

    def build(node):
        return [
            (F.struct(*build(value)) if isinstance(value, dict) else value).alias(name)
            for name, value in node.items()
        ]

    return df.select(*build(tree))
