"""Functions of a SQL FROM clause."""

from __future__ import annotations

import warnings

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from riskweave.operators.nodes import NODE, _parse


class ParsePython:
    """Syntax-tree nodes of a text, breadth first; none if it does not parse.  Null is an empty text."""

    def eval(self, code):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            _, rows = _parse(code or "", None)
        yield from rows


def register(spark: SparkSession) -> None:
    """Make ``parse_python(code)`` known to the session: ``SELECT ... FROM files, LATERAL parse_python(files.code)``."""
    spark.udtf.register("parse_python", udtf(ParsePython, returnType=NODE))
