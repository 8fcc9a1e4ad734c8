"""Code features: counts over each file's own tree and text, computed in the file's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.pystr import java_regex, py_strip, split_lines
from riskweave.operators.nodes import with_tree

# Names counted as dangerous calls, and the secret patterns.
DANGEROUS_CALLS = ("eval", "exec", "compile", "input", "open")
SECRET_PATTERNS = (
    r"""password\s*=\s*['"][^'"]+['"]""",
    r"""secret\s*=\s*['"][^'"]+['"]""",
    r"""key\s*=\s*['"][^'"]+['"]""",
    r"""token\s*=\s*['"][^'"]+['"]""",
    r"""api_key\s*=\s*['"][^'"]+['"]""",
)
TREE_FEATURES = (
    "ast_nodes", "ast_depth", "function_count", "class_count", "if_count", "for_count",
    "while_count", "try_count", "import_count", "dangerous_calls", "string_count",
    "avg_string_length", "potential_secrets",
)
TEXT_FEATURES = (
    "line_count", "char_count", "avg_line_length", "max_line_length", "empty_lines",
    "comment_lines", "docstring_lines",
)
COMPLEXITY_FEATURES = (
    "cyclomatic_complexity", "halstead_volume", "halstead_difficulty", "halstead_effort",
)
DERIVED_FEATURES = ("code_density", "complexity_ratio")
ALL_FEATURES = TREE_FEATURES + TEXT_FEATURES + COMPLEXITY_FEATURES + DERIVED_FEATURES


def holds_secret(text: Column) -> Column:
    out = F.lit(False)
    for pattern in SECRET_PATTERNS:
        out = out | F.rlike(text, F.lit(java_regex(pattern)))
    return out


def secret_count(text: Column) -> Column:
    """Matches of the secret patterns in free text, each pattern counted on its own."""
    out = F.lit(0)
    for pattern in SECRET_PATTERNS:
        out = out + F.regexp_count(text, F.lit(java_regex(pattern)))
    return out


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0)))


def tree_measures(files: DataFrame) -> DataFrame:
    """Add the tree features, docstring lines, complexity and Halstead measures."""
    parsed = with_tree(files)
    nodes = F.col("tree.nodes")
    # Flat arrays first: counting in them needs no lambda per node.
    flat = parsed.select(
        *files.columns,
        F.transform(nodes, lambda n: n["node_type"]).alias("_types"),
        F.transform(nodes, lambda n: n["depth"]).alias("_depths"),
        F.array_compact(F.transform(nodes, lambda n: n["call_name"])).alias("_calls"),
        F.array_compact(F.transform(nodes, lambda n: n["str_value"])).alias("_strings"),
        F.transform(F.filter(nodes, lambda n: n["node_type"] == "Name"), lambda n: n["name"]).alias("_names"),
        F.transform(F.filter(nodes, lambda n: n["is_operator"]), lambda n: n["node_type"]).alias("_operators"),
        _sum(F.transform(nodes, lambda n: n["doc_lines"])).alias("docstring_lines"),
        _sum(
            F.transform(
                nodes,
                lambda n: F.when(n["node_type"] == "BoolOp", n["n_children"] - 1)
                .when(n["node_type"] == "Try", n["n_children"])
                .otherwise(0),
            )
        ).alias("_branches"),
    )

    def count(*kinds):
        total = F.lit(0)
        for kind in kinds:
            total = total + F.size("_types") - F.size(F.array_remove("_types", kind))
        return total

    lengths = F.transform("_strings", lambda s: F.length(s))
    measured = flat.withColumns(
        {
            "ast_nodes": F.size("_types"),
            "ast_depth": F.coalesce(F.array_max("_depths"), F.lit(0)),
            "function_count": count("FunctionDef"),
            "class_count": count("ClassDef"),
            "if_count": count("If"),
            "for_count": count("For"),
            "while_count": count("While"),
            "try_count": count("Try"),
            "import_count": count("Import", "ImportFrom"),
            "dangerous_calls": F.size(F.filter("_calls", lambda c: c.isin(*DANGEROUS_CALLS))),
            "string_count": F.size("_strings"),
            "avg_string_length": F.coalesce(F.try_divide(_sum(lengths), F.size("_strings")), F.lit(0.0)),
            "potential_secrets": F.size(F.filter("_strings", holds_secret)),
            "cyclomatic_complexity": F.lit(1) + count("If", "While", "For", "AsyncFor") + F.col("_branches"),
            "_operands": F.concat(
                "_names",
                F.transform(lengths, lambda n: F.concat(F.lit("string_"), n.cast("string"))),
            ),
        }
    )
    kinds = F.size(F.array_distinct("_operators"))
    operands = F.size(F.array_distinct("_operands"))
    some = (kinds > 0) & (operands > 0)
    volume = F.when(
        some, (F.size("_operators") + F.size("_operands")) * F.log2((kinds + operands).cast("double"))
    ).otherwise(0.0)
    difficulty = F.when(some, (kinds / 2) * F.try_divide(F.size("_operands"), operands)).otherwise(0.0)
    return measured.withColumns(
        {"halstead_volume": volume, "halstead_difficulty": difficulty}
    ).select(
        *files.columns, *TREE_FEATURES, "docstring_lines", "cyclomatic_complexity",
        "halstead_volume", "halstead_difficulty",
        (F.col("halstead_volume") * F.col("halstead_difficulty")).alias("halstead_effort"),
    )


def text_measures(files: DataFrame) -> DataFrame:
    """Add the features of the text alone; no parse."""
    lines = files.withColumn("_lines", split_lines(F.col("code")))
    n = F.size("_lines")
    return lines.withColumns(
        {
            "line_count": n,
            "char_count": F.length("code"),
            # Every character but the line ends belongs to a line.
            "avg_line_length": (F.length("code") - (n - 1)) / n,
            "max_line_length": F.array_max(F.transform("_lines", lambda x: F.length(x))),
            "empty_lines": F.size(F.filter("_lines", lambda x: py_strip(x) == "")),
            "comment_lines": F.size(F.filter("_lines", lambda x: F.startswith(py_strip(x), F.lit("#")))),
        }
    ).drop("_lines")


def all_features(files: DataFrame, names=ALL_FEATURES) -> DataFrame:
    """Every input column but ``code``, and the features in ``names``; one row per file."""
    carried = [c for c in files.columns if c != "code"]
    measured = text_measures(tree_measures(files))
    measured = measured.withColumns(
        {
            "code_density": F.col("char_count") / F.greatest("line_count", F.lit(1)),
            "complexity_ratio": F.col("cyclomatic_complexity") / F.greatest("function_count", F.lit(1)),
        }
    )
    return measured.select(*carried, *names)
