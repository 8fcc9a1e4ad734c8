"""One parse per file: the syntax tree as rows.

The only Python in the scan.  The code column goes to the worker once and stays in the JVM
beside the result, so no operator joins trees back to their text.
"""

from __future__ import annotations

import ast
import functools
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.session import release

NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("call_name", T.StringType()),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("col_offset", T.IntegerType()),
        T.StructField("str_value", T.StringType()),
        T.StructField("n_children", T.IntegerType()),
        T.StructField("handler_bare", T.BooleanType()),
        T.StructField("doc_lines", T.IntegerType()),
        T.StructField("is_operator", T.BooleanType()),
    ]
)
ERROR = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("offset", T.IntegerType()),
        T.StructField("msg", T.StringType()),
    ]
)
TREE = T.StructType(
    [T.StructField("error", ERROR), T.StructField("nodes", T.ArrayType(NODE))]
)
_NODE_ARROW = [
    (f.name, {"integer": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.typeName()])
    for f in NODE.fields
]
_ERROR_ARROW = [("kind", pa.string()), ("lineno", pa.int32()), ("offset", pa.int32()), ("msg", pa.string())]

# Node types the finding rules read; parsing for rules alone ships no other node.
RULE_NODES = frozenset({"Call", "ExceptHandler"})
# Node tuples held before they are packed into Arrow arrays, which take a tenth of the memory.
FLUSH_NODES = 50_000


def _utf8(text: str) -> str:
    """A literal may hold lone surrogates, which have no UTF-8 form; length is kept."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode("utf-8")


def _node_row(node, index, parent, depth):
    kind = type(node)
    name = call_name = value = children = bare = doc = None
    if kind is ast.Name:
        name = node.id
    elif kind is ast.Call:
        call_name = node.func.id if type(node.func) is ast.Name else None
    elif kind is ast.Constant:
        value = _utf8(node.value) if isinstance(node.value, str) else None
    elif kind is ast.BoolOp:
        children = len(node.values)
    elif kind is ast.Try:
        children = len(node.handlers)
    elif kind is ast.ExceptHandler:
        bare = node.type is None
    if kind in (ast.FunctionDef, ast.ClassDef, ast.Module):
        name = getattr(node, "name", None)
        text = ast.get_docstring(node)
        doc = len(text.split("\n")) if text else 0
    return (
        index, parent, depth, kind.__name__, name, call_name,
        getattr(node, "lineno", None), getattr(node, "col_offset", None),
        value, children, bare, doc, isinstance(node, ast.operator),
    )


def _parse(code: str, only):
    """(error, rows) of one file, nodes breadth first."""
    try:
        queue = [(ast.parse(code), None, 0)]
    except SyntaxError as problem:
        return ("SyntaxError", problem.lineno, problem.offset, problem.msg), []
    except (ValueError, RecursionError, MemoryError) as problem:
        return (type(problem).__name__, None, None, str(problem)), []
    rows = []
    for index, (node, parent, depth) in enumerate(queue):
        if only is None or type(node).__name__ in only:
            rows.append(_node_row(node, index, parent, depth))
        queue.extend((child, index, depth + 1) for child in ast.iter_child_nodes(node))
    return None, rows


def _struct_array(fields, rows, mask=None):
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(column, kind) for column, (_, kind) in zip(columns, fields)]
    return pa.StructArray.from_arrays(arrays, names=[name for name, _ in fields], mask=mask)


def _trees(codes: pa.Array, only) -> pa.Array:
    errors, rows, offsets, parts = [], [], [0], []
    for code in codes:
        error, found = _parse(code.as_py() or "", only)
        errors.append(error)
        offsets.append(offsets[-1] + len(found))
        rows.extend(found)
        if len(rows) >= FLUSH_NODES:
            parts.append(_struct_array(_NODE_ARROW, rows))
            rows = []
    parts.append(_struct_array(_NODE_ARROW, rows))
    failed = _struct_array(
        _ERROR_ARROW,
        [error or (None,) * 4 for error in errors],
        pa.array([error is None for error in errors], pa.bool_()),
    )
    nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(parts))
    return pa.StructArray.from_arrays([failed, nodes], names=["error", "nodes"])


@functools.lru_cache(maxsize=None)
def _tree_udf(only):
    def trees(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for codes in batches:
                yield _trees(codes, only)
                del codes
                release()
        release()

    # Marked non-deterministic so that the optimizer never evaluates it twice for one file.
    return F.arrow_udf(trees, TREE).asNondeterministic()


def with_tree(files: DataFrame, only=None) -> DataFrame:
    """Add ``tree``: the parse error, if any, and the nodes (all, or the types in ``only``)."""
    return files.withColumn("tree", _tree_udf(frozenset(only) if only else None)(F.col("code")))


def ast_nodes(files: DataFrame, only=None) -> DataFrame:
    """The node table: one row per syntax-tree node of every file that parses."""
    return with_tree(files, only).select("file_id", F.inline("tree.nodes"))


def parse_errors(files: DataFrame) -> DataFrame:
    """One row per file the parser refuses, whatever the reason."""
    return (
        with_tree(files, RULE_NODES)
        .where("tree.error is not null")
        .select("file_id", "file_path", "tree.error.*")
    )
