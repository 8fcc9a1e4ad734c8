"""Queries on control flow: a file per document from snippets whose graphs were counted by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import flow
from riskweave.plans.golden import values
from riskweave.plans.registry import query
from riskweave.session import spread
from riskweave.sources.corpus import table

# Fixed values, hand-counted: code; (function, cyclomatic number, first lines of unreachable blocks);
# (function, line, variable) of unreleased handles; (function, kind, variable, source line, sink line).
SNIPPETS = (
    ("f = open(p)\ndata = f.read()\nf.close()", [("<module>", 1, [])], [], []),
    ("f = open(p)\ndata = f.read()", [("<module>", 1, [])], [("<module>", 1, "f")], []),
    ("with open(p) as f:\n    data = f.read()", [("<module>", 1, [])], [], []),
    ("f = open(p)\nif ready:\n    f.close()", [("<module>", 2, [])], [("<module>", 1, "f")], []),
    ("def load(p):\n    f = open(p)\n    try:\n        return f.read()\n    finally:\n        f.close()", [("<module>", 1, []), ("load", 1, [])], [], []),
    ("def load(p):\n    f = open(p)\n    if not p:\n        return None\n    f.close()", [("<module>", 1, []), ("load", 2, [])], [("load", 2, "f")], []),
    ("data = open(p).read()", [("<module>", 1, [])], [("<module>", 1, "")], []),
    ("def give(p):\n    f = open(p)\n    return f", [("<module>", 1, []), ("give", 1, [])], [], []),
    ("q = 'select * from t where id = ' + uid\ncur.execute(q)", [("<module>", 1, [])], [], [("<module>", "sql_injection", "q", 1, 2)]),
    ("q = 'select 1'\nif wide:\n    q = f'select {names}'\ncur.execute(q)", [("<module>", 2, [])], [], [("<module>", "sql_injection", "q", 3, 4)]),
    ("q = 'select * from t where id = ' + uid\nq = 'select 1'\ncur.execute(q)", [("<module>", 1, [])], [], []),
    ("cur.execute('select * from t where id = ?', (uid,))", [("<module>", 1, [])], [], []),
    ("c = 'ls {}'.format(d)\nrun = c\nos.system(run)", [("<module>", 1, [])], [], [("<module>", "shell_injection", "run", 1, 3)]),
    ("c = 'ls ' + d\nc = shlex.quote(c)\nos.system(c)", [("<module>", 1, [])], [], []),
    ("def pick(a):\n    if a:\n        return 1\n    else:\n        return 2\n    print(a)", [("<module>", 1, []), ("pick", 2, [6])], [], []),
    ("for x in xs:\n    if x:\n        continue\n    work(x)\nelse:\n    done()", [("<module>", 3, [])], [], []),
    ("try:\n    a()\nexcept ValueError:\n    b()\nexcept KeyError:\n    c()", [("<module>", 3, [])], [], []),
    ("match a:\n    case 1:\n        b()\n    case 2:\n        c()\n    case _:\n        d()", [("<module>", 3, [])], [], []),
    ("def broken(:", [], [], []),
)


def files_of(spark, folder):
    """``file_id, code``: the document's snippet and its whole text as comments."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    body = F.get(F.array(*[F.lit(s[0]) for s in SNIPPETS]), (F.col("doc_id") % len(SNIPPETS)).cast("int"))
    tail = F.concat(F.lit("\n# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))
    return documents.select(F.col("doc_id").alias("file_id"), F.concat(body, tail).alias("code"))


def _oracle(columns, rows, select):
    named = [(i, *row) for i, snippet in enumerate(SNIPPETS) for row in rows(snippet)]
    return lambda: f"WITH {values('want', ['t', *columns], named)} SELECT doc_id AS file_id, {select} FROM documents JOIN want ON t = doc_id % {len(SNIPPETS)}"


def _lines(found):
    return ",".join(map(str, found))


@query("p04_control_flow", _oracle(["function", "complexity", "dead"], lambda s: [(f, n, _lines(d)) for f, n, d in s[1]], "function, complexity::INTEGER AS complexity, dead AS unreachable"))
def _(spark, folder):
    found = flow.cfg_functions(files_of(spark, folder))
    return found.select("file_id", "function", "complexity", F.array_join("unreachable_lines", ",").alias("unreachable"))


@query("p05_dominators", _oracle(["function"], lambda s: [(f,) for f, _, _ in s[1]], "function, true AS rooted, true AS linked"))
def _(spark, folder):
    """Each function's dominators make one tree under its entry, and every edge joins known blocks."""
    functions = flow.with_flow(files_of(spark, folder)).select("file_id", F.explode("flow").alias("f"))
    numbers = F.transform("f.blocks", lambda b: b["block"])
    live = F.filter("f.blocks", lambda b: b["reachable"])
    roots = F.filter(live, lambda b: b["dominator"].isNull())
    known = F.forall(live, lambda b: b["dominator"].isNull() | F.exists(live, lambda o: o["block"] == b["dominator"]))
    linked = F.forall("f.edges", lambda e: F.array_contains(numbers, e["source"]) & F.array_contains(numbers, e["target"]))
    return functions.select("file_id", F.col("f.function").alias("function"), ((F.size(roots) == 1) & known).alias("rooted"), linked.alias("linked"))


@query("r19_resource_rule", _oracle(["function", "line", "variable"], lambda s: s[2], "function, line::INTEGER AS line, variable"))
def _(spark, folder):
    return flow.resource_findings(files_of(spark, folder))


@query(
    "r20_def_use",
    _oracle(["function", "kind", "variable", "source_line", "sink_line"], lambda s: s[3], "function, kind, variable, source_line::INTEGER AS source_line, sink_line::INTEGER AS sink_line"),
)
def _(spark, folder):
    return flow.flow_findings(files_of(spark, folder))
