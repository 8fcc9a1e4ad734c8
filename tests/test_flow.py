"""Control flow, def-use findings and unreleased handles against hand-counted functions."""

import textwrap

import pytest

from riskweave.operators import flow


def of(code):
    return {f["function"]: f for f in flow.analyse(textwrap.dedent(code))}


def number(f):
    live = {b["block"] for b in f["blocks"] if b["reachable"]} | {flow.EXIT}
    return sum(e["source"] in live for e in f["edges"]) - len(live) + 2


COUNTED = [
    ("x = 1\ny = 2", 1),
    ("if a: b()\nc()", 2),
    ("if a: b()\nelif c: d()\nelse: e()", 3),
    ("for i in r:\n  if i: break\n  f(i)\nelse: g()", 3),
    ("while True:\n  if a: break\nb()", 2),
    ("while a: b()", 2),
    ("try:\n  a()\nexcept E: b()", 2),
    ("try:\n  a()\n  b()\nexcept E: c()", 3),
    ("try:\n  a()\nexcept E: b()\nexcept G: c()\nd()", 3),
    ("match a:\n  case 1: b()\n  case 2: c()\n  case _: d()", 3),
    ("match a:\n  case 1: b()", 2),
    ("with a as b: c(b)", 1),
]


@pytest.mark.parametrize("code, want", COUNTED)
def test_cyclomatic_number_equals_hand_count(code, want):
    assert number(of(code)["<module>"]) == want


def test_early_return_unreachable_and_dominators():
    f = of("""
        def g(a):
            if a:
                return 1
            else:
                return 2
            print(a)
    """)["g"]
    assert number(f) == 2
    dead = [b for b in f["blocks"] if not b["reachable"] and b["statements"]]
    assert [b["first_line"] for b in dead] == [7] and dead[0]["dominator"] is None
    f = of("if a: b()\nelse: c()\nd()\nwhile e: f()\ng()")["<module>"]
    by_line = {b["first_line"]: b for b in f["blocks"] if b["statements"]}
    line_of = {b["block"]: b["first_line"] for b in f["blocks"]}
    assert line_of[by_line[3]["dominator"]] == 1 and line_of[by_line[5]["dominator"]] == 4


def brute_dominators(f):
    """A block dominates another if the entry no longer reaches that one without it."""
    after = {}
    for e in f["edges"]:
        after.setdefault(e["source"], []).append(e["target"])

    def reach(without):
        seen, stack = set(), [flow.ENTRY] if without != flow.ENTRY else []
        while stack:
            b = stack.pop()
            if b not in seen and b != without:
                seen.add(b)
                stack += after.get(b, [])
        return seen

    every = reach(None)
    return {b: {a for a in every if a != b and b not in reach(a)} for b in every}


def test_dominators_equal_removal_of_blocks():
    for code, _ in [*COUNTED, *((c, 0) for c in LEAKS), *((c, 0) for c in FLOWS)]:
        for f in flow.analyse(textwrap.dedent(code)):
            strict = brute_dominators(f)
            near = {b["block"]: b["dominator"] for b in f["blocks"] if b["reachable"]}
            for b, every in strict.items():
                if every:
                    assert near[b] in every and every == strict[near[b]] | {near[b]}


LEAKS = {
    "f = open(p)\nd = f.read()\nf.close()": [],
    "f = open(p)\nd = f.read()": [(1, "f")],
    "with open(p) as f: d = f.read()": [],
    "f = open(p)\nwith f: pass": [],
    "f = open(p)\nif a: f.close()": [(1, "f")],
    "f = open(p)\nif a: f.close()\nelse: f.close()": [],
    "f = open(p)\ntry:\n  f.read()\nfinally:\n  f.close()": [],
    "f = open(p)\ntry:\n  f.read()\n  f.close()\nexcept E: pass": [(1, "f")],
    "try:\n  f = open(p)\nexcept E: f = None": [(2, "f")],
    "d = open(p).read()": [(1, "")],
    "f = open(p)\nf = open(q)\nf.close()": [(1, "f")],
    "def g(p):\n  f = open(p)\n  return f": [],
    "def g(p):\n  f = open(p)\n  if p: return 1\n  f.close()": [(2, "f")],
    "def g(p):\n  f = open(p)\n  try:\n    return f.read()\n  finally:\n    f.close()": [],
    "for p in ps:\n  f = open(p)\n  if not p: continue\n  f.close()": [(2, "f")],
    "f = open(p)\nself.f = f": [],
    "f = open(p)\nkeep(f)": [],
    "while a:\n  f = open(p)\n  try:\n    if b: break\n  finally:\n    f.close()": [],
}


@pytest.mark.parametrize("code, want", LEAKS.items())
def test_handles_closed_on_every_way(code, want):
    assert [(x["line"], x["variable"]) for f in flow.analyse(code) for x in f["leaks"]] == want


FLOWS = {
    "q = 'select ' + u\ncur.execute(q)": [("sql_injection", "q", 1, 2)],
    "cur.execute('select %s' % u)": [("sql_injection", "", 1, 1)],
    "cur.execute('select ?', (u,))": [],
    "q = 'select 1'\ncur.execute(q)": [],
    "q = 'select ' + u\nq = 'select 1'\ncur.execute(q)": [],
    "q = 'select 1'\nif a: q = f'select {u}'\ncur.execute(q)": [("sql_injection", "q", 2, 3)],
    "q = 'rm {}'.format(u)\nr = q\nos.system(r)": [("shell_injection", "r", 1, 3)],
    "q = 'rm ' + u\nq = shlex.quote(q)\nos.system(q)": [],
    "q = 'select '\nq += u\ncur.execute(q)": [("sql_injection", "q", 2, 3)],
    "q = 'a'\nfor x in xs:\n  q = q + x\ncur.execute(q)": [("sql_injection", "q", 3, 4)],
    "def f(q):\n  cur.execute(q)": [],
    "def f(u):\n  try:\n    q = 'x' + u\n  except E:\n    q = 'y'\n  cur.execute(q)": [("sql_injection", "q", 3, 6)],
    "q = 'a' + 'b'\ncur.execute(q)": [],
    "q = 'x' + u if a else 'y'\nsubprocess.run(q, shell=True)": [("shell_injection", "q", 1, 2)],
}


@pytest.mark.parametrize("code, want", FLOWS.items())
def test_built_strings_reach_their_calls(code, want):
    got = [(x["kind"], x["variable"], x["source_line"], x["sink_line"]) for f in flow.analyse(code) for x in f["flows"]]
    assert got == want


def test_tables_errors_and_nothing(spark):
    rows = [(1, "f = open(p)\nif a: f.close()"), (2, "def broken(:"), (3, None), (4, "q = 'x' + u\ncur.execute(q)")]
    files = spark.createDataFrame(rows, "file_id long, code string")
    assert [tuple(r) for r in flow.resource_findings(files).collect()] == [(1, "<module>", 1, "f")]
    assert [tuple(r) for r in flow.flow_findings(files).collect()] == [(4, "<module>", "sql_injection", "q", 1, 2)]
    numbers = {r.file_id: (r.n_blocks, r.n_edges, r.complexity, r.unreachable_lines) for r in flow.cfg_functions(files).collect()}
    assert numbers[1][2] == 2 and numbers[3] == (2, 1, 1, []) and 2 not in numbers
    assert flow.cfg_edges(files).where("file_id = 1").count() == numbers[1][1]
    assert flow.cfg_blocks(files.limit(0)).collect() == []
    assert "Exchange" not in flow.flow_findings(files)._jdf.queryExecution().executedPlan().toString()
