import pytest

from riskweave.operators import lines, nodes, rules
from riskweave.plans import golden
from riskweave.session import tune

SCHEMA = "file_id int, file_path string, code string"


def files(spark, *codes):
    tune(spark)
    return spark.createDataFrame([(i, f"f{i}.py", code) for i, code in enumerate(codes)], SCHEMA)


def found(spark, *codes, **options):
    rows = rules.findings(files(spark, *codes), **options).orderBy("file_id", "finding_no").collect()
    return [(r.file_id, r.rule_id, r.line_number, r.column_number) for r in rows]


def brute_force(code):
    """Findings of one text straight from the definitions."""
    import re

    out = []
    tree, error = golden.parse(code)
    if error is None:
        for number, line in enumerate(code.split("\n"), 1):
            for order, rule in enumerate(rules.LINE_RULES):
                if re.search(rule.pattern, line, re.IGNORECASE):
                    out.append((rules.SEVERITY_RANK[rule.severity], number, 0, order, 0, rule.key.upper(), line.strip(), 0))
    for row in golden.tree_findings_of(code):
        line, column, _, severity, _, snippet, _, rule_id, seq, seq2 = row
        out.append((rules.SEVERITY_RANK[severity], line, 1, seq, seq2, rule_id, snippet, column))
    return [(r[5], r[1], r[7], r[6]) for r in sorted(out)]


TRICKY = [
    "",
    "\n",
    "x = eval('1')\n",
    "\tif 1:\n  x = 2",
    "é = eval(input('é')); password\u00a0=\u2003'geheim'\n",
    "PA\u017f\u017fWORD = 'lang'\n",
    "p = 'pa\u017f\u017fword = \"q\"'\n",
    "h = ha\u017flib.\u017fha1 (b)\n",
    "try:\n    exec(a)\nexcept:\n    try:\n        compile(b, '', 'eval')\n    except: pass\n",
    "try:\n    pass\nexcept* ValueError:\n    eval(x)\n",
    "cur.execute('a\x85b % c')\nos.system (x); subprocess.call(x); md5(x); random.random()\n",
    "def f(:\n    password = 'x'\n",
    "x = '''\npassword = 'inside'\n'''\neval\n(x)\n",
    "   # indented comment\nprint(1)\x1c\n",
    "a = b'\\xff'; s = '\\ud800'; input()\n",
    "password = 'one' ; password = 'two'\npassword == 'three'\n",
]


@pytest.mark.parametrize("batch", [TRICKY, [code for _, _, code in golden.pairs()]])
def test_scan_equals_brute_force(spark, batch):
    rows = rules.findings(files(spark, *batch)).orderBy("file_id", "finding_no").collect()
    got = {i: [] for i in range(len(batch))}
    for r in rows:
        got[r.file_id].append((r.rule_id, r.line_number, r.column_number, r.code_snippet))
    assert got == {i: brute_force(code) for i, code in enumerate(batch)}


def test_template_parse_masks():
    # Which templates parse in contexts 0 to 5.
    usual = "111011"
    masks = {24: "100010", 25: "011001", 26: "100010", 36: "000000"}
    for t in range(37):
        seen = "".join(str(int(golden.parse(golden.code_of(t, c))[0] is not None)) for c in range(6))
        assert seen == masks.get(t, usual), t


def test_unparsable_text_gives_only_its_error(spark):
    assert [r[1] for r in found(spark, "def broken(\n    password = 'x'")] == ["SYNTAX_ERROR"]
    assert [r[1] for r in found(spark, "x = 1\0")] == ["SYNTAX_ERROR"]


def test_other_parse_failures_are_recorded_not_raised(spark):
    deep = "x = " + "-" * 200_000 + "1"
    table = files(spark, deep, "eval(x)")
    errors = rules.scan_errors(table).collect()
    assert [(e.file_id, e.kind in ("MemoryError", "RecursionError")) for e in errors] == [(0, True)]
    assert [r[0] for r in found(spark, deep, "eval(x)")] == [1, 1]


def test_rule_selection_and_custom_rules(spark):
    code = "import os\nos.system(x)\neval(y)\n# todo later\n"
    only = [r for r in rules.LINE_RULES if r.key == "shell_injection"]
    assert found(spark, code, line_rules=only, tree_rules=(), syntax_errors=False) == [(0, "SHELL_INJECTION", 2, 0)]
    todo = rules.LineRule("todo", r"^#\s*todo", "info", "Open point")
    assert found(spark, code, line_rules=[todo], tree_rules=(), syntax_errors=False) == [(0, "TODO", 4, 0)]


def test_directory_result_omits_clean_files(spark):
    nested = rules.directory_result(files(spark, "x = 1", "eval(x)"))
    assert [(r.file_path, len(r.findings)) for r in nested.collect()] == [("f1.py", 2)]
    assert rules.flatten_result(nested).count() == 2


def test_severity_filter(spark):
    every = rules.findings(files(spark, "password = 'x'\ninput()"))
    assert rules.by_severity(every, ["critical"]).count() == 1


def test_lines_are_numbered_and_stripped(spark):
    rows = lines.lines(files(spark, " a \n\n\u3000b\x1f")).collect()
    assert [(r.line_number, r.line, r.snippet) for r in rows] == [(1, " a ", "a"), (2, "", ""), (3, "\u3000b\x1f", "b")]


def test_node_table_matches_walk(spark):
    code = "def f(a):\n    '''Doc.'''\n    return a + 'x'\n"
    rows = nodes.ast_nodes(files(spark, code)).orderBy("node_id").collect()
    assert [(r.node_id, r.parent_id, r.depth, r.node_type) for r in rows] == [n[:4] for n in golden.nodes_of(code)]


def test_parse_runs_once_and_scan_does_not_shuffle(spark):
    plan = rules.findings(files(spark, "x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan


def test_scan_accepts_a_stream(spark, tmp_path):
    files(spark, "eval(x)", "y = 1").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = (
        rules.findings(stream).writeStream.format("memory").queryName("streamed_findings")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert spark.table("streamed_findings").count() == 2


def test_files_without_a_rule_s_words_need_no_parse(spark):
    codes = ["x = 1", "eval(y)", "try: a()\nexcept: b()", "ｅｖａｌ(z)", "def broken(:\n eval(1)", "# exec", "obj.eval(1)", "input()"]
    table = spark.createDataFrame([(str(i), f"{i}.py", c) for i, c in enumerate(codes)], "file_id string, file_path string, code string")
    row = lambda r: (r.file_id, r.rule_id, r.line_number)
    whole = {row(r) for r in rules.findings(table).collect() if r.rule_id != "SYNTAX_ERROR"}
    assert {row(r) for r in rules.findings(table, syntax_errors=False).collect()} == whole
    assert rules.scan(table, syntax_errors=False).count() < len(codes)
    assert ("3", "DANGEROUS_FUNC_EVAL", 1) in whole
