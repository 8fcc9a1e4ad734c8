"""Thousands of line rules in one pass, against one rule at a time."""

import random
import re

import pytest

from riskweave.operators import many_rules
from riskweave.operators.rules import FINDING_COLUMNS, LINE_RULES, LineRule
from riskweave.operators.rules import findings as one_by_one


def texts():
    rng = random.Random(12)
    words = ["password = 'x'", "EVAL (a)", "exec(b)", "os.System('l')", "md5(x)", "random.randint(1)", "k1x", "K22 y", "\u212a3", "\u017fha1(", "\u0130f", "\u0131t", "eva", "l(", "x = 1"]
    return [(i, "\n".join("a" + rng.choice([" = ", "(", "\t"]) + "1  # " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 8))).replace("a(1", "a(1)")) for i in range(80)]


def generated(n):
    return [LineRule(f"gen_{i}", rf"\bk{i}\w?", ("low", "medium", "high")[i % 3], f"word {i}", 0.5, (f"k{i}",)) for i in range(n)]


def brute(rows, rules):
    patterns = [(r.key, re.compile(r.pattern, re.IGNORECASE)) for r in rules]
    return sorted((d, n, key) for d, text in rows for n, line in enumerate(text.split("\n"), 1) for key, p in patterns if p.search(line))


def test_thousands_equal_each_alone(spark):
    rules = [*LINE_RULES, *generated(5000), LineRule("free", r"^a.*y$", "info", "no literal"), LineRule("other", "é+", "info", "", literals=("é",))]
    rows = [*texts(), (100, "é É"), (101, ""), (102, "k4999\r\nK17z\n\nk17")]
    frame = spark.createDataFrame([*rows, (103, None)], "file_id long, code string").repartition(3)
    got = many_rules.findings(frame, rules, parsed_only=False)
    assert sorted((r.file_id, r.line_number, r.vulnerability_type) for r in got.collect()) == brute(rows, rules)


def test_equal_to_the_scan(spark):
    rows = [*texts(), (100, "def broken(:\neval(x)"), (101, "eval (x)\n  exec(y)  ")]
    frame = spark.createDataFrame(rows, "file_id long, code string")
    rules = [*LINE_RULES, *generated(3)]
    want = one_by_one(frame, line_rules=rules, tree_rules=(), syntax_errors=False).select("file_id", *FINDING_COLUMNS)
    got = many_rules.findings(frame, rules).select("file_id", *FINDING_COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count()


def test_plan_does_not_grow_with_the_rules(spark):
    frame = spark.createDataFrame(texts(), "file_id long, code string")
    size = lambda n: len(many_rules.findings(frame, generated(n))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(5000) - size(50)) < 2000
    assert many_rules.findings(frame, []).collect() == []
    with pytest.raises(ValueError, match="characters"):
        many_rules.findings(frame, [LineRule("long", "x" * (many_rules.MOST_CHARS + 1), "low", "")])
