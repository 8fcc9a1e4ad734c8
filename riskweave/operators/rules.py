"""Rules and the scan: files in, findings out, without a shuffle.

Everything a file yields stays in that file's row until the findings are unrolled, so the
scan is a map over splits whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.pystr import (
    PY_SPACE, ignore_case_contains, java_regex, literal_map, split_lines, sql_text,
)
from riskweave.operators.nodes import RULE_NODES, with_tree


@dataclass(frozen=True)
class LineRule:
    """A case-insensitive pattern searched in every line.

    ``literals`` are lower-case words of which every match holds one.  Giving them also says that
    a line match is a match in the whole text; both let the scan skip the lines of most files.
    Patterns with anchors or look-around leave them out.
    """

    key: str
    pattern: str
    severity: str
    description: str
    confidence: float = 0.8
    literals: tuple[str, ...] = ()


@dataclass(frozen=True)
class TreeRule:
    """A plain-name call (``call_name``), or a handler without a type (``call_name`` None)."""

    vulnerability_type: str
    rule_id: str
    severity: str
    description: str
    confidence: float
    call_name: str | None = None


# Rule keys, patterns, severities, descriptions and confidences.
LINE_RULES = (
    LineRule("hardcoded_password", r"""password\s*=\s*['"][^'"]+['"]""", "critical",
             "Hardcoded password detected", literals=("password",)),
    LineRule("eval_usage", r"\beval\s*\(", "high",
             "Use of eval() function detected", literals=("eval",)),
    LineRule("exec_usage", r"\bexec\s*\(", "high",
             "Use of exec() function detected", literals=("exec",)),
    LineRule("sql_injection", r"""execute\s*\(\s*["'].*%.*["']""", "critical",
             "Potential SQL injection vulnerability", literals=("execute",)),
    LineRule("shell_injection", r"os\.system\s*\(|subprocess\.call\s*\(", "high",
             "Potential shell injection vulnerability", literals=("os.system", "subprocess.call")),
    LineRule("weak_crypto", r"md5\s*\(|sha1\s*\(", "medium",
             "Use of weak cryptographic hash function", literals=("md5", "sha1")),
    LineRule("insecure_random", r"random\.random\s*\(|random\.randint\s*\(", "medium",
             "Use of insecure random number generation", literals=("random.rand",)),
)
TREE_RULES = (
    TreeRule("dangerous_function_eval", "DANGEROUS_FUNC_EVAL", "high",
             "Use of eval() function", 0.9, "eval"),
    TreeRule("dangerous_function_exec", "DANGEROUS_FUNC_EXEC", "high",
             "Use of exec() function", 0.9, "exec"),
    TreeRule("dangerous_function_compile", "DANGEROUS_FUNC_COMPILE", "medium",
             "Use of compile() function", 0.9, "compile"),
    TreeRule("dangerous_function_input", "DANGEROUS_FUNC_INPUT", "low",
             "Use of input() function without validation", 0.9, "input"),
    TreeRule("bare_except", "BARE_EXCEPT", "medium", "Bare except clause detected", 0.7),
)
SYNTAX_ERROR = TreeRule("syntax_error", "SYNTAX_ERROR", "medium", "Syntax error: ", 1.0)
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
SEVERITY_LABEL = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}

FINDING_COLUMNS = (
    "line_number", "column_number", "vulnerability_type", "severity",
    "description", "code_snippet", "confidence", "rule_id",
)


def severity_rank(severity: Column) -> Column:
    return literal_map(SEVERITY_RANK, severity, 5)


def severity_label(severity: Column) -> Column:
    return literal_map(SEVERITY_LABEL, severity, 0)


def _finding(rule, severity, description, rule_id, kind, line, column, snippet, stage, seq, seq2) -> str:
    """SQL of a finding; the leading fields order a file's findings."""
    return f"""named_struct(
      'severity_rank', {SEVERITY_RANK.get(severity, 5)}, 'line_number', {line}, 'stage', {stage},
      'seq', {seq}, 'seq2', {seq2}, 'column_number', {column}, 'vulnerability_type', {sql_text(kind)},
      'severity', {sql_text(severity)}, 'description', {description}, 'code_snippet', {snippet},
      'confidence', {float(rule.confidence)!r}D, 'rule_id', {sql_text(rule_id)})"""


def _may_match(rule: LineRule) -> Column:
    """A test of the whole text that every file with a matching line passes."""
    pattern = F.lit(java_regex(rule.pattern))
    return ignore_case_contains(F.col("code"), rule.literals) & F.rlike("code", pattern)


def _may_hold(rule: TreeRule) -> Column:
    """A test of the whole text that every file with a matching node passes.

    The parser folds other letters into ASCII names, so a text with any is let through.
    """
    word = rule.call_name if rule.call_name is not None else "except"
    return F.contains(F.col("code"), F.lit(word)) | F.rlike("code", F.lit(r"[^\x00-\x7F]"))


def _line_findings(rule: LineRule, order: int) -> Column:
    snippet = f"btrim(x.line, {sql_text(PY_SPACE)})"
    finding = _finding(
        rule, rule.severity, sql_text(rule.description), rule.key.upper(), rule.key,
        "x.n", 0, snippet, 0, order, 0,
    )
    found = F.expr(f"""transform(
        filter(
          transform(lines, (line, i) -> named_struct('n', i + 1, 'line', line)),
          x -> rlike(x.line, {sql_text(java_regex(rule.pattern))})),
        x -> {finding})""")
    return F.when(F.col(f"_may_match_{order}"), found) if rule.literals else found


def _raw_line(number: str) -> str:
    return f"coalesce(get(lines, {number} - 1), '')"


def _tree_findings(rule: TreeRule) -> Column:
    if rule.call_name is None:
        # Only a plain try may hold a handler without a type, so no check of the parent.  A
        # handler counts where its statement stands in the walk, a call where it stands itself.
        wanted, owner = "n.handler_bare", "n.parent_id"
    else:
        wanted, owner = f"n.call_name = {sql_text(rule.call_name)}", "n.node_id"
    finding = _finding(
        rule, rule.severity, sql_text(rule.description), rule.rule_id, rule.vulnerability_type,
        "n.lineno", "n.col_offset", _raw_line("n.lineno"), 1, owner, "n.node_id",
    )
    return F.expr(f"transform(filter(tree.nodes, n -> {wanted}), n -> {finding})")


def _syntax_findings() -> Column:
    rule = SYNTAX_ERROR
    line = "coalesce(tree.error.lineno, 0)"
    finding = _finding(
        rule, rule.severity, f"concat({sql_text(rule.description)}, tree.error.msg)", rule.rule_id,
        rule.vulnerability_type, line, "coalesce(tree.error.offset, 0)",
        f"if({line} > 0, {_raw_line(line)}, '')", 1, 0, 0,
    )
    return F.expr(f"array({finding})")


def scan(
    files: DataFrame,
    line_rules=LINE_RULES,
    tree_rules=TREE_RULES,
    syntax_errors: bool = True,
) -> DataFrame:
    """Add ``findings`` (ordered by severity then line) and ``error`` to each file's row.

    A file that does not parse yields only its syntax error.  When syntax errors are not asked for, files
    that no rule can match are dropped before the parse.
    """
    line_rules, tree_rules = tuple(line_rules), tuple(tree_rules)
    carried = [name for name in files.columns if name != "code"]
    if not syntax_errors and all(r.literals for r in line_rules):
        hit = F.lit(False)
        for rule in line_rules:
            hit = hit | _may_match(rule)
        for rule in tree_rules:
            hit = hit | _may_hold(rule)
        files = files.where(hit)
    # Columns of their own, so that the text is folded once for all rules.
    may_match = {f"_may_match_{i}": _may_match(rule) for i, rule in enumerate(line_rules) if rule.literals}
    parsed = with_tree(files, RULE_NODES).withColumns({"lines": split_lines(F.col("code")), **may_match})
    parts = [_line_findings(rule, i) for i, rule in enumerate(line_rules)]
    parts += [_tree_findings(rule) for rule in tree_rules]
    none = F.slice(_syntax_findings(), 1, 0)
    clean = none if not parts else F.concat(*[F.coalesce(part, none) for part in parts])
    broken = F.col("tree.error.kind") == "SyntaxError"
    found = (
        F.when(F.col("tree.error").isNull(), F.sort_array(clean))
        .when(broken, _syntax_findings() if syntax_errors else none)
        .otherwise(none)
    )
    return parsed.select(*carried, F.col("tree.error").alias("error"), found.alias("findings"))


def findings(files: DataFrame, **options) -> DataFrame:
    """The flat findings table; ``finding_no`` is a finding's place within its file."""
    scanned = scan(files, **options)
    carried = [name for name in scanned.columns if name not in ("findings", "error", *FINDING_COLUMNS)]
    # The outer form keeps the optimizer from testing the array for emptiness first, which would
    # run every rule twice on the files that have findings.
    rows = scanned.select(*carried, F.posexplode_outer("findings").alias("pos", "finding"))
    rows = rows.where("pos is not null")
    return rows.select(
        *carried,
        (F.col("pos") + 1).alias("finding_no"),
        *[F.col(f"finding.{name}").alias(name) for name in FINDING_COLUMNS],
    )


def scan_errors(files: DataFrame) -> DataFrame:
    """Files whose parse failed for a reason other than their syntax (depth, memory)."""
    return (
        scan(files)
        .where("error.kind <> 'SyntaxError'")
        .select("file_id", "file_path", F.col("error.kind").alias("kind"), F.col("error.msg").alias("msg"))
    )


def by_severity(found: DataFrame, severities) -> DataFrame:
    return found.where(F.col("severity").isin(list(severities)))


def directory_result(files: DataFrame, **options) -> DataFrame:
    """``file_path, findings``: one row per file that has any."""
    return scan(files, **options).select("file_path", "findings").where(F.size("findings") > 0)


def flatten_result(nested: DataFrame) -> DataFrame:
    """A directory result as flat findings that carry their path."""
    return nested.select("file_path", F.explode("findings").alias("finding")).select(
        "file_path", *[F.col(f"finding.{name}").alias(name) for name in FINDING_COLUMNS]
    )
