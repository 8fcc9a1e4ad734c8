"""Queries on lines, trees, rules and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import table_functions
from riskweave.operators import lines, many_rules, nodes, rules, summary
from riskweave.plans import golden
from riskweave.plans.golden import values
from riskweave.plans.oracle import LINES_CTE, STRIP, corpus_cte, parses_cte, with_corpus, with_findings
from riskweave.plans.registry import query
from riskweave.session import materialise
from riskweave.sources.corpus import corpus_table

FINDING = "file_id, line_number, column_number, vulnerability_type, severity, description, code_snippet, confidence, rule_id"
_FINDING = FINDING.split(", ")


@query("p01_line_table", with_corpus(f"SELECT file_id, line_number, line, {STRIP.format('line')} AS snippet FROM line_table"))
def _(spark, folder):
    return lines.lines(corpus_table(spark, folder))


def _node_oracle():
    rows = [(t, c, *row) for t, c, code in golden.pairs() for row in golden.nodes_of(code)]
    columns = ["t", "c", "node_id", "parent_id", "depth", "node_type", "lineno", "col_offset", "node_text"]
    return (
        f"WITH {corpus_cte()}, {values('nodes', columns, rows)} "
        "SELECT file_id, node_id, parent_id, depth, node_type, lineno, col_offset, node_text FROM corpus JOIN nodes USING (t, c)"
    )


@query("p02_node_table", _node_oracle)
def _(spark, folder):
    found = nodes.ast_nodes(corpus_table(spark, folder))
    text = F.when(F.col("node_type") == "Name", F.col("name")).otherwise(F.col("str_value"))
    return found.select(
        "file_id", "node_id", "parent_id", "depth", "node_type", "lineno", "col_offset", text.alias("node_text")
    )


@query("p02b_node_function", _node_oracle)
def _(spark, folder):
    """The node table by the table function, called for each file in a FROM clause."""
    table_functions.register(spark)
    return spark.sql(
        """SELECT file_id, node_id, parent_id, depth, node_type, lineno, col_offset,
             CASE WHEN node_type = 'Name' THEN name ELSE str_value END AS node_text
           FROM {files} AS files, LATERAL parse_python(files.code)""",
        files=corpus_table(spark, folder),
    )


def _error_oracle():
    rows = [
        (t, c, e.lineno, e.offset, e.msg)
        for t, c, code in golden.pairs()
        if (e := golden.parse(code)[1]) is not None
    ]
    return (
        f"WITH {corpus_cte()}, {values('errors', ['t', 'c', 'lineno', 'col', 'msg'], rows)} "
        "SELECT file_id, file_path, 'SyntaxError' AS kind, lineno, col AS \"offset\", msg FROM corpus JOIN errors USING (t, c)"
    )


@query("p03_parse_errors", _error_oracle)
def _(spark, folder):
    return nodes.parse_errors(corpus_table(spark, folder))


def _one_rule(name, rule_id, **options):
    @query(name, with_findings(f"SELECT {FINDING} FROM found WHERE rule_id = '{rule_id}'"))
    def _(spark, folder):
        return rules.findings(corpus_table(spark, folder), **options).select(*_FINDING)


for _n, _rule in enumerate(rules.LINE_RULES, 1):
    _one_rule(f"r{_n:02d}_{_rule.key}", _rule.key.upper(), line_rules=[_rule], tree_rules=(), syntax_errors=False)
for _n, _rule in enumerate(rules.TREE_RULES, 8):
    _one_rule(f"r{_n:02d}_{_rule.vulnerability_type}", _rule.rule_id, line_rules=(), tree_rules=[_rule], syntax_errors=False)
_one_rule("r13_syntax_error", "SYNTAX_ERROR", line_rules=(), tree_rules=(), syntax_errors=True)


@query("r14_scan", with_findings(f"SELECT file_path, {FINDING} FROM found"))
def _(spark, folder):
    return rules.findings(corpus_table(spark, folder)).select("file_path", *_FINDING)


@query("r15_finding_order", with_findings("SELECT file_id, finding_no, severity, line_number, rule_id FROM found"))
def _(spark, folder):
    found = rules.findings(corpus_table(spark, folder))
    return found.select("file_id", "finding_no", "severity", "line_number", "rule_id").orderBy("file_id", "finding_no")


@query("r16_severity_filter", with_findings(f"SELECT {FINDING} FROM found WHERE severity IN ('critical', 'high')"))
def _(spark, folder):
    return rules.by_severity(rules.findings(corpus_table(spark, folder)), ["critical", "high"]).select(*_FINDING)


@query("r17_flatten_directory_result", with_findings("SELECT file_path, rule_id, line_number, code_snippet FROM found"))
def _(spark, folder):
    nested = rules.directory_result(corpus_table(spark, folder))
    return rules.flatten_result(nested).select("file_path", "rule_id", "line_number", "code_snippet")


CLOSED_COMMENT = rules.LineRule("closed_comment", r"^# .*[.]$", "info", "Comment line with a full stop")


@query(
    "r18_custom_rules",
    lambda: with_findings(
        f"""SELECT file_id, line_number, {STRIP.format("line")} AS code_snippet, 'CLOSED_COMMENT' AS rule_id, 'info' AS severity
        FROM line_table JOIN parses USING (t, c) WHERE ok AND regexp_matches(line, '^# .*[.]$', 'i')"""
    )(),
)
def _(spark, folder):
    found = rules.findings(corpus_table(spark, folder), line_rules=[CLOSED_COMMENT], tree_rules=(), syntax_errors=False)
    return found.select("file_id", "line_number", "code_snippet", "rule_id", "severity")


@query("s03_string_scan", with_findings("SELECT file_id, rule_id, count(*) AS n, min(line_number) AS first_line FROM found GROUP BY ALL"))
def _(spark, folder):
    snippets = corpus_table(spark, folder).select("file_id", "code")
    return rules.findings(snippets).groupBy("file_id", "rule_id").agg(
        F.count("*").alias("n"), F.min("line_number").alias("first_line")
    )


# -- aggregates ----------------------------------------------------------------------------------


def _found(spark, folder):
    return rules.findings(corpus_table(spark, folder))


@query(
    "a01_finding_summary",
    with_findings(
        """SELECT 'total' AS metric, '' AS key, count(*) AS value FROM found
        UNION ALL SELECT 'by_severity', severity, count(*) FROM found GROUP BY severity
        UNION ALL SELECT 'by_type', vulnerability_type, count(*) FROM found GROUP BY vulnerability_type
        UNION ALL SELECT 'files_affected', '', count(DISTINCT file_path) FROM found"""
    ),
)
def finding_summary(spark, folder):
    return summary.finding_summary(_found(spark, folder))


@query("a02_severity_counts", with_findings("SELECT severity, count(*) AS n FROM found GROUP BY severity"))
def _(spark, folder):
    return summary.severity_counts(_found(spark, folder))


@query(
    "a03_headline",
    with_findings(
        """SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical,
        count(*) FILTER (severity = 'high') AS high, round(avg(confidence), 9) AS avg_confidence FROM found"""
    ),
)
def _(spark, folder):
    return summary.headline(_found(spark, folder)).withColumn("avg_confidence", F.round("avg_confidence", 9))


def _share_oracle(column):
    return with_findings(
        f"SELECT {column}, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM found GROUP BY {column}"
    )


@query("a04_severity_distribution", _share_oracle("severity"))
def _(spark, folder):
    return summary.distribution(_found(spark, folder), "severity").withColumn("share", F.round("share", 6))


@query("a05_type_distribution", _share_oracle("vulnerability_type"))
def _(spark, folder):
    return summary.distribution(_found(spark, folder), "vulnerability_type").withColumn("share", F.round("share", 6))


@query(
    "a06_confidence_histogram",
    with_findings(
        """SELECT CASE WHEN confidence >= 1 THEN 9 ELSE floor(confidence * 8)::BIGINT + 1 END AS bin,
        round(((CASE WHEN confidence >= 1 THEN 9 ELSE floor(confidence * 8)::BIGINT + 1 END) - 1) * 0.125::DOUBLE, 6) AS bin_start,
        count(*) AS n FROM found GROUP BY 1, 2"""
    ),
)
def _(spark, folder):
    return summary.histogram(_found(spark, folder), "confidence", 0.0, 1.0, 8).withColumn("bin_start", F.round("bin_start", 6))


@query(
    "a07_line_histogram",
    with_findings(
        """SELECT bin, round(low + (bin - 1) * ((high - low) / 20), 6) AS bin_start, count(*) AS n
        FROM (SELECT low, high, floor((line_number - low) / ((high - low) / 20))::BIGINT + 1 AS bin
          FROM found, (SELECT min(line_number)::DOUBLE AS low, max(line_number)::DOUBLE + 1 AS high FROM found)) GROUP BY 1, 2"""
    ),
)
def _(spark, folder):
    found = materialise(_found(spark, folder).select("line_number"), "lines")
    low, high = found.agg(F.min("line_number"), F.max("line_number") + 1).first()
    return summary.histogram(found, "line_number", low or 0, high or 1, 20).withColumn("bin_start", F.round("bin_start", 6))


@query("a08_findings_per_file", with_findings("SELECT file_path, count(*) AS n_findings FROM found GROUP BY file_path"))
def _(spark, folder):
    return summary.per_file(_found(spark, folder))


_LETTERS = "etaonirshdlucmfw"


def _generated(n: int = 5000) -> list[rules.LineRule]:
    """Rules for runs of four letters, by counting; each may be followed by an s."""
    out = []
    for i in range(n):
        number = i * 13 % len(_LETTERS) ** 4
        word = "".join(_LETTERS[number // len(_LETTERS) ** k % len(_LETTERS)] for k in range(4))
        out.append(rules.LineRule(f"run_{word}", word + "s?", ("low", "medium", "high")[i % 3], f"letters {word}", 0.5, (word,)))
    return out


def _generated_oracle():
    words = [(r.literals[0], r.severity) for r in _generated()]
    return (
        f"WITH {corpus_cte()}, {LINES_CTE}, {parses_cte()}, {values('runs', ['word', 'severity'], words)}, "
        "grams AS (SELECT DISTINCT file_id, line_number, lower(substr(line, i, 4)) AS word "
        "FROM (SELECT file_id, line_number, line, unnest(range(1, length(line) - 2)) AS i FROM line_table JOIN parses USING (t, c) WHERE ok)) "
        "SELECT file_id, line_number, 'RUN_' || upper(word) AS rule_id, severity FROM grams JOIN runs USING (word)"
    )


@query("r18b_many_rules", _generated_oracle)
def _(spark, folder):
    """Five thousand rules in one pass over every file."""
    return many_rules.findings(corpus_table(spark, folder), _generated()).select("file_id", "line_number", "rule_id", "severity")
