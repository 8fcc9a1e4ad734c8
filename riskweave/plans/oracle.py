"""Common table expressions of the SQL oracles."""

from __future__ import annotations

import functools

from riskweave.operators.rules import LINE_RULES, SEVERITY_RANK
from riskweave.plans import golden
from riskweave.plans.golden import FEATURES, literal, values
from riskweave.sources.corpus import CONTEXTS, DEFAULT_SEVERITY, SEVERITY_BY_TYPE, TEMPLATES


def case_of(column: str, mapping: dict, default) -> str:
    arms = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {literal(default)} END"


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@functools.lru_cache(maxsize=None)
def corpus_cte() -> str:
    """``corpus``: the code relation with template ``t`` and context ``c``."""
    return f"""
{values("tmpl", ["t", "template_type", "body"], [(i, k, b) for i, (k, b) in enumerate(TEMPLATES)])},
{values("ctx", ["c", "prefix"], list(enumerate(CONTEXTS)))},
corpus AS (
  SELECT d.doc_id AS file_id, 'src/' || d.source || '/f' || d.doc_id || '.py' AS file_path,
    prefix || CASE WHEN rtrim(prefix, ' ' || chr(10)) LIKE '%:' THEN chr(10) || '    ' ELSE chr(10) END || body
      || chr(10) || '# ' || replace(d.text, chr(10), chr(10) || '# ') AS code,
    template_type, {case_of("template_type", SEVERITY_BY_TYPE, DEFAULT_SEVERITY)} AS severity, d.source, t, c
  FROM documents d JOIN tmpl ON t = d.doc_id % {len(TEMPLATES)}
    JOIN ctx ON c = (d.doc_id // {len(TEMPLATES)}) % {len(CONTEXTS)})"""


LINES_CTE = """
line_table AS (
  SELECT * EXCLUDE (code), unnest(string_split(code, chr(10))) AS line,
    generate_subscripts(string_split(code, chr(10)), 1)::INTEGER AS line_number
  FROM corpus)"""


@functools.lru_cache(maxsize=None)
def parses_cte() -> str:
    rows = [(t, c, golden.parse(code)[0] is not None) for t, c, code in golden.pairs()]
    return values("parses", ["t", "c", "ok"], rows)


@functools.lru_cache(maxsize=None)
def features_cte() -> str:
    rows = [(t, c, *[float(v) for v in golden.features_of(code).values()]) for t, c, code in golden.pairs()]
    return values("tree_features", ["t", "c", *FEATURES], rows)


@functools.lru_cache(maxsize=None)
def findings_cte() -> str:
    """``found``: every finding of the corpus, line rules by SQL, tree rules by template."""
    rules = [(i, r.key, r.pattern, r.severity, r.description) for i, r in enumerate(LINE_RULES)]
    tree = [(t, c, *row) for t, c, code in golden.pairs() for row in golden.tree_findings_of(code)]
    columns = ["t", "c", "line_number", "column_number", "vulnerability_type", "severity", "description",
               "code_snippet", "confidence", "rule_id", "seq", "seq2"]
    return f"""{corpus_cte()}, {LINES_CTE}, {parses_cte()},
{values("rules", ["ord", "key", "pattern", "severity", "description"], rules)},
{values("tree_found", columns, tree)},
unordered AS (
  SELECT file_id, file_path, line_number, 0 AS column_number, r.key AS vulnerability_type, r.severity, r.description,
    {STRIP.format("line")} AS code_snippet, 0.8::DOUBLE AS confidence, upper(r.key) AS rule_id, 0 AS stage, r.ord AS seq, 0 AS seq2
  FROM line_table JOIN parses USING (t, c), rules r
  WHERE ok AND regexp_matches(line, r.pattern, 'i')
  UNION ALL
  SELECT file_id, file_path, f.line_number, f.column_number, vulnerability_type, f.severity, f.description,
    code_snippet, confidence, rule_id, 1, seq, seq2
  FROM corpus JOIN tree_found f USING (t, c)),
found AS (
  SELECT file_id, file_path, row_number() OVER (PARTITION BY file_id ORDER BY
      {case_of("severity", SEVERITY_RANK, 5)}, line_number, stage, seq, seq2)::INTEGER AS finding_no,
    line_number, column_number, vulnerability_type, severity, description, code_snippet, confidence, rule_id
  FROM unordered)"""


def with_findings(select: str):
    return lambda: f"WITH {findings_cte()} {select}"


def with_corpus(select: str):
    return lambda: f"WITH {corpus_cte()}, {LINES_CTE} {select}"


def with_features(select: str):
    """``feats``: every feature of every file, text ones by SQL."""
    return lambda: f"WITH {features_frame_cte()} {select}"


@functools.lru_cache(maxsize=None)
def features_frame_cte() -> str:
    tree = ", ".join(f"g.{name}" for name in FEATURES)
    return f"""{corpus_cte()}, {LINES_CTE}, {features_cte()},
text_features AS (
  SELECT file_id, count(*)::INTEGER AS line_count, sum(length(line))::DOUBLE / count(*) AS avg_line_length,
    max(length(line))::INTEGER AS max_line_length,
    count(*) FILTER ({STRIP.format("line")} = '')::INTEGER AS empty_lines,
    count(*) FILTER ({STRIP.format("line")} LIKE '#%')::INTEGER AS comment_lines
  FROM line_table GROUP BY file_id),
feats AS (
  SELECT corpus.file_id, corpus.file_path, corpus.template_type, corpus.severity, {tree},
    line_count, length(code)::INTEGER AS char_count, avg_line_length, max_line_length, empty_lines, comment_lines,
    length(code)::DOUBLE / line_count AS code_density,
    g.cyclomatic_complexity / greatest(g.function_count, 1) AS complexity_ratio
  FROM corpus JOIN tree_features g USING (t, c) JOIN text_features USING (file_id))"""
