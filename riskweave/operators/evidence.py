"""Rule evidence and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.pystr import bind, java_regex, literal_map, py_strip, split_lines
from riskweave.operators.audit import model_prediction
from riskweave.operators.rules import FINDING_COLUMNS, scan

# Evidence patterns, templates and explanation texts by type.
EVIDENCE_RULES = {
    "hardcoded_password": (r"""password\s*=\s*['"][^'"]+['"]""", "Hardcoded password found: {match}"),
    "eval_usage": (r"\beval\s*\(", "Dangerous eval() function call detected"),
    "sql_injection": (r"""execute\s*\(\s*["'].*%.*["']""", "Potential SQL injection: {match}"),
    "shell_injection": (r"os\.system\s*\(|subprocess\.call\s*\(", "Shell command execution detected: {match}"),
    "weak_crypto": (r"md5\s*\(|sha1\s*\(", "Weak cryptographic hash function: {match}"),
    "bare_except": (r"except\s*:", "Bare except clause detected"),
}
EXPLANATIONS = {
    "hardcoded_password": "Hardcoded passwords in source code are a critical security risk as they can be easily discovered by attackers.",
    "eval_usage": "The eval() function executes arbitrary Python code, making it vulnerable to code injection attacks.",
    "sql_injection": "String concatenation in SQL queries can lead to SQL injection vulnerabilities.",
    "shell_injection": "Direct execution of shell commands with user input can lead to command injection.",
    "weak_crypto": "MD5 and SHA1 are cryptographically broken and should not be used for security purposes.",
    "bare_except": "Bare except clauses can hide important errors and make debugging difficult.",
}
DEFAULT_EXPLANATION = "Security vulnerability detected."

# Private-use characters: a mark before each match, and what a mark already in the text becomes.
# Neither is a letter, a blank or a quote, so the swap changes no match.
MARK, SPARE = "\ue000", "\ue001"


def _no_text() -> Column:
    return F.array().cast("array<string>")


def evidence_of(code: Column, kind: str) -> Column:
    """``Line n: text`` for every match of one type's pattern in the whole text.

    Matches may span lines, so they are taken from the text; a mark put before each match then
    gives the lines they start on.
    """
    pattern, template = EVIDENCE_RULES[kind]
    regex = java_regex(pattern)
    before, has_match, after = template.partition("{match}")

    def text(match):
        return F.concat(F.lit(before), py_strip(match), F.lit(after)) if has_match else F.lit(template)

    def marks_in(line):
        return F.length(line) - F.length(F.replace(line, F.lit(MARK), F.lit("")))

    def texts(x):
        marked = F.regexp_replace(F.replace(x, F.lit(MARK), F.lit(SPARE)), F.lit(regex), F.lit(MARK + "$0"))
        starts = F.flatten(
            F.transform(split_lines(marked), lambda line, i: F.array_repeat(i + 1, marks_in(line)))
        )
        return F.zip_with(
            starts,
            F.regexp_extract_all(x, F.lit(regex), 0),
            lambda n, m: F.concat(F.lit("Line "), n.cast("string"), F.lit(": "), text(m)),
        )

    return F.when(F.rlike(code, F.lit(regex)), bind(code, texts)).otherwise(_no_text())


def evidence(code: Column, kind: Column) -> Column:
    """Evidence for the row's type; an unknown type has none."""
    out = None
    for name in EVIDENCE_RULES:
        value = evidence_of(code, name)
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out.otherwise(_no_text())


def explanation(kind: Column) -> Column:
    return literal_map(EXPLANATIONS, kind, DEFAULT_EXPLANATION)


def explain(files: DataFrame, scope: str = "snippet", attributions: DataFrame | None = None, **options) -> DataFrame:
    """Findings with their explanation, in the scan's own pass.

    ``scope='file'`` looks for evidence in the whole file, once per file and type, before
    the findings are unrolled; ``'snippet'`` looks in the finding's line.  ``attributions``
    (``file_id``, ``feature_importance``, ``shap_values``) adds model attributions.
    """
    if scope not in ("file", "snippet"):
        raise ValueError(f"unknown scope: {scope}")
    scanned = scan(files.withColumn("text", F.col("code")), **options)
    carried = [c for c in scanned.columns if c not in ("findings", "error", "text")]
    if scope == "file":
        kinds = F.array_distinct(F.transform("findings", lambda f: f["vulnerability_type"]))
        by_kind = F.map_from_entries(
            F.transform(kinds, lambda k: F.struct(k.alias("key"), evidence(F.col("text"), k).alias("value")))
        )
        scanned = scanned.withColumn("_evidence", by_kind)
    else:
        scanned = scanned.withColumn("_evidence", F.lit(None).cast("map<string,array<string>>"))
    rows = scanned.select(*carried, "_evidence", F.posexplode_outer("findings").alias("pos", "finding"))
    rows = rows.where("pos is not null").select(
        *carried, "_evidence", (F.col("pos") + 1).alias("finding_no"), *[f"finding.{c}" for c in FINDING_COLUMNS]
    )
    found = F.get(F.map_values(F.map_filter("_evidence", lambda k, v: k == F.col("vulnerability_type"))), F.lit(0))
    if scope == "snippet":
        found = evidence(F.col("code_snippet"), F.col("vulnerability_type"))
    rows = rows.withColumn("rule_evidence", found).drop("_evidence")
    if attributions is not None:
        rows = rows.join(attributions.select("file_id", "feature_importance", "shap_values"), "file_id", "left")
    else:
        rows = rows.withColumns(
            {
                "feature_importance": F.create_map().cast("map<string,double>"),
                "shap_values": F.lit(None).cast("array<double>"),
            }
        )
    return rows.withColumns(
        {
            "vulnerability_id": F.col("rule_id"),
            "confidence_score": F.col("confidence"),
            "explanation_text": explanation(F.col("vulnerability_type")),
        }
    )


def explanation_events(explained: DataFrame, user=None, at=None) -> DataFrame:
    """The audit event of each explanation: what was explained, and with what confidence."""
    rows = explained.withColumns({"prediction": F.col("vulnerability_type"), "confidence": F.col("confidence_score")})
    return model_prediction(rows, "explainability_engine", user, at)


def explanation_summary(explained: DataFrame, top: int = 10) -> DataFrame:
    """``metric, key, value``: count, mean confidence, evidence count, strongest features.

    Nothing at all for no explanations.
    """
    wide = explained.agg(
        F.count("*").cast("double").alias("total_explanations"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.sum(F.size("rule_evidence")).cast("double").alias("rule_evidence_count"),
    ).where("total_explanations > 0")
    names = ("total_explanations", "avg_confidence", "rule_evidence_count")
    totals = wide.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), F.col(n).alias("value")) for n in names]))
    )
    features = (
        explained.select(F.explode("feature_importance").alias("key", "v"))
        .groupBy("key").agg(F.sum(F.abs("v")).alias("value"))
        .orderBy(F.desc("value"), "key").limit(top)
        .select(F.lit("top_features").alias("metric"), "key", "value")
    )
    return totals.unionByName(features)
