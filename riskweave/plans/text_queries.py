"""Queries on personal data, evidence, audit events and the scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import text as helpers
from riskweave.operators import audit, evidence, pii, ranks, rules
from riskweave.operators.evidence import DEFAULT_EXPLANATION, EVIDENCE_RULES, EXPLANATIONS
from riskweave.operators.pii import PII_GROUPS, PII_PATTERNS
from riskweave.plans.golden import literal
from riskweave.plans.oracle import case_of, with_corpus, with_findings
from riskweave.plans.registry import query
from riskweave.session import spread
from riskweave.sources.corpus import corpus_table, table


def documents(spark, folder, *columns):
    return spread(table(spark, folder, "documents").select("doc_id", *columns), "doc_id")


# -- personal data -------------------------------------------------------------------------------


def _detected_cte(source="documents", key="doc_id", text="text"):
    parts = []
    for kind, pattern in PII_PATTERNS.items():
        sql = literal("(?i)" + pattern)
        groups = [f"regexp_extract_all({text}, {sql}, {g})" for g in range(1, PII_GROUPS.get(kind, 0) + 1)]
        joined = " || '|' || ".join(f"({g})[i]" for g in groups) if groups else "''"
        parts.append(
            f"""SELECT {key}, '{kind}' AS pii_type, i::INTEGER AS match_no, m[i] AS match, {joined} AS groups FROM
            (SELECT {key}, {text}, m, unnest(generate_series(1, len(m))) AS i FROM
              (SELECT {key}, {text}, regexp_extract_all({text}, {sql}) AS m FROM {source}))"""
        )
    return f"detected AS ({' UNION ALL '.join(parts)})"


@query("xp1_detect_pii", f"WITH {_detected_cte()} SELECT doc_id, pii_type, match_no, match, groups FROM detected")
def _(spark, folder):
    found = pii.detect(documents(spark, folder, "text"))
    return found.withColumn("groups", F.array_join("groups", "|"))


@query("xp1b_detect_pii_pages", f"WITH {_detected_cte('pages', 'page_id', 'html')} SELECT page_id, pii_type, match_no, match FROM detected")
def _(spark, folder):
    pages = spread(table(spark, folder, "pages").select("page_id", "html"), "page_id")
    return pii.detect(pages, "html").drop("groups")


def _redact_oracle():
    """Pieces between matches and masked matches woven together, one pattern after another."""
    steps, source = [], "SELECT doc_id, text AS s FROM documents"
    for i, (kind, pattern) in enumerate(PII_PATTERNS.items()):
        sql = literal("(?i)" + pattern)
        steps.append(f"c{i} AS (SELECT doc_id, s, regexp_extract_all(s, {sql}) AS m, regexp_split_to_array(s, {sql}) AS p FROM ({source}))")
        mask = ("CASE WHEN length(m[j]) <= 4 THEN repeat('*', length(m[j])) "
                "ELSE m[j][1:2] || repeat('*', length(m[j]) - 4) || right(m[j], 2) END")
        steps.append(
            f"""s{i} AS (SELECT doc_id, CASE WHEN len(m) = 0 THEN s ELSE
              (SELECT string_agg(p[j] || coalesce({mask}, ''), '' ORDER BY j) FROM generate_series(1, len(p)) g(j)) END AS s FROM c{i})"""
        )
        source = f"SELECT doc_id, s FROM s{i}"
    return f"WITH {', '.join(steps)} SELECT doc_id, s AS redacted FROM s{len(PII_PATTERNS) - 1}"


@query("xp2_redact_pii", _redact_oracle)
def _(spark, folder):
    return documents(spark, folder, "text").select("doc_id", pii.redact(F.col("text")).alias("redacted"))


@query("xp3_hash_sensitive", "SELECT doc_id, substr(sha256(text || 'pepper'), 1, 16) AS hashed FROM documents")
def _(spark, folder):
    return documents(spark, folder, "text").select("doc_id", pii.hash_sensitive(F.col("text"), "pepper").alias("hashed"))


@query(
    "xp4_protect_output",
    lambda: f"""WITH {_detected_cte()}, red AS ({_redact_oracle()})
      SELECT doc_id, string_agg(DISTINCT pii_type, ',' ORDER BY pii_type) AS pii_types, md5(any_value(redacted)) AS protected_md5
      FROM detected JOIN red USING (doc_id) GROUP BY doc_id""",
)
def _(spark, folder):
    protected = pii.protect(documents(spark, folder, "text")).where(F.size("pii_types") > 0)
    return protected.select(
        "doc_id", F.array_join(F.array_sort("pii_types"), ",").alias("pii_types"), F.md5("protected_text").alias("protected_md5")
    )


@query(
    "xp5_pii_summary",
    f"WITH {_detected_cte('documents', 'doc_id, source, lang')} SELECT source, lang, pii_type, count(*) AS n_matches, count(DISTINCT doc_id) AS n_rows FROM detected GROUP BY ALL",
)
def _(spark, folder):
    return pii.pii_summary(pii.detect(documents(spark, folder, "source", "lang", "text")), ["source", "lang"])


# -- evidence ------------------------------------------------------------------------------------


def _evidence_cte():
    parts = []
    for kind, (pattern, template) in EVIDENCE_RULES.items():
        sql = literal("(?i)" + pattern)
        before, has_match, after = template.partition("{match}")
        text = literal(before) + (f" || trim(m[i]) || {literal(after)}" if has_match else "")
        parts.append(
            f"""SELECT file_id, '{kind}' AS vulnerability_type, i::INTEGER AS evidence_no,
              'Line ' || (1 + list_sum(list_transform(p[1:i], lambda x: length(x) - length(replace(x, chr(10), ''))))
                + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x) - length(replace(x, chr(10), '')))), 0))::BIGINT
              || ': ' || {text} AS evidence
            FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM
              (SELECT file_id, regexp_extract_all(code, {sql}) AS m, regexp_split_to_array(code, {sql}) AS p FROM corpus))"""
        )
    return f"evidence AS ({' UNION ALL '.join(parts)})"


def _evidence_oracle():
    return with_corpus("")().rstrip() + f", {_evidence_cte()} SELECT * FROM evidence"


@query("xe1_rule_evidence", _evidence_oracle)
def _(spark, folder):
    files = corpus_table(spark, folder)
    kinds = F.explode(F.array(*[F.lit(k) for k in EVIDENCE_RULES])).alias("vulnerability_type")
    rows = files.select("file_id", "code", kinds)
    texts = evidence.evidence(F.col("code"), F.col("vulnerability_type"))
    return rows.select("file_id", "vulnerability_type", F.posexplode(texts).alias("pos", "evidence")).select(
        "file_id", "vulnerability_type", (F.col("pos") + 1).alias("evidence_no"), "evidence"
    )


_EXPLAIN = case_of("vulnerability_type", EXPLANATIONS, DEFAULT_EXPLANATION)


@query("xe2_rule_explanation", with_findings(f"SELECT file_id, finding_no, {_EXPLAIN} AS explanation FROM found"))
def _(spark, folder):
    found = rules.findings(corpus_table(spark, folder))
    return found.select("file_id", "finding_no", evidence.explanation(F.col("vulnerability_type")).alias("explanation"))


def _explain_oracle():
    return with_findings("")().rstrip() + f""", {_evidence_cte()}
      SELECT file_id, finding_no, rule_id AS vulnerability_id, confidence AS confidence_score, {_EXPLAIN} AS explanation_text,
        coalesce((SELECT string_agg(evidence, ' / ' ORDER BY evidence_no) FROM evidence e
          WHERE e.file_id = found.file_id AND e.vulnerability_type = found.vulnerability_type), '') AS rule_evidence FROM found"""


@query("xe3_explain_finding", _explain_oracle)
def _(spark, folder):
    explained = evidence.explain(corpus_table(spark, folder), scope="file")
    return explained.select(
        "file_id", "finding_no", "vulnerability_id", "confidence_score", "explanation_text",
        F.array_join("rule_evidence", " / ").alias("rule_evidence"),
    )


_SNIPPET_EVIDENCE = "CASE " + " ".join(
    f"WHEN vulnerability_type = '{kind}' THEN len(regexp_extract_all(code_snippet, {literal('(?i)' + pattern)}))"
    for kind, (pattern, _) in EVIDENCE_RULES.items()
) + " ELSE 0 END"


@query(
    "xe4_explanation_summary",
    with_findings(
        f"""SELECT 'total_explanations' AS metric, '' AS key, count(*)::DOUBLE AS value FROM found
        UNION ALL SELECT 'avg_confidence', '', round(avg(confidence), 6) FROM found
        UNION ALL SELECT 'rule_evidence_count', '', sum({_SNIPPET_EVIDENCE})::DOUBLE FROM found"""
    ),
)
def _(spark, folder):
    explained = evidence.explain(corpus_table(spark, folder), scope="snippet")
    return evidence.explanation_summary(explained).withColumn("value", F.round("value", 6))


# -- audit events --------------------------------------------------------------------------------

AT = "2024-01-02 03:04:05"
_STAMP = "Timestamp: 2024-01-02T03:04:05.000000"


def _audit(events):
    return events.select("level", "event_type", "user_id", "message", F.col("event_date").cast("string").alias("event_date"))


def _audit_sql(event, body, level="'INFO'", user="anonymous"):
    return (
        f"SELECT {level} AS level, '{event}' AS event_type, '{user}' AS user_id, '{event} - ' || {body} || ', User: {user}, {_STAMP}' AS message, "
        "'2024-01-02' AS event_date FROM "
    )


@query("u1_analysis_start", with_findings(_audit_sql("ANALYSIS_START", "'File: ' || file_path") + "corpus"))
def _(spark, folder):
    return _audit(audit.analysis_start(corpus_table(spark, folder), at=AT))


@query(
    "u2_analysis_complete",
    with_findings(
        _audit_sql("ANALYSIS_COMPLETE", "'File: ' || file_path || ', Vulnerabilities: ' || n", user="reviewer")
        + "(SELECT corpus.file_path, count(rule_id) AS n FROM corpus LEFT JOIN found USING (file_id) GROUP BY file_id, corpus.file_path)"
    ),
)
def _(spark, folder):
    return _audit(audit.analysis_complete(rules.scan(corpus_table(spark, folder)), user="reviewer", at=AT))


@query(
    "u3_vulnerability_detected",
    with_findings(
        _audit_sql("VULNERABILITY_DETECTED", "'Type: ' || vulnerability_type || ', Severity: ' || severity || ', File: ' || file_path || ', Line: ' || line_number") + "found"
    ),
)
def _(spark, folder):
    return _audit(audit.vulnerability_detected(rules.findings(corpus_table(spark, folder)), at=AT))


@query(
    "u4_model_prediction",
    _audit_sql("MODEL_PREDICTION", "'Model: length_score, Prediction: ' || (confidence >= 0.5::DOUBLE)::INTEGER || ', Confidence: ' || printf('%.3f', confidence)")
    + "(SELECT n_chars / (n_chars + 2000.0::DOUBLE) AS confidence FROM documents)",
)
def _(spark, folder):
    scored = documents(spark, folder, "n_chars").withColumn("confidence", F.col("n_chars") / (F.col("n_chars") + 2000.0))
    scored = scored.withColumn("prediction", (F.col("confidence") >= 0.5).cast("int"))
    return _audit(audit.model_prediction(scored, "length_score", at=AT))


@query(
    "u5_pii_detected",
    f"WITH {_detected_cte()} " + _audit_sql("PII_DETECTED", "'Type: ' || pii_type || ', File: doc' || doc_id", "'WARNING'")
    + "(SELECT DISTINCT doc_id, pii_type FROM detected)",
)
def _(spark, folder):
    protected = pii.protect(documents(spark, folder, "text"))
    place = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return _audit(audit.pii_detected(protected, place, at=AT))


_EVENT_SEVERITY = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' ELSE 'low' END"


@query(
    "u6_security_event",
    _audit_sql(
        "SECURITY_EVENT", "'Type: ' || event_type || ', Description: value ' || event_id || ', Severity: ' || severity",
        "CASE WHEN severity IN ('high', 'critical') THEN 'WARNING' ELSE 'INFO' END",
    )
    + f"(SELECT event_type, event_id, {_EVENT_SEVERITY} AS severity FROM events)",
)
def _(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("event_type").alias("event"),
        F.concat(F.lit("value "), F.col("event_id").cast("string")).alias("description"),
        F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high")
        .otherwise("low").alias("severity"),
    )
    return _audit(audit.security_event(events, at=AT))


# -- scalar helpers ------------------------------------------------------------------------------


def _size_sql(column):
    arms = " ".join(
        f"WHEN {column} < {1024 ** (i + 1)} THEN printf('%.1f{unit}', {column}::DOUBLE / {1024 ** i})"
        for i, unit in enumerate(helpers.SIZE_UNITS[:-1])
    )
    return f"CASE WHEN {column} = 0 THEN '0B' {arms} ELSE printf('%.1fTB', {column}::DOUBLE / {1024 ** 4}) END"


@query("h01_format_file_size", f"SELECT doc_id, size, {_size_sql('size')} AS text FROM (SELECT doc_id, n_chars * n_chars * (doc_id % 5) AS size FROM documents)")
def _(spark, folder):
    size = F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 5)
    sized = documents(spark, folder, "n_chars").select("doc_id", size.alias("size"))
    return sized.withColumn("text", helpers.format_file_size(F.col("size")))


@query(
    "h02_format_duration",
    """SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60.0::DOUBLE)
      ELSE printf('%.1fh', s / 3600.0::DOUBLE) END AS text FROM (SELECT event_id, value * (1 + event_id % 50) AS s FROM events)""",
)
def _(spark, folder):
    seconds = F.col("value") * (1 + F.col("event_id") % 50)
    return table(spark, folder, "events").select("event_id", helpers.format_duration(seconds).alias("text"))


@query(
    "h03_sanitize_filename",
    """SELECT page_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS name FROM
      (SELECT page_id, trim(regexp_replace(' .' || url || '. ', '[<>:"/\\\\|?*]', '_', 'g'), ' .') AS s FROM pages)""",
)
def _(spark, folder):
    name = F.concat(F.lit(" ."), F.col("url"), F.lit(". "))
    return table(spark, folder, "pages").select("page_id", helpers.sanitize_filename(name).alias("name"))


@query(
    "h04_safe_divide",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1.0::DOUBLE ELSE value / (event_id % 7)::DOUBLE END AS ratio FROM events",
)
def _(spark, folder):
    below = (F.col("event_id") % 7).cast("double")
    return table(spark, folder, "events").select("event_id", helpers.safe_divide(F.col("value"), below, -1.0).alias("ratio"))


@query("h05_clamp", "SELECT event_id, greatest(10.0::DOUBLE, least(value, 60.0::DOUBLE)) AS clamped FROM events")
def _(spark, folder):
    return table(spark, folder, "events").select("event_id", helpers.clamp(F.col("value"), 10.0, 60.0).alias("clamped"))


@query(
    "h06_is_valid_email",
    f"WITH {_detected_cte()} SELECT doc_id, match_no, pii_type, match, regexp_matches(match, {literal(helpers.EMAIL)}) AS valid FROM detected",
)
def _(spark, folder):
    found = pii.detect(documents(spark, folder, "text"))
    return found.select("doc_id", "match_no", "pii_type", "match", helpers.is_valid_email(F.col("match")).alias("valid"))


@query(
    "h07_is_valid_url",
    f"SELECT page_id, regexp_matches(url, {literal(helpers.URL)}) AS valid, regexp_matches('ftp' || url, {literal(helpers.URL)}) AS ftp FROM pages",
)
def _(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", helpers.is_valid_url(F.col("url")).alias("valid"),
        helpers.is_valid_url(F.concat(F.lit("ftp"), F.col("url"))).alias("ftp"),
    )


@query(
    "h08_truncate_string",
    "SELECT conv_id, turn, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END AS short FROM conversations",
)
def _(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", helpers.truncate_string(F.col("text"), 80).alias("short"))


def _nested(spark, folder):
    events = table(spark, folder, "events")
    return events.select(
        "event_id",
        F.struct(F.struct(F.col("user_id").alias("id")).alias("user"), F.col("event_type").alias("kind")).alias("event"),
        F.struct(F.col("value").alias("amount")).alias("data"),
    )


@query(
    "h09_flatten",
    'SELECT event_id, user_id AS "event.user.id", event_type AS "event.kind", value AS "data.amount" FROM events',
)
def _(spark, folder):
    return helpers.flatten_columns(_nested(spark, folder))


@query(
    "h10_unflatten",
    "SELECT event_id, user_id, event_type AS kind, value AS amount FROM events",
)
def _(spark, folder):
    nested = helpers.unflatten_columns(helpers.flatten_columns(_nested(spark, folder)))
    return nested.select(
        "event_id", F.col("event.user.id").alias("user_id"), F.col("event.kind").alias("kind"), F.col("data.amount").alias("amount")
    )


@query(
    "h11_chunks",
    """SELECT chunk, string_agg(doc_id, ',' ORDER BY doc_id) AS members FROM
      (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 7 AS chunk FROM documents) GROUP BY chunk""",
)
def _(spark, folder):
    cut = ranks.chunks(documents(spark, folder), "doc_id", 7)
    return cut.select("chunk", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))
