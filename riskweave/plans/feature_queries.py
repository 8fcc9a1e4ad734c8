"""Queries on features, matrices and synthetic samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.pystr import PY_SPACE
from riskweave.operators import features, matrix, rules, summary, synth
from riskweave.operators.features import ALL_FEATURES
from riskweave.plans import golden
from riskweave.plans.golden import FEATURES, literal, values
from riskweave.plans.oracle import STRIP, case_of, features_frame_cte, findings_cte, with_features
from riskweave.plans.registry import query
from riskweave.operators.rules import SEVERITY_LABEL
from riskweave.session import materialise, spread
from riskweave.operators.synth import CONTEXTS
from riskweave.sources.corpus import SEVERITY_BY_TYPE, corpus_table, table

DOUBLES = {
    "avg_string_length", "avg_line_length", "code_density", "complexity_ratio",
    "halstead_volume", "halstead_difficulty", "halstead_effort",
}


def rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _sql_feature(name: str) -> str:
    return f"round({name}::DOUBLE, 6) AS {name}" if name in DOUBLES else f"{name}::INTEGER AS {name}"


def _one_feature(key, names):
    @query(key, with_features(f"SELECT file_id, {', '.join(map(_sql_feature, names))} FROM feats"))
    def _(spark, folder):
        found = features.all_features(corpus_table(spark, folder), names).select("file_id", *names)
        return rounded(found, [n for n in names if n in DOUBLES])


for _key, _names in {
    "f01_ast_nodes": ["ast_nodes"],
    "f02_ast_depth": ["ast_depth"],
    "f03_function_count": ["function_count"],
    "f04_class_count": ["class_count"],
    "f05_if_count": ["if_count"],
    "f06_for_count": ["for_count"],
    "f07_while_count": ["while_count"],
    "f08_try_count": ["try_count"],
    "f09_import_count": ["import_count"],
    "f10_dangerous_calls": ["dangerous_calls"],
    "f11_string_count": ["string_count"],
    "f12_avg_string_length": ["avg_string_length"],
    "f13_potential_secrets": ["potential_secrets"],
    "f14_line_count": ["line_count"],
    "f15_char_count": ["char_count"],
    "f16_avg_line_length": ["avg_line_length"],
    "f17_max_line_length": ["max_line_length"],
    "f18_empty_lines": ["empty_lines"],
    "f19_comment_lines": ["comment_lines"],
    "f20_docstring_lines": ["docstring_lines"],
    "f21_cyclomatic_complexity": ["cyclomatic_complexity"],
    "f22_halstead": ["halstead_volume", "halstead_difficulty", "halstead_effort"],
    "f23_code_density": ["code_density"],
    "f24_complexity_ratio": ["complexity_ratio"],
    "f25_all_features": list(ALL_FEATURES),
}.items():
    _one_feature(_key, _names)


def _text_oracle(source, key):
    return f"""WITH t AS (SELECT {key}, text, string_split(text, chr(10)) AS lines FROM {source})
      SELECT {key}, len(lines)::INTEGER AS line_count, length(text)::INTEGER AS char_count,
        list_max(list_transform(lines, lambda x: length(x)))::INTEGER AS max_line_length,
        len(list_filter(lines, lambda x: {STRIP.format('x')} = ''))::INTEGER AS empty_lines,
        round(list_sum(list_transform(lines, lambda x: length(x)))::DOUBLE / len(lines), 6) AS avg_line_length FROM t"""


def _text_features(spark, folder, source, keys):
    rows = table(spark, folder, source).select(*keys, F.col("text").alias("code"))
    found = features.text_measures(spread(rows, *keys)).select(
        *keys, "line_count", "char_count", "max_line_length", "empty_lines", "avg_line_length"
    )
    return rounded(found, ["avg_line_length"])


@query("f14b_text_features_documents", _text_oracle("documents", "doc_id"))
def _(spark, folder):
    return _text_features(spark, folder, "documents", ["doc_id"])


@query("f14c_text_features_conversations", _text_oracle("conversations", "conv_id, turn"))
def _(spark, folder):
    return _text_features(spark, folder, "conversations", ["conv_id", "turn"])


_SECRETS = " + ".join(
    f"len(regexp_extract_all(text, {literal('(?i)' + p)}))" for p in features.SECRET_PATTERNS
)


@query("f26_secrets_in_text", f"SELECT doc_id, source, ({_SECRETS})::INTEGER AS secrets FROM documents WHERE ({_SECRETS}) > 0")
def _(spark, folder):
    documents = spread(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id")
    return documents.select("doc_id", "source", features.secret_count(F.col("text")).alias("secrets")).where("secrets > 0")


# -- matrices ------------------------------------------------------------------------------------


@query(
    "f27_fill_missing",
    "SELECT d.doc_id, coalesce(quality, 0)::INTEGER AS quality, coalesce(toxic, 0)::INTEGER AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id")
    joined = documents.join(table(spark, folder, "labels"), "doc_id", "left")
    return matrix.fill_missing(joined.select("doc_id", "quality", "toxic"), ["quality", "toxic"])


def _z(name, source="feats", fitted="feats"):
    spread = f"(SELECT stddev_samp({name}::DOUBLE) FROM {fitted})"
    mean = f"(SELECT avg({name}::DOUBLE) FROM {fitted})"
    return f"round(coalesce(({name} - {mean}) / nullif({spread}, 0), 0), 5) AS {name}"


@query("f28_zscore", with_features("SELECT file_id, " + ", ".join(_z(n) for n in ALL_FEATURES) + " FROM feats"))
def _(spark, folder):
    found = features.all_features(corpus_table(spark, folder)).select("file_id", *ALL_FEATURES)
    found = materialise(found, "features")
    scaled = matrix.scale_apply(found, matrix.scale_fit(found, ALL_FEATURES), ALL_FEATURES)
    return rounded(scaled, ALL_FEATURES, 5).select(
        "file_id", *[F.when(F.col(n) == 0, F.lit(0.0)).otherwise(F.col(n)).alias(n) for n in ALL_FEATURES]
    )


_SPLIT_RANK = "row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id)"


_DIMENSIONS = [f"e{i}" for i in range(64)]


@query(
    "f29_transform_with_training_statistics",
    lambda: f"""WITH src AS (SELECT vec_id AS id, label, {", ".join(f"embedding[{i + 1}]::DOUBLE AS {e}" for i, e in enumerate(_DIMENSIONS))} FROM embeddings),
      parts AS (SELECT *, CASE WHEN {_SPLIT_RANK} <= floor(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS part FROM src),
      train AS (SELECT * FROM parts WHERE part = 'train')
      SELECT id, {", ".join(_z(e, fitted="train") for e in _DIMENSIONS)} FROM parts WHERE part = 'test'""",
)
def _(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "label", *[F.get("embedding", F.lit(i)).cast("double").alias(e) for i, e in enumerate(_DIMENSIONS)]
    )
    parts = matrix.stratified_split(rows, seed=42)
    fitted = matrix.scale_fit(parts.where("part = 'train'"), _DIMENSIONS)
    scaled = matrix.scale_apply(parts.where("part = 'test'"), fitted, _DIMENSIONS)
    return rounded(scaled.select("id", *_DIMENSIONS), _DIMENSIONS, 5)


@query("f30_severity_label", with_features(f"SELECT file_id, severity, {case_of('severity', SEVERITY_LABEL, 0)}::INTEGER AS label FROM feats"))
def _(spark, folder):
    return corpus_table(spark, folder).select("file_id", "severity", rules.severity_label(F.col("severity")).alias("label"))


def _snippet_oracle():
    snippets = {}
    for _, _, code in golden.pairs():
        for line in code.split("\n"):
            for text in (line, line.strip(PY_SPACE)):
                snippets[text] = golden.features_of(text)
    rows = [(text, *[float(v) for v in found.values()]) for text, found in snippets.items()]
    # A snippet is one line, or none.
    lead = STRIP.format("code_snippet")
    return f"""WITH {findings_cte()}, {values("snippets", ["code_snippet", *FEATURES], rows)}
      SELECT file_id, finding_no, {case_of("severity", SEVERITY_LABEL, 0)}::INTEGER AS label,
        {", ".join(f"round({n}::DOUBLE, 5) AS {n}" for n in FEATURES)}, 1::DOUBLE AS line_count, length(code_snippet)::DOUBLE AS char_count,
        length(code_snippet)::DOUBLE AS avg_line_length, length(code_snippet)::DOUBLE AS max_line_length,
        ({lead} = '')::INTEGER::DOUBLE AS empty_lines, ({lead} LIKE '#%')::INTEGER::DOUBLE AS comment_lines,
        length(code_snippet)::DOUBLE AS code_density, round((cyclomatic_complexity / greatest(function_count, 1))::DOUBLE, 5) AS complexity_ratio
      FROM found JOIN snippets USING (code_snippet)"""


@query("f31_features_from_findings", _snippet_oracle)
def _(spark, folder):
    found = matrix.from_findings(rules.findings(corpus_table(spark, folder)))
    return found.select("file_id", "finding_no", "label", *[F.round(F.col(n).cast("double"), 5).alias(n) for n in ALL_FEATURES])


@query(
    "f32_stratified_split",
    f"""WITH src AS (SELECT vec_id AS id, label FROM embeddings)
      SELECT id, label, CASE WHEN {_SPLIT_RANK} <= floor(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS part FROM src""",
)
def _(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return matrix.stratified_split(rows, seed=42)


@query(
    "f33_tf_idf",
    r"""WITH lists AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
      words AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS pos FROM lists),
      runs AS (SELECT doc_id, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
      grams AS (
        SELECT doc_id, a AS term FROM runs
        UNION ALL SELECT doc_id, a || ' ' || b FROM runs WHERE b IS NOT NULL
        UNION ALL SELECT doc_id, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL),
      kept AS (SELECT term FROM grams GROUP BY term ORDER BY count(*) DESC, term LIMIT 1000),
      counts AS (SELECT doc_id, term, count(*) AS tf FROM grams JOIN kept USING (term) GROUP BY ALL),
      idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1 AS idf FROM counts GROUP BY term),
      raw AS (SELECT doc_id, term, tf * idf AS raw FROM counts JOIN idf USING (term))
      SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
)
def _(spark, folder):
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return rounded(matrix.tf_idf(documents, "doc_id", "text"), ["weight"])


@query(
    "f34_label_encoding",
    "SELECT event_id, event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS code FROM events",
)
def _(spark, folder):
    return matrix.encode_labels(table(spark, folder, "events").select("event_id", "event_type"), "event_type", "code")


def _labelled_oracle():
    parts = [
        "SELECT 'samples' AS metric, '' AS key, count(*)::DOUBLE AS value FROM feats",
        f"SELECT 'features', '', {len(ALL_FEATURES)}.0::DOUBLE",
        f"SELECT 'label_distribution', ({case_of('severity', SEVERITY_LABEL, 0)})::VARCHAR, count(*)::DOUBLE FROM feats GROUP BY 2",
    ]
    for n in ALL_FEATURES:
        for metric, sql in {
            "count": f"count({n})", "mean": f"avg({n}::DOUBLE)", "std": f"stddev_samp({n}::DOUBLE)", "min": f"min({n})",
            "25%": f"quantile_cont({n}::DOUBLE, 0.25)", "50%": f"quantile_cont({n}::DOUBLE, 0.5)",
            "75%": f"quantile_cont({n}::DOUBLE, 0.75)", "max": f"max({n})",
        }.items():
            parts.append(f"SELECT '{metric}', '{n}', round(({sql})::DOUBLE, 5) FROM feats")
    return f"WITH {features_frame_cte()} " + " UNION ALL ".join(parts)


@query("a10_labelled_stats", _labelled_oracle)
def _(spark, folder):
    # Several aggregates read the features: parse once, keep the table.
    rows = materialise(matrix.labelled(corpus_table(spark, folder)).select("label", *ALL_FEATURES), "features")
    return rounded(summary.labelled_stats(rows, ALL_FEATURES), ["value"], 5)


# -- synthetic samples ---------------------------------------------------------------------------


def _hash_sql(salt, n, key="id"):
    return f"(('0x' || substr(md5('42|{salt}|' || {key}), 1, 8))::BIGINT % {n})"


def _unit_sql(salt):
    return f"(('0x' || substr(md5('42|{salt}|' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _samples_cte() -> str:
    vulnerable = [
        (i, j, kind, text)
        for i, (kind, texts) in enumerate(synth.VULNERABLE_TEMPLATES.items())
        for j, text in enumerate(texts)
    ]
    per_type = len(vulnerable) // len(synth.VULNERABLE_TEMPLATES)
    opens = """CASE WHEN rtrim(prefix, ' ' || chr(10)) LIKE '%:'
      THEN chr(10) || '    ' || replace(body, chr(10), chr(10) || '    ') ELSE chr(10) || body END"""
    first = "list_position(list_transform(string_split(code, chr(10)), lambda x: contains(x, body)), true)"
    return f"""
{values("vt", ["i", "j", "kind", "body"], vulnerable)},
{values("st", ["i", "body"], list(enumerate(synth.SAFE_TEMPLATES)))},
{values("cx", ["c", "prefix"], list(enumerate(CONTEXTS)))},
vulnerable0 AS (
  SELECT id, body, kind, prefix || {opens} AS code FROM (SELECT doc_id * 2 AS id FROM documents)
  JOIN vt ON i = {_hash_sql("type", len(synth.VULNERABLE_TEMPLATES))} AND j = {_hash_sql("template", per_type)}
  JOIN cx ON c = {_hash_sql("context", len(CONTEXTS))}),
vulnerable AS (
  SELECT id, code, kind AS vulnerability_type, {case_of("kind", SEVERITY_BY_TYPE, "medium")} AS severity,
    CASE WHEN {first} > 0 THEN {first} ELSE 1 END::INTEGER AS line_number,
    {case_of("kind", synth.DESCRIPTION_BY_TYPE, synth.DEFAULT_DESCRIPTION)} AS description,
    0.7::DOUBLE + {literal(1.0 - 0.7)} * {_unit_sql("confidence")} AS confidence, upper(kind) || '_RULE' AS rule_id FROM vulnerable0),
safe AS (
  SELECT id, prefix || {opens} AS code, 'safe' AS vulnerability_type, 'info' AS severity, 1 AS line_number,
    'No vulnerabilities detected' AS description,
    0.8::DOUBLE + {literal(1.0 - 0.8)} * {_unit_sql("confidence")} AS confidence, 'SAFE_CODE' AS rule_id
  FROM (SELECT doc_id * 2 + 1 AS id FROM documents)
  JOIN st ON i = {_hash_sql("template", len(synth.SAFE_TEMPLATES))} JOIN cx ON c = {_hash_sql("context", len(CONTEXTS))}),
samples AS (
  SELECT *, row_number() OVER (ORDER BY md5('42|' || id), id) AS place, count(*) OVER () AS n
  FROM (SELECT * FROM vulnerable UNION ALL SELECT * FROM safe)),
dataset AS (
  SELECT * EXCLUDE (place, n), CASE WHEN place <= floor(n * 0.7::DOUBLE) THEN 'train'
    WHEN place <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM samples)"""


def with_samples(select):
    return lambda: f"WITH {_samples_cte()} {select}"


def ids(spark, folder, offset):
    return table(spark, folder, "documents").select((F.col("doc_id") * 2 + offset).alias("id"))


def dataset(spark, folder):
    return synth.dataset(ids(spark, folder, 0), ids(spark, folder, 1))


SAMPLE = "id, code, vulnerability_type, severity, line_number, description, confidence, rule_id"


@query("g01_vulnerable_samples", with_samples(f"SELECT {SAMPLE} FROM vulnerable"))
def _(spark, folder):
    return synth.vulnerable_samples(ids(spark, folder, 0))


@query("g02_safe_samples", with_samples(f"SELECT {SAMPLE} FROM safe"))
def _(spark, folder):
    return synth.safe_samples(ids(spark, folder, 1))


@query(
    "g03_context_share",
    with_samples("SELECT c, count(*) AS n FROM (SELECT doc_id * 2 AS id FROM documents) JOIN cx ON c = "
                 + _hash_sql("context", len(CONTEXTS)) + " GROUP BY c"),
)
def _(spark, folder):
    # Read back from the samples: no context begins as another does.
    samples = synth.vulnerable_samples(ids(spark, folder, 0))
    chosen = F.lit(None).cast("int")
    for c, context in enumerate(CONTEXTS):
        chosen = F.when(F.startswith(F.col("code"), F.lit(context)), F.lit(c)).otherwise(chosen)
    return samples.groupBy(chosen.alias("c")).agg(F.count("*").alias("n"))


@query("g04_combine", with_features("SELECT file_id, code FROM corpus"))
def _(spark, folder):
    return corpus_table(spark, folder).select("file_id", "code")


@query("g05_severity_by_type", with_samples("SELECT vulnerability_type, severity, count(*) AS n FROM vulnerable GROUP BY ALL"))
def _(spark, folder):
    return synth.vulnerable_samples(ids(spark, folder, 0)).groupBy("vulnerability_type", "severity").agg(F.count("*").alias("n"))


@query("g06_description_by_type", with_samples("SELECT vulnerability_type, description, count(*) AS n FROM vulnerable GROUP BY ALL"))
def _(spark, folder):
    return synth.vulnerable_samples(ids(spark, folder, 0)).groupBy("vulnerability_type", "description").agg(F.count("*").alias("n"))


@query("g07_template_line", with_samples("SELECT id, line_number FROM vulnerable"))
def _(spark, folder):
    return synth.vulnerable_samples(ids(spark, folder, 0)).select("id", "line_number")


@query("g08_confidence", with_samples("SELECT id, confidence FROM vulnerable UNION ALL SELECT id, confidence FROM safe"))
def _(spark, folder):
    both = synth.vulnerable_samples(ids(spark, folder, 0)).unionByName(synth.safe_samples(ids(spark, folder, 1)))
    return both.select("id", "confidence")


@query("g09_rule_id", with_samples("SELECT rule_id, count(*) AS n FROM samples GROUP BY rule_id"))
def _(spark, folder):
    return dataset(spark, folder).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("g10_dataset_split", with_samples("SELECT id, vulnerability_type, split FROM dataset"))
def _(spark, folder):
    return dataset(spark, folder).select("id", "vulnerability_type", "split")


@query(
    "a09_dataset_stats",
    with_samples(
        """SELECT split, 'total_samples' AS metric, '' AS key, count(*)::DOUBLE AS value FROM dataset GROUP BY split
        UNION ALL SELECT split, 'avg_confidence', '', round(avg(confidence), 6) FROM dataset GROUP BY split
        UNION ALL SELECT split, 'vulnerability_types', vulnerability_type, count(*)::DOUBLE FROM dataset GROUP BY split, vulnerability_type
        UNION ALL SELECT split, 'severity_distribution', severity, count(*)::DOUBLE FROM dataset GROUP BY split, severity"""
    ),
)
def _(spark, folder):
    return rounded(summary.dataset_stats(dataset(spark, folder)), ["value"])
