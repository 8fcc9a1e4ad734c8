"""Queries on sources and sinks.  Sinks write to the session's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.text import content_hash
from riskweave.operators import audit, rules
from riskweave.plans.evaluation_queries import _BINARY, _BOARD, _CLASSES, _long, _sql, ACCURACY, BOARD_SELECT, MACRO, WEIGHTED, binary, leaderboard
from riskweave.operators import evaluate
from riskweave.plans.feature_queries import SAMPLE, dataset, rounded, with_samples
from riskweave.plans.oracle import with_findings
from riskweave.plans.registry import query
from riskweave.plans.rule_queries import FINDING
from riskweave.plans.text_queries import AT, _audit, _audit_sql, documents
from riskweave.session import scratch_dir
from riskweave.sources import datasets, files, incremental
from riskweave.sources.corpus import corpus_table, table

_FINDING = FINDING.split(", ")


def _relative(path):
    return F.regexp_extract(path, r"(src/[^/]+/[^/]+)$", 1)


def _exported(spark, folder, name, prefix=None, suffix=None, code="code"):
    """The code relation as real files, some with names Spark's own file source would skip."""
    rows = corpus_table(spark, folder)
    base = F.coalesce(prefix, F.lit("f")) if prefix is not None else F.lit("f")
    tail = suffix if suffix is not None else F.lit(".py")
    path = F.concat(F.lit("src/"), F.col("source"), F.lit("/"), base, F.col("file_id").cast("string"), tail)
    root = scratch_dir(spark, name)
    files.export_files(rows.select(path.alias("file_path"), F.expr(code).alias("code")), root)
    return root




@query(
    "s01_directory_scan",
    with_findings(
        """SELECT 'src/' || source || '/' || CASE file_id % 3 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE 'f' END || file_id || '.py' AS file_path,
        found.rule_id, found.line_number, found.code_snippet FROM found JOIN (SELECT file_id, source FROM corpus) USING (file_id)"""
    ),
)
def _(spark, folder):
    third = F.col("file_id") % 3
    prefix = F.when(third == 0, "_").when(third == 1, ".").otherwise("f")
    root = _exported(spark, folder, "tree", prefix)
    found = files.scan_directory(spark, root)
    return found.select(_relative("file_path").alias("file_path"), "rule_id", "line_number", "code_snippet")


@query(
    "s02_file_text",
    with_findings("SELECT file_id, rule_id, line_number, code_snippet FROM found WHERE file_id % 5 <> 0"),
)
def _(spark, folder):
    """Files with CRLF line ends, a fifth of them under another suffix."""
    suffix = F.when(F.col("file_id") % 5 == 0, ".txt").otherwise(".py")
    root = _exported(spark, folder, "texts", suffix=suffix, code="replace(code, '\\n', '\\r\\n')")
    found = files.scan_directory(spark, root)
    number = F.regexp_extract("file_path", r"(\d+)\.py$", 1).cast("bigint")
    return found.select(number.alias("file_id"), "rule_id", "line_number", "code_snippet")


@query(
    "s02b_scan_file",
    with_findings(
        "SELECT rule_id, line_number, code_snippet FROM found WHERE file_path = "
        "(SELECT min(file_path) FROM found WHERE rule_id <> 'SYNTAX_ERROR')"
    ),
)
def _(spark, folder):
    """The first file that has findings, scanned on its own."""
    found = rules.findings(corpus_table(spark, folder)).where("rule_id <> 'SYNTAX_ERROR'")
    path = found.agg(F.min("file_path")).first()[0]
    root = scratch_dir(spark, "one_file")
    files.export_files(corpus_table(spark, folder).where(F.col("file_path") == path), root)
    return files.scan_file(spark, f"{root}/{path}").select("rule_id", "line_number", "code_snippet")


_PATHS = "'src/' || source || '/f' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.PY' WHEN 2 THEN '.txt' WHEN 3 THEN '.tar.gz' ELSE '' END"


@query("s04_extension", f"SELECT doc_id, path FROM (SELECT doc_id, {_PATHS} AS path FROM documents) WHERE regexp_matches(lower(path), '[^/]\\.(py|gz)$')")
def _(spark, folder):
    kind = F.col("doc_id") % 5
    suffix = F.when(kind == 0, ".py").when(kind == 1, ".PY").when(kind == 2, ".txt").when(kind == 3, ".tar.gz").otherwise("")
    path = F.concat(F.lit("src/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), suffix)
    return files.with_extension(table(spark, folder, "documents").select("doc_id", path.alias("path")), [".py", ".GZ"])


@query(
    "s05_limits",
    """SELECT path, size FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path) AS place FROM
      (SELECT 'src/' || source || '/f' || doc_id || '.py' AS path, source, n_chars AS size FROM documents WHERE n_chars <= 4000)) WHERE place <= 10""",
)
def _(spark, folder):
    path = F.concat(F.lit("src/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".py"))
    listed = table(spark, folder, "documents").select(path.alias("path"), F.col("n_chars").alias("size"))
    return files.within_limits(listed, max_file_size=4000, max_files_per_directory=10)


@query("s06_content_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def _(spark, folder):
    text = F.encode("text", "UTF-8")
    return documents(spark, folder, "text").select(
        "doc_id", *[content_hash(text, a).alias(a) for a in ("sha256", "md5", "sha1")]
    )


@query(
    "s06b_duplicate_files",
    "SELECT sha256(text) AS hash, count(*) AS n_files, min('d' || doc_id) AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def _(spark, folder):
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path")
    contents = documents(spark, folder, "text").select(path, F.encode("text", "UTF-8").alias("content"))
    return files.duplicate_files(files.file_hashes(contents))


@query("s07_dataset_csv", with_samples(f"SELECT {SAMPLE}, split FROM dataset"))
def _(spark, folder):
    root = scratch_dir(spark, "dataset")
    datasets.write_dataset(dataset(spark, folder), root)
    return datasets.read_dataset(spark, root)


@query("s07b_dataset_json", with_samples(f"SELECT {SAMPLE}, split FROM dataset"))
def _(spark, folder):
    root = scratch_dir(spark, "dataset")
    datasets.write_dataset(dataset(spark, folder), root)
    return spark.read.schema(datasets.SAMPLE_SCHEMA + ", split string").json(f"{root}/json")


@query("s08_dataset_read_missing_split", with_samples("SELECT split, count(*) AS n FROM dataset WHERE split <> 'validation' GROUP BY split"))
def _(spark, folder):
    root = scratch_dir(spark, "dataset")
    datasets.write_dataset(dataset(spark, folder).where("split <> 'validation'"), root)
    return datasets.read_dataset(spark, root).groupBy("split").agg(F.count("*").alias("n"))


def _finding_schema(found):
    return ", ".join(f"{name} {kind}" for name, kind in found.dtypes)


@query("s09_findings_json", with_findings(f"SELECT {FINDING} FROM found"))
def _(spark, folder):
    found = rules.findings(corpus_table(spark, folder)).select(*_FINDING)
    path = datasets.write_findings(found, scratch_dir(spark, "findings"), "json")
    return spark.read.schema(_finding_schema(found)).json(path)


@query("s09b_findings_csv", with_findings(f"SELECT {FINDING} FROM found"))
def _(spark, folder):
    found = rules.findings(corpus_table(spark, folder)).select(*_FINDING)
    path = datasets.write_findings(found, scratch_dir(spark, "findings"), "csv")
    return datasets.read_csv(spark, path, _finding_schema(found))


@query("s10_results_json", _sql(_BINARY, _CLASSES, f"SELECT 'performance' AS section, metric, value FROM ({_long({**ACCURACY, **MACRO, **WEIGHTED})})"))
def _(spark, folder):
    wanted = [*ACCURACY, *MACRO, *WEIGHTED]
    metrics = evaluate.overall(binary(spark, folder)).where(F.col("metric").isin(wanted))
    path = scratch_dir(spark, "results")
    datasets.write_results(metrics.withColumn("section", F.lit("performance")), path)
    nested = spark.read.schema("section string, values map<string,double>").json(path)
    return rounded(nested.select("section", F.explode("values").alias("metric", "value")), ["value"], 9)


@query("s11_leaderboard_csv", _sql(_BOARD, BOARD_SELECT))
def _(spark, folder):
    board = leaderboard(spark, folder)
    path = datasets.write_csv(board, scratch_dir(spark, "leaderboard"))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in board.dtypes)
    return datasets.read_csv(spark, path, schema)


@query(
    "s12_findings_download",
    with_findings(
        'SELECT line_number AS "Line", severity AS "Severity", vulnerability_type AS "Type", description AS "Description", confidence AS "Confidence", code_snippet AS "Code" FROM found'
    ),
)
def _(spark, folder):
    view = datasets.download_view(rules.findings(corpus_table(spark, folder)))
    path = datasets.write_csv(view, scratch_dir(spark, "download"))
    return datasets.read_csv(spark, path, _finding_schema(view))


@query("s14_audit_sink", with_findings(_audit_sql("ANALYSIS_START", "'File: ' || file_path") + "corpus"))
def _(spark, folder):
    path = scratch_dir(spark, "audit")
    datasets.append_audit(audit.analysis_start(corpus_table(spark, folder), at=AT), path)
    return _audit(spark.read.parquet(path))


@query("s14b_audit_once", with_findings(_audit_sql("ANALYSIS_START", "'File: ' || file_path") + "corpus"))
def _(spark, folder):
    """Two batches, each of them sent twice."""
    path = scratch_dir(spark, "audit")
    events = audit.analysis_start(corpus_table(spark, folder), at=AT)
    first = F.xxhash64("message") % 2 == 0
    for batch, wanted in (("even", first), ("odd", ~first), ("even", first), ("odd", ~first)):
        datasets.append_audit_once(events.where(wanted), path, batch)
    return _audit(datasets.read_audit(spark, path))


def _snapshots(spark, folder):
    """The state after scans of two snapshots of a tree.

    The second lacks every seventh file, has every eleventh as a new one, and every fifth begins with an empty line.
    """
    rows = corpus_table(spark, folder)
    state = scratch_dir(spark, "state")
    old = rows.where("file_id % 11 <> 0")
    new = rows.where("file_id % 7 <> 0").withColumn("code", F.expr("if(file_id % 5 = 0, concat('\\n', code), code)"))
    for snapshot in (old, new):
        root = scratch_dir(spark, "snapshot")
        files.export_files(snapshot.select("file_path", "code"), root)
        incremental.scan_changes(spark, root, state)
    return state


_STATUS = """CASE WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 11 <> 0 THEN 'removed' END
  WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'changed' END"""


@query("s15_changed_files", f"SELECT 'src/' || source || '/f' || doc_id || '.py' AS path, {_STATUS} AS status FROM documents WHERE {_STATUS} IS NOT NULL")
def _(spark, folder):
    return incremental.changes(spark, _snapshots(spark, folder))


@query(
    "s15b_current_findings",
    with_findings("SELECT file_path, rule_id, line_number + (file_id % 5 = 0)::INTEGER AS line_number FROM found WHERE file_id % 7 <> 0"),
)
def _(spark, folder):
    """Findings of the second snapshot, most of them kept from the first scan."""
    return incremental.current_findings(spark, _snapshots(spark, folder)).select("file_path", "rule_id", "line_number")
