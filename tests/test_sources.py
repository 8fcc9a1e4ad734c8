import hashlib
import os

import pytest

from riskweave.operators import audit, rules, synth
from riskweave.session import materialise, scratch_dir, tune
from riskweave.sources import datasets, files


@pytest.fixture()
def tree(tmp_path):
    contents = {
        "pkg/__init__.py": b"eval(x)\n",
        "pkg/.hidden.py": b"exec(x)\n",
        "pkg/deep/er/mod.py": "# é\r\npassword = 'x'\rinput()\n".encode(),
        "pkg/clean.py": b"x = 1\n",
        "pkg/bad.py": b"x = '\xff'\n",
        "pkg/note.txt": b"eval(x)\n",
        "pkg/.py": b"eval(x)\n",
        "pkg/bom.py": b"\xef\xbb\xbfx = 1\n",
        "pkg/SHOUT.PY": b"eval(x)\n",
    }
    for name, data in contents.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (tmp_path / "pkg" / "folder.py").mkdir()
    (tmp_path / "pkg" / "loop").symlink_to(tmp_path / "pkg")
    return str(tmp_path)


def test_directory_scan_sees_every_source_file(spark, tree):
    tune(spark)
    rows = files.scan_directory(spark, tree).collect()
    got = {(os.path.relpath(r.file_path, tree), r.rule_id, r.line_number) for r in rows}
    assert {g for g in got if "bom" not in g[0]} == {
        ("pkg/__init__.py", "EVAL_USAGE", 1), ("pkg/__init__.py", "DANGEROUS_FUNC_EVAL", 1),
        ("pkg/.hidden.py", "EXEC_USAGE", 1), ("pkg/.hidden.py", "DANGEROUS_FUNC_EXEC", 1),
        ("pkg/deep/er/mod.py", "HARDCODED_PASSWORD", 2), ("pkg/deep/er/mod.py", "DANGEROUS_FUNC_INPUT", 3),
    }
    unreadable = files.unreadable_files(spark, tree).collect()
    assert [os.path.basename(r.file_path) for r in unreadable] == ["bad.py"]


def test_file_scan(spark, tree):
    tune(spark)
    assert files.scan_file(spark, f"{tree}/pkg/__init__.py").count() == 2
    assert files.scan_file(spark, f"{tree}/pkg/note.txt").count() == 0
    assert files.scan_file(spark, f"{tree}/pkg/bad.py").count() == 0
    for call in (files.scan_file, files.scan_directory):
        with pytest.raises(FileNotFoundError):
            call(spark, f"{tree}/missing")


def test_limits_and_hashes(spark, tree):
    tune(spark)
    listed = files.list_files(spark, tree)
    small = files.within_limits(listed, max_file_size=8, max_files_per_directory=2)
    assert sorted(os.path.basename(r.path) for r in small.collect()) == [".hidden.py", ".py"]
    hashes = files.file_hashes(files.read_files(listed), "sha1")
    data = {os.path.basename(r.path): r.hash for r in hashes.collect()}
    assert data["clean.py"] == hashlib.sha1(b"x = 1\n").hexdigest()
    assert {r.n_files for r in files.duplicate_files(hashes).collect()} == {4}
    with pytest.raises(ValueError):
        files.file_hashes(files.read_files(listed), "crc")


def test_dataset_round_trip_keeps_odd_text(spark, tmp_path):
    rows = [
        (1, "a = \"q\"\n  'x',\\n\r\n", "t", "high", 1, 'say "hi", ok', 0.25, "T_RULE", "train"),
        (2, "  ", "t", "low", 2, "", 0.5, "T_RULE", "test"),
    ]
    samples = spark.createDataFrame(rows, datasets.SAMPLE_SCHEMA + ", split string")
    datasets.write_dataset(samples, str(tmp_path / "d"))
    got = sorted(tuple(r) for r in datasets.read_dataset(spark, str(tmp_path / "d")).collect())
    # The reader takes every line end as one newline and an empty text as absent.
    assert [(g[0], g[1].replace("\r\n", "\n"), g[8]) for g in got] == [(r[0], r[1].replace("\r\n", "\n"), r[8]) for r in rows]
    as_json = spark.read.schema(datasets.SAMPLE_SCHEMA + ", split string").json(str(tmp_path / "d" / "json"))
    assert sorted(tuple(r) for r in as_json.collect()) == rows


def test_empty_findings_leave_no_csv(spark, tmp_path):
    tune(spark)
    empty = rules.findings(spark.createDataFrame([(1, "a.py", "x = 1")], "file_id int, file_path string, code string"))
    assert datasets.write_findings(empty, str(tmp_path / "f"), "csv") is None
    assert not (tmp_path / "f").exists()


def test_audit_appends_by_day(spark, tmp_path):
    table = spark.createDataFrame([("a.py",)], "file_path string")
    for at in ("2024-01-01 10:00:00", "2024-01-02 10:00:00"):
        datasets.append_audit(audit.analysis_start(table, "ann", at), str(tmp_path / "log"))
    kept = spark.read.parquet(str(tmp_path / "log"))
    assert kept.where("event_date = date'2024-01-02'").count() == 1 and kept.count() == 2
    first = kept.orderBy("ts").first()
    assert first.message == "ANALYSIS_START - File: a.py, User: ann, Timestamp: 2024-01-01T10:00:00.000000"
    assert first.fields == {"File": "a.py"} and first.level == "INFO"


def test_generated_dataset(spark):
    sizes = {r.split: r["count"] for r in synth.generate(spark, 50, 51).groupBy("split").count().collect()}
    assert sizes == {"train": 70, "validation": 15, "test": 16}
    rows = synth.vulnerable_samples(spark.range(200)).collect()
    assert {r.vulnerability_type for r in rows} == set(synth.VULNERABLE_TEMPLATES)
    assert all(0.7 <= r.confidence < 1.0 for r in rows)
    again = synth.vulnerable_samples(spark.range(200).repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_indent_all(spark):
    one = synth.safe_samples(spark.range(400), indent_all=True, templates=("a\nb",), contexts=("if x:\n",))
    assert one.first().code == "if x:\n\n    a\n    b"


def test_scratch_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "x")
    assert path.startswith(base or spark.conf.get("spark.checkpoint.dir"))
    assert materialise(spark.range(3), "t").count() == 3


def test_scan_finds_each_vulnerable_statement_and_no_safe_one(spark):
    """In every context; the type of a finding is the statement's own."""
    from pyspark.sql import functions as F

    rows = [(f"{kind}/{i}/{c}", kind, context, text) for kind, texts in {**synth.VULNERABLE_TEMPLATES, "safe": synth.SAFE_TEMPLATES}.items()
            for i, text in enumerate(texts) for c, context in enumerate(synth.CONTEXTS)]
    frame = spark.createDataFrame(rows, "file_id string, kind string, context string, template string")
    code = frame.select("file_id", F.col("file_id").alias("file_path"), synth.combine(F.col("context"), F.col("template"), True).alias("code"))
    found = {}
    for r in rules.findings(code).collect():
        found.setdefault(r.file_id, set()).add(r.rule_id)
    wanted = {
        "hardcoded_password": {"HARDCODED_PASSWORD"}, "eval_usage": {"EVAL_USAGE", "EXEC_USAGE"}, "sql_injection": {"SQL_INJECTION"},
        "shell_injection": {"SHELL_INJECTION"}, "weak_crypto": {"WEAK_CRYPTO"}, "insecure_random": {"INSECURE_RANDOM"}, "exception_handling": {"BARE_EXCEPT"},
    }
    for file_id, kind, _, _ in rows:
        got = found.get(file_id, set())
        assert "SYNTAX_ERROR" not in got, file_id
        assert got == set() if kind == "safe" else got & wanted[kind], (file_id, got)
    assert all(len(t) == 5 for t in synth.VULNERABLE_TEMPLATES.values()) and len(synth.SAFE_TEMPLATES) == 10 and len(synth.CONTEXTS) == 8


def test_unlisted_folder_is_reported(spark, tmp_path, monkeypatch):
    assert files._list_folders is not None
    import pyarrow as pa

    batch = pa.record_batch([pa.array([str(tmp_path / "gone")])], names=["path"])
    rows = [r for b in files._list_folders([batch]) for r in b.to_pylist()]
    assert len(rows) == 1 and rows[0]["problem"].startswith("FileNotFoundError") and not rows[0]["is_dir"]


def test_other_errors_than_a_missing_split_are_raised(spark, tmp_path):
    from riskweave.sources import datasets

    import pytest

    datasets.write_dataset(synth.generate(spark, 5, 5), str(tmp_path))
    with pytest.raises(Exception):
        datasets.read_dataset(spark, str(tmp_path), "id nonsense").collect()


def test_paths_are_qualified_by_the_default_file_system(spark, tmp_path):
    assert files.qualified(spark, str(tmp_path)) == str(tmp_path)
    assert files.qualified(spark, "s3a://bucket/x") == "s3a://bucket/x"


def test_explanations_leave_audit_events(spark):
    from riskweave.operators import evidence

    table = spark.createDataFrame([("a", "a.py", "eval(x)\npassword = 'x1'")], "file_id string, file_path string, code string")
    explained = evidence.explain(table)
    events = evidence.explanation_events(explained, "ana").collect()
    assert len(events) == explained.count() > 1
    assert {e.event_type for e in events} == {"MODEL_PREDICTION"} and {e.user_id for e in events} == {"ana"}
    assert {e.fields["Prediction"] for e in events} >= {"eval_usage", "hardcoded_password"}
