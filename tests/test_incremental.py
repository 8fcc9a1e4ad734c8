"""Scans that repeat, audit batches written once, the table function and nested training sets."""

import os

import pytest
from pyspark.sql import functions as F

from riskweave.functions import table_functions
from riskweave.operators import audit, models, nodes
from riskweave.operators.ranks import shuffled_rank
from riskweave.session import tune
from riskweave.sources import commits, datasets, incremental
from riskweave.streaming.audit import audit_writer


def write(root, contents):
    for name, data in contents.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as handle:
            handle.write(data)


def status(spark, state, run=None):
    return {r.path: r.status for r in incremental.changes(spark, state, run).collect()}


def rules_of(spark, state):
    return {(r.file_path, r.rule_id, r.line_number) for r in incremental.current_findings(spark, state).collect()}


def scanned(spark, state):
    return {r.path: r.scanned_run for r in incremental.manifest(spark, state).collect()}


def test_only_changed_files_are_scanned(spark, tmp_path):
    tune(spark)
    state = str(tmp_path / "state")
    with pytest.raises(ValueError):
        incremental.current_findings(spark, state)
    one = {"a.py": b"eval(x)\n", "p/b.py": b"exec(x)\n", "p/gone.py": b"eval(x)\n", "bad.py": b"\xff", "clean.py": b"", "note.txt": b"eval(x)"}
    write(tmp_path / "one", one)
    assert incremental.scan_changes(spark, str(tmp_path / "one"), state) == 1
    assert status(spark, state) == {n: "added" for n in one if n.endswith(".py")}
    first = rules_of(spark, state)
    assert {f[0] for f in first} == {"a.py", "p/b.py", "p/gone.py"}

    # The same tree again, by another spelling of its path: nothing to do.
    assert incremental.scan_changes(spark, f"file://{tmp_path}/one/", state) == 2
    assert status(spark, state) == {} and rules_of(spark, state) == first
    assert set(scanned(spark, state).values()) == {1}

    two = {"a.py": b"eval(x)\n", "p/b.py": b"\nexec(x)\n", "bad.py": b"exec(x)\n", "clean.py": b"", "new/c.py": b"eval(x)\n"}
    write(tmp_path / "two", two)
    assert incremental.scan_changes(spark, str(tmp_path / "two"), state) == 3
    assert status(spark, state) == {"p/b.py": "changed", "bad.py": "changed", "p/gone.py": "removed", "new/c.py": "added"}
    found = rules_of(spark, state)
    assert {(f[0], f[2]) for f in found} == {("a.py", 1), ("p/b.py", 2), ("bad.py", 1), ("new/c.py", 1)}
    assert scanned(spark, state) == {"a.py": 1, "p/b.py": 3, "bad.py": 3, "clean.py": 1, "new/c.py": 3}
    assert status(spark, state, 1) == {n: "added" for n in one if n.endswith(".py")}


def test_a_run_without_commit_is_repeated(spark, tmp_path, monkeypatch):
    tune(spark)
    state, root = str(tmp_path / "state"), str(tmp_path / "tree")
    write(root, {"a.py": b"eval(x)\n"})
    incremental.scan_changes(spark, root, state)
    write(root, {"b.py": b"exec(x)\n"})

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(incremental, "commit", dies)
        with pytest.raises(RuntimeError):
            incremental.scan_changes(spark, root, state)
    assert {f[0] for f in rules_of(spark, state)} == {"a.py"}
    assert incremental.scan_changes(spark, root, state) == 2
    assert status(spark, state) == {"b.py": "added"} and len({f[0] for f in rules_of(spark, state)}) == 2


def test_empty_tree_and_other_options(spark, tmp_path):
    tune(spark)
    state, root = str(tmp_path / "state"), str(tmp_path / "tree")
    write(root, {"note.txt": b"x"})
    assert incremental.scan_changes(spark, root, state) == 1
    assert rules_of(spark, state) == set() and status(spark, state) == {}
    write(root, {"a.py": b"eval(x)\n"})
    incremental.scan_changes(spark, root, state)
    assert {f[1] for f in rules_of(spark, state)} == {"EVAL_USAGE", "DANGEROUS_FUNC_EVAL"}
    incremental.scan_changes(spark, root, state, line_rules=())
    assert {f[1] for f in rules_of(spark, state)} == {"DANGEROUS_FUNC_EVAL"} and status(spark, state) == {}


def events(spark, names):
    return audit.analysis_start(spark.createDataFrame([(n,) for n in names], "file_path string"), at="2024-01-02 03:04:05")


def test_a_repeated_batch_adds_no_event(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "audit")
    assert datasets.read_audit(spark, path).collect() == []
    assert datasets.append_audit_once(events(spark, ["a", "b"]), path, "one/1")
    assert not datasets.append_audit_once(events(spark, ["a", "b"]), path, "one/1")
    assert datasets.append_audit_once(events(spark, []), path, "007")
    with monkeypatch.context() as patch:
        patch.setattr(datasets, "commit", lambda *_: None)
        datasets.append_audit_once(events(spark, ["half"]), path, "dead")
    assert datasets.append_audit_once(events(spark, ["c"]), path, "%41")
    rows = datasets.read_audit(spark, path).collect()
    assert sorted((r.batch, r.fields["File"]) for r in rows) == [("%41", "c"), ("one/1", "a"), ("one/1", "b")]
    assert datasets.append_audit_once(events(spark, ["whole"]), path, "dead")
    assert "whole" in {r.fields["File"] for r in datasets.read_audit(spark, path).collect()}
    assert {r.name for r in commits.committed(spark, path).collect()} == {"one/1", "007", "%41", "dead"}
    with pytest.raises(ValueError):
        datasets.append_audit_once(events(spark, ["x"]), path, "")


def test_a_stream_restarted_without_its_checkpoint_adds_no_event(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "audit")
    spark.createDataFrame([("a",), ("b",)], "file_path string").coalesce(1).write.parquet(source)
    stream = audit.analysis_start(spark.readStream.schema("file_path string").parquet(source))
    for checkpoint in ("first", "first", "lost"):
        audit_writer(stream, path, str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.fields["File"] for r in datasets.read_audit(spark, path).collect()) == ["a", "b"]


def test_table_function_equals_the_parse(spark):
    tune(spark)
    table_functions.register(spark)
    code = ["def f(a):\n    '''doc'''\n    return eval(a) + 1.5", "x = 'é\\ud800'\ntry:\n    pass\nexcept:\n    pass", "def broken(:", "", None, "x" * 30000 + " = 1"]
    rows = spark.createDataFrame(list(enumerate(code)), "file_id int, code string")
    got = spark.sql("SELECT file_id, n.* FROM {rows} AS r, LATERAL parse_python(r.code) AS n", rows=rows)
    want = nodes.ast_nodes(rows)
    assert got.dtypes == want.dtypes
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_training_sets_are_nested(spark):
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(97).select("id", array_to_vector(F.array((F.col("id") % 3).cast("double"), F.rand(1))).alias("features"), (F.col("id") % 3).cast("int").alias("label"))
    ranked = shuffled_rank(rows, ["label"], 42, "id")
    sets = [{r.id for r in ranked.where(models.in_prefix(f)).collect()} for f in (0.1, 0.5, 1.0)]
    assert sets[0] < sets[1] < sets[2] and len(sets[2]) == 97
    curve = {(r.fraction, r.fold): r for r in models.learning_curve(rows, "logistic_regression", {"reg_param": 0.01}, (0.2, 1.0), 2).collect()}
    assert len(curve) == 4 and sum(curve[1.0, k].n_train for k in (0, 1)) == 97
    assert all(curve[0.2, k].n_train < curve[1.0, k].n_train for k in (0, 1))
    assert all(curve[1.0, k].train_accuracy == 1.0 == curve[1.0, k].test_accuracy for k in (0, 1))
    lone = models.learning_curve(rows.where("id < 3"), "logistic_regression", {"reg_param": 0.01}, (1.0,), 2).collect()
    assert sorted((r.n_train, r.train_accuracy is None) for r in lone) == [(0, True), (3, False)]


def test_workers_hold_little_of_the_files(tmp_path, monkeypatch):
    """Two Python workers a core read and parse; each holds a few megabytes and gives them back."""
    import pyarrow as pa

    from riskweave.sources import files

    paths = []
    for i in range(12):
        paths.append(str(tmp_path / f"{i}.py"))
        (tmp_path / f"{i}.py").write_bytes(b"x = 1\n" + b"# " + b"a" * (1 << 20))
    read = list(files._read_paths([pa.record_batch([pa.array(paths)], names=["path"])]))
    assert sum(len(b) for b in read) == 12 and max(b.nbytes for b in read) < 5 << 20
    freed = []
    monkeypatch.setattr(nodes, "release", lambda: freed.append(1))
    trees = nodes._tree_udf(frozenset({"Call"})).func
    out = list(trees(pa.array(["f()", "def ("]) for _ in range(3)))
    assert len(freed) >= 3 and all(t.to_pylist()[0]["error"] is None and t.to_pylist()[1]["error"]["kind"] == "SyntaxError" for t in out)
