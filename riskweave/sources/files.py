"""Directories of source files as DataFrames.

Spark's own file source skips names that start with ``_`` or ``.``, so ``__init__.py`` would
vanish.  Here folders are listed by tasks, one job per depth level, and files are read by tasks;
neither names nor contents pass through the driver.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.text import content_hash, has_extension
from riskweave.operators.ranks import top_per_group
from riskweave.session import materialise, released

# Fixed value: the suffix of files that are scanned.
SOURCE_SUFFIX = ".py"

# Files read into one Arrow batch, in bytes.
READ_BYTES = 2 << 20

_ENTRY = "path string, is_dir boolean, size bigint, problem string"
_ENTRY_ARROW = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("problem", pa.string())])


def _is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def _local(path: str) -> str:
    return path[len("file://"):] if path.startswith("file://") else path.removeprefix("file:")


def _store(path: str):
    """File system and inner path of a remote path; Hadoop's name for the object store is known too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme as Spark understands it: in the default file system, which may be a store."""
    if "://" in path or path.startswith("file:"):
        return path
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    default = hadoop.FileSystem.get(conf)
    return path if default.getScheme() == "file" else default.makeQualified(hadoop.Path(path)).toString()


def _entries(folder: str):
    """(path, is_dir, size) of one folder; links to folders are not followed."""
    if _is_remote(folder):
        from pyarrow import fs

        system, inner = _store(folder)
        scheme = folder[: len(folder) - len(inner)]
        for info in system.get_file_info(fs.FileSelector(inner)):
            yield scheme + info.path, info.type == fs.FileType.Directory, info.size or 0
        return
    with os.scandir(_local(folder)) as found:
        for entry in found:
            if entry.is_dir(follow_symlinks=False):
                yield entry.path, True, 0
            elif entry.is_file():
                yield entry.path, False, _size(entry)


def _size(entry) -> int:
    """Bytes of a file; 0 if it has gone meanwhile, which reading it will tell."""
    try:
        return entry.stat().st_size
    except FileNotFoundError:
        return 0


def _batches(rows, schema, limit=10_000):
    pending = []
    for row in rows:
        pending.append(row)
        if len(pending) >= limit:
            yield _batch(pending, schema)
            pending = []
    if pending:
        yield _batch(pending, schema)


def _batch(rows, schema):
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _list_folders(batches):
    def rows():
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    yield from ((*entry, None) for entry in _entries(folder))
                except OSError as error:  # no permission, or gone since its parent was listed
                    yield folder, False, 0, f"{type(error).__name__}: {error}"

    yield from _batches(rows(), _ENTRY_ARROW)


def _exists(path: str) -> bool:
    if _is_remote(path):
        from pyarrow import fs

        system, inner = _store(path)
        return system.get_file_info(inner).type != fs.FileType.NotFound
    return os.path.exists(_local(path))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, size`` of every file below ``root``.  A missing root raises.

    One call lists one folder, so a flat folder is listed by one task.
    """
    return _listing(spark, root).where("problem is null").select("path", "size")


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, problem``: files, and folders that could not be listed with the reason."""
    root = qualified(spark, root)
    if not _exists(root):
        raise FileNotFoundError(f"directory not found: {root}")
    level = spark.createDataFrame([(root,)], "path string")
    found = []
    while True:
        width = max(1, spark.sparkContext.defaultParallelism)
        listed = materialise(
            level.repartition(width, "path").mapInArrow(released(_list_folders), _ENTRY), "listing"
        )
        found.append(listed.where("not is_dir").select("path", "size", "problem"))
        level = listed.where("is_dir").select("path")
        if level.isEmpty():
            break
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    return files


def _read_paths(batches):
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("problem", pa.string())])

    def rows():
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    yield path, _content(path), None
                except OSError as error:
                    yield path, None, f"{type(error).__name__}: {error}"

    pending, held = [], 0
    for row in rows():
        pending.append(row)
        held += len(row[1] or b"")
        if held >= READ_BYTES or len(pending) >= 10_000:
            yield _batch(pending, schema)
            pending, held = [], 0
    if pending:
        yield _batch(pending, schema)


def _content(path: str) -> bytes:
    if _is_remote(path):
        system, inner = _store(path)
        with system.open_input_file(inner) as handle:
            return handle.read()
    with open(_local(path), "rb") as handle:
        return handle.read()


def read_files(paths: DataFrame, partitions: int | None = None) -> DataFrame:
    """``path, content, problem``: bytes read on executors; an unreadable file keeps its reason."""
    width = partitions or 4 * paths.sparkSession.sparkContext.defaultParallelism
    return paths.select("path").repartition(width, "path").mapInArrow(
        released(_read_paths), "path string, content binary, problem string"
    )


def within_limits(
    files: DataFrame, max_file_size: int | None = None, max_files_per_directory: int | None = None
) -> DataFrame:
    """Optional limits on ``path, size`` rows; both are off unless given."""
    if max_file_size is not None:
        files = files.where(F.col("size") <= max_file_size)
    if max_files_per_directory is not None:
        parent = F.regexp_replace("path", "/[^/]*$", "")
        files = top_per_group(
            files.withColumn("_parent", parent), ["_parent"], ["path"], max_files_per_directory, "path"
        ).drop("_parent")
    return files


def decode(contents: DataFrame) -> DataFrame:
    """Add ``code``: UTF-8 text with line ends as ``\\n``; null with a ``problem`` if it is not text."""
    valid = F.is_valid_utf8(F.col("content"))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    problem = F.coalesce("problem", F.when(~valid, F.lit("UnicodeDecodeError: not valid UTF-8")))
    return contents.withColumns({"code": F.when(valid, text), "problem": problem})


def source_files(
    spark: SparkSession,
    root: str,
    max_file_size: int | None = None,
    max_files_per_directory: int | None = None,
) -> DataFrame:
    """Every ``*.py`` below ``root``: ``file_id, file_path, code, problem``."""
    paths = list_files(spark, root).where(F.rlike("path", F.lit(r"[^/]\.py$")))
    paths = within_limits(paths, max_file_size, max_files_per_directory)
    return decode(read_files(paths)).select(
        F.col("path").alias("file_id"), F.col("path").alias("file_path"), "code", "problem"
    )


def scan_directory(spark: SparkSession, root: str, **options) -> DataFrame:
    """Findings of every readable file below ``root``; clean files have no row."""
    from riskweave.operators.rules import findings

    files = source_files(spark, root).where("code is not null").drop("problem")
    return findings(files, **options)


def scan_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """Findings of one file; a missing file raises, another suffix has no findings."""
    from riskweave.operators.rules import findings

    path = qualified(spark, path)
    if not _exists(path):
        raise FileNotFoundError(f"file not found: {path}")
    one = spark.createDataFrame([(path,)], "path string").where(F.rlike("path", F.lit(r"[^/]\.py$")))
    files = decode(read_files(one, 1)).where("code is not null")
    return findings(files.select(F.col("path").alias("file_id"), F.col("path").alias("file_path"), "code"), **options)


def unreadable_files(spark: SparkSession, root: str) -> DataFrame:
    """``file_path, problem``: files that are not text or cannot be read, folders that cannot be listed."""
    files = source_files(spark, root).where("problem is not null").select("file_path", "problem")
    folders = _listing(spark, root).where("problem is not null").select(F.col("path").alias("file_path"), "problem")
    return files.unionByName(folders)


def file_hashes(contents: DataFrame, algorithm: str = "sha256") -> DataFrame:
    return contents.select("path", content_hash(F.col("content"), algorithm).alias("hash"))


def duplicate_files(hashes: DataFrame) -> DataFrame:
    """``hash, n_files, first_path`` of contents that occur more than once."""
    return hashes.groupBy("hash").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path")).where("n_files > 1")


def with_extension(files: DataFrame, extensions, path: str = "path") -> DataFrame:
    return files.where(has_extension(F.col(path), extensions))


def _write_texts(batches):
    for batch in batches:
        names, sizes = batch.column(0).to_pylist(), []
        for name, text in zip(names, batch.column(1)):
            data = text.as_py().encode("utf-8")
            if _is_remote(name):
                system, inner = _store(name)
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(inner) as handle:
                    handle.write(data)
            else:
                local = _local(name)
                os.makedirs(os.path.dirname(local), exist_ok=True)
                with open(local, "wb") as handle:
                    handle.write(data)
            sizes.append(len(data))
        yield pa.record_batch([pa.array(names), pa.array(sizes, pa.int64())], names=["path", "size"])


def export_files(files: DataFrame, root: str) -> int:
    """Write ``file_path, code`` rows as files below ``root``; returns how many."""
    root = qualified(files.sparkSession, root)
    rows = files.select(F.concat(F.lit(root.rstrip("/") + "/"), "file_path").alias("path"), "code")
    return rows.mapInArrow(released(_write_texts), "path string, size bigint").count()
