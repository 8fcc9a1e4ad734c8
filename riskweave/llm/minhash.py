"""MinHash near-dedup with fast similarity sketching, banding and exact verification.

A sketch has ``BINS`` coordinates. In round i every shingle is thrown into one bin with the value
(i, hash); a bin keeps its least value, so the first round that reaches a bin decides it. The rounds from
``BINS`` on throw all shingles into one fixed bin each, so after ``2 * BINS`` rounds every coordinate is
filled, also for a set of one shingle. Equal coordinates estimate Jaccard similarity with the concentration
of sampling without replacement.

Plan: sketches are written once (narrow rows); equal shingle sets become one class; bands link every class to
the least class of its bucket; links are confirmed on full sets. Members of one bucket that are still in
different components are compared inside blocks of the bucket, by sketches and then on full sets, and each two
components that prove similar give one link. So each candidate pair of the bands is confirmed, refuted or already
connected, and the pairs inside a group of copies are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import textbytes
from riskweave.llm.graph import components
from riskweave.llm.tables import free_name, small_side, text_key
from riskweave.session import materialise

BINS = 128
ROWS = 4
BANDS = BINS // ROWS
#: Pairs whose sketches agree on fewer coordinates than this far below the threshold aren't compared in full. The
#: chance that a pair at the threshold is one of them (binomial) is below the chance that no band finds it.
SLACK = 0.22
#: Bytes of text sketched at once, and pairs of members compared by one task.
SKETCH_PIECE = 256 << 10
TASK_PAIRS = 4_000_000
#: Members of a bucket, and their shingles, that one group holds on either side.
BLOCK = 2048
BLOCK_SHINGLES = 500_000
#: Shingles compared in one matrix product.
COLUMNS = 4096


def sketches(values: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` coordinates for each set ``values[bounds[i]:bounds[i + 1]]``; empty sets give the top value."""
    n = len(bounds) - 1
    out = np.full(n * bins, np.uint64(2**64 - 1))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    seeds = np.random.default_rng(7).integers(1, 2**63, 2 * bins, dtype=np.uint64)
    for i in range(2 * bins):
        if not len(values):
            break
        h = textbytes.mix(values ^ seeds[i])
        at = (h >> shift).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        value = (h & np.uint64((1 << 48) - 1)) | (np.uint64(i) << np.uint64(48))
        np.minimum.at(out, owner * bins + at, value)
        open_ = (out.reshape(n, bins) == np.uint64(2**64 - 1)).any(axis=1)
        if not open_[owner].all():
            keep = open_[owner]
            values, owner = values[keep], owner[keep]
    return out.reshape(n, bins)


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    n = len(sketch)
    parts = sketch.reshape(n, BANDS, ROWS)
    out = np.zeros((n, BANDS), np.uint64)
    for r in range(ROWS):
        out = textbytes.mix(out * textbytes.STEP + parts[:, :, r])
    return textbytes.mix(out + np.arange(BANDS, dtype=np.uint64))


def _signed(values: np.ndarray, kind=pa.int64()) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), kind)


def sketch_table(docs: DataFrame, row_id: str, text: str, n: int) -> DataFrame:
    """``(id, t, n_shingles, h1, h2, bands, mark)``: text key, the set's size, 128-bit hash, band hashes and low sketch bytes."""

    def run(batches):
        for batch in batches:
            for a, b in textbytes.pieces(batch.column(2), SKETCH_PIECE):
                part = batch.slice(a, b - a)
                values, bounds = textbytes.shingles(part.column(2), n)
                sizes = np.diff(bounds)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(textbytes.mix(values + np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
                h1, h2 = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                sketch = sketches(values, bounds)
                bands = band_hashes(sketch)
                offsets = pa.array(np.arange(len(part) + 1) * BANDS, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(sizes, pa.int64()),
                        _signed(h1),
                        _signed(h2),
                        pa.ListArray.from_arrays(offsets, _signed(bands.reshape(-1))),
                        pa.array([row.tobytes() for row in sketch.astype(np.uint8)], pa.binary()),
                    ],
                    names=["id", "t", "n_shingles", "h1", "h2", "bands", "mark"],
                )
            textbytes.release()

    return _keyed(docs, row_id, text).mapInArrow(textbytes.released(run), "id long, t long, n_shingles long, h1 long, h2 long, bands array<long>, mark binary")


def _keyed(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    return docs.select(F.col(row_id).cast("long").alias("id"), text_key(F.col(text)).alias("t"), F.col(text).alias("text"))


def _least(percent: int) -> float:
    return (percent / 100 - SLACK) * BINS


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and sketches leave the threshold open."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in ("mark_a", "mark_b"))
            keep = (x == y).sum(axis=1) >= _least(percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    sized = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return sized.select("a", "b", "mark_a", "mark_b").mapInArrow(textbytes.released(run), "a long, b long")


def _sides(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Members of the two blocks that a group compares (the same twice within one block)."""
    block = group["block"].to_numpy()
    return np.flatnonzero(block == group["i"].iat[0]), np.flatnonzero(block == group["j"].iat[0])


def _hopeful(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Members that may be similar to one of another component, by size and sketch."""
    comp, size = group["c"].to_numpy(), group["n"].to_numpy()
    marks = np.frombuffer(b"".join(group["mark"]), np.uint8).reshape(-1, BINS)
    left, right = _sides(group)
    some = np.zeros(len(group), bool)
    for x in left:
        y = right[(comp[right] != comp[x]) & (100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x]))]
        y = y[(marks[y] == marks[x]).sum(axis=1) >= _least(percent)]
        some[y] = True
        some[x] |= len(y) > 0
    return group.loc[some, ["id", "c", "block", *BLOCK_KEYS]]


def _block_links(group: pd.DataFrame, percent: int, n: int) -> pd.DataFrame:
    """One link for each two components of the group that have similar members, on full sets."""
    values, bounds = textbytes.shingles(pa.array(group["text"], pa.string()), n)
    size, owner = np.diff(bounds), np.repeat(np.arange(len(group)), np.diff(bounds))
    left, right = _sides(group)
    _, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1  # only shared shingles can be in an intersection
    shared = counts[place] > 1
    owner, column = owner[shared], column[place[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        dense = np.zeros((len(group), COLUMNS), np.float32)
        dense[owner[a:b], column[a:b] - first] = 1
        both += dense[left] @ dense[right].T
    union = size[left][:, None] + size[right][None, :] - both
    comp, ids = group["c"].to_numpy(), group["id"].to_numpy()
    x, y = np.nonzero((100 * both >= percent * union) & (comp[left][:, None] != comp[right][None, :]))
    x, y = left[x], right[y]
    ends = np.stack([np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])], axis=1)
    _, one = np.unique(ends, axis=0, return_index=True)
    return pd.DataFrame({"a": ids[x[one]], "b": ids[y[one]]})


BUCKET = ["band", "value"]
BLOCK_KEYS = [*BUCKET, "i", "j"]


def _by_block(rows: DataFrame, function, schema: str, tasks: int) -> DataFrame:
    """``function`` of each group of equal block keys, many small groups to a call from Spark, dealt to so many tasks."""

    def run(frames):
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(held):
                continue
            key = held[BLOCK_KEYS].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            for a, b in zip(starts[:-1], starts[1:]):
                yield function(held.iloc[a:b])
            held = held.iloc[starts[-1] :]
        if held is not None and len(held):
            yield function(held)

    return rows.repartition(tasks, *BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInPandas(textbytes.released(run), schema)


def _across(placed: DataFrame, narrow: DataFrame, texts: Callable[[DataFrame], DataFrame], percent: int, n: int) -> DataFrame:
    """Links between components of ``placed`` (id, band, value, c) that share a bucket."""
    sized = materialise(placed.join(narrow, "id"), "placed")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    mixed = sized.groupBy(*BUCKET).agg(F.min("c").alias("low"), F.max("c").alias("high"), blocks.alias("blocks"), F.count("*").alias("members")).where("low <> high")
    mixed = materialise(mixed, "mixed")
    # Equal counts of pairs for all tasks, whatever the bytes: a task must not grow with its bucket.
    pairs = mixed.agg(F.sum(F.col("members").cast("double") ** 2)).first()[0] or 0
    tasks = max(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS))
    rows = sized.join(small_side(mixed.drop("low", "high", "members"), 24), BUCKET).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("id", "c", "n", "mark", "block", *BUCKET, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    schema = "id long, c long, block int, band int, value long, i int, j int"
    hopeful = materialise(_by_block(rows, lambda g: _hopeful(g, percent), schema, tasks), "hopeful")
    kept = texts(hopeful.select("id").distinct())
    return _by_block(hopeful.join(kept, "id"), lambda g: _block_links(g, percent, n), "a long, b long", tasks).distinct()


def _confirmed(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], n: int, percent: int) -> DataFrame:
    """Pairs that hold on their full shingle sets: 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            first = 0
            sizes = np.diff(textbytes.flat(batch.column("text_a"))[1]) + np.diff(textbytes.flat(batch.column("text_b"))[1])
            ends = np.cumsum(sizes)
            while first < len(batch):
                done = ends[first - 1] if first else 0
                last = max(int(np.searchsorted(ends, done + 2 * textbytes.PIECE, "right")), first + 1)
                part = batch.slice(first, last - first)
                (va, ba), (vb, bb) = (textbytes.shingles(part.column(k), n) for k in ("text_a", "text_b"))
                pair = np.concatenate([np.repeat(np.arange(len(part)), np.diff(ba)), np.repeat(np.arange(len(part)), np.diff(bb))])
                value = np.concatenate([va, vb])
                order = np.lexsort((value, pair))
                pair, value = pair[order], value[order]
                same = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
                both = np.bincount(pair[1:][same], minlength=len(part))
                union = np.diff(ba) + np.diff(bb) - both
                yield part.select(["a", "b"]).filter(pa.array((100 * both >= percent * union) & (union > 0)))
                first = last

    kept = texts(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    with_a = pairs.join(kept.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(kept.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(textbytes.released(run), "a long, b long")


def grouped(docs: DataFrame, row_id: str, text: str, n: int, percent: int) -> DataFrame:
    """``(id, t, n_shingles, component_id, first)`` for every row; ``first`` marks the rows of each component's least ``(id, t)``.

    Rows are known by id and text key, so an id may stand over several texts.
    """
    table = materialise(sketch_table(docs, row_id, text, n), "sketches")
    classes = (
        table.where("id is not null and n_shingles > 0")
        .groupBy("h1", "h2", "n_shingles")
        .agg(F.min(F.struct("id", "t")).alias("least"), F.first("bands").alias("bands"), F.first("mark").alias("mark"))
    )
    # Numbered as they are written; the number stands for the class from here on.
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    narrow = classes.select("id", F.col("n_shingles").alias("n"), "mark")
    buckets = classes.select("id", F.posexplode("bands").alias("band", "value"))
    leaders = buckets.groupBy("band", "value").agg(F.min("id").alias("leader"), F.count("*").alias("members")).where("members > 1")
    buckets = materialise(buckets.join(leaders, ["band", "value"]).select("id", "band", "value", "leader"), "buckets")

    def texts(wanted: DataFrame) -> DataFrame:
        """``(id, text)`` of classes: the text of the least row."""
        wanted = materialise(classes.select("id", "least").join(wanted, "id", "left_semi").select(F.col("id").alias("class"), "least.id", "least.t"), "wanted")
        found = _keyed(docs, row_id, text).join(small_side(wanted, 40), ["id", "t"])
        # A repeated row gives its text twice.
        return materialise(found.select(F.col("class").alias("id"), "text").dropDuplicates(["id"]), "texts")

    star = buckets.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda k: narrow.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("mark").alias(f"mark_{k}"))
    pairs = materialise(_similar(star.join(side("a"), "a").join(side("b"), "b"), percent), "pairs")
    merged = materialise(components(materialise(_confirmed(pairs, texts, n, percent), "links")), "parts")
    placed = buckets.join(merged, buckets.id == merged.node, "left").select("id", "band", "value", F.coalesce("component", "id").alias("c"))
    more = materialise(_across(placed, narrow, texts, percent, n), "links")
    known = merged.select(F.col("node").alias("a"), F.col("component").alias("b"))
    merged = materialise(components(known.unionByName(more)), "parts")
    placed = classes.join(merged, classes.id == merged.node, "left").select("h1", "h2", "n_shingles", "least", F.coalesce("component", "id").alias("c"))
    leasts = placed.groupBy("c").agg(F.min("least").alias("first"))
    of_class = placed.select("h1", "h2", "n_shingles", "c").join(leasts, "c").drop("c")
    out = table.select("id", "t", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2", "n_shingles"], "left")
    # Without shingles, or without an id, a row is linked with nothing.
    alone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    return out.select(
        "id", "t", "n_shingles",
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        (alone | (F.struct("id", "t") == F.col("first"))).alias("first"),
    )


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``(row_id, n_shingles, component_id, kept)`` for every row; ``kept`` marks the least id of each component.

    Null, empty and blank texts have no shingles and are linked with nothing. A text of fewer than ``n`` words
    is one shingle. Rows that repeat an id each get their row, with the component of their own text. A row with
    a null id is in no component: its ``component_id`` is null and it is kept. Ids are whole numbers. Extra columns
    are ignored.
    """
    out = grouped(docs, row_id, text, n, percent)
    return out.select(F.col("id").alias(row_id), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, row_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns as they are, without the rows whose component has a row of smaller ``(id, text key)``.

    A row given twice is one document: both stay or both go.
    """
    gone = grouped(docs, row_id, text, n, percent).where("not first").select(F.struct("id", "t").alias("row")).distinct()
    gone = small_side(materialise(gone, "copies"), 24)
    other = free_name(docs.columns, "_row")
    key = F.struct(F.col(row_id).cast("long").alias("id"), text_key(F.col(text)).alias("t"))
    return docs.join(gone.withColumnRenamed("row", other), key == F.col(other), "left_anti")
