"""Benchmark decontamination: broadcast n-gram set, scan of all token windows, exact check of hits.

The windows of the benchmark are put into a broadcast table of known size. Every document's windows are
hashed in numpy; a hash that is in the table is confirmed on the words themselves before it counts.
A benchmark larger than ``group_bytes`` is scanned in groups, one after the other, each within the bound;
the spans found so far travel along, so nothing is shuffled in either case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import textbytes

SPANS = "array<struct<start:bigint,length:bigint>>"


def windows_of(text: str | None, n: int) -> list[bytes]:
    """Distinct windows of an item: ``n`` words, or all its words if it has fewer but some."""
    found = textbytes.words(pa.array([text], pa.string()))
    total = len(found.starts)
    if not total:
        return []
    size = min(n, total)
    return list(dict.fromkeys(found.text(i, size) for i in range(total - size + 1)))


class WindowSet:
    """Windows by length: sorted hashes for numpy, and item ids by the window's own bytes."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.owners: dict[bytes, list[str | None]] = {}
        for item, text in items:
            for window in windows_of(text, n):
                self.owners.setdefault(window, []).append(item)
        by_length: dict[int, list[bytes]] = {}
        for window in self.owners:
            by_length.setdefault(window.count(b" ") + 1, []).append(window)
        self.tables = {}
        for size, wins in by_length.items():
            h = [textbytes.grams(textbytes.words(pa.array([w.decode()])).hashes(), size)[0] for w in wins]
            h = np.unique(np.array(h, np.uint64))
            bitmap = np.zeros(1 << 20, bool)
            bitmap[h >> np.uint64(44)] = True
            self.tables[size] = (h, bitmap)

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its number of words, the covered word spans, the items that occur."""
        found = textbytes.words(column)
        hashes = found.hashes()
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        owner = None
        for size, (known, bitmap) in self.tables.items():
            h = textbytes.grams(hashes, size)
            at = np.flatnonzero(bitmap[h >> np.uint64(44)] & textbytes.within(found.bounds, size, len(hashes)))
            at = at[np.isin(h[at], known)]
            if len(at) and owner is None:
                owner = found.owner()
            for i in at.tolist():
                who = self.owners.get(found.text(i, size))
                if who:
                    row = int(owner[i])
                    first = i - int(found.bounds[row])
                    spans.setdefault(row, []).append((first, first + size))
                    items.setdefault(row, set()).update(w for w in who if w is not None)
        for row, count in enumerate(found.counts.tolist()):
            yield count, spans.get(row, []), items.get(row, set())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan_group(docs: DataFrame, held, text: str) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def run(batches):
        known = held.value
        for batch in batches:
            column = batch.column(text)
            fields = batch.schema.names
            for a, b in textbytes.pieces(column):
                part = batch.slice(a, b - a)
                counts, spans, items = [], [], []
                old_s, old_i = part.column("spans").to_pylist(), part.column("item_ids").to_pylist()
                for row, (count, new, who) in enumerate(known.scan(part.column(text))):
                    before = [(s["start"], s["start"] + s["length"]) for s in old_s[row] or ()]
                    counts.append(count)
                    spans.append([{"start": x, "length": y - x} for x, y in merged(before + new)])
                    items.append(sorted(who.union(old_i[row] or ())))
                new_columns = {
                    "n_words": pa.array(counts, pa.int64()),
                    "spans": pa.array(spans, batch.schema.field("spans").type),
                    "item_ids": pa.array(items, batch.schema.field("item_ids").type),
                }
                yield pa.RecordBatch.from_arrays(
                    [new_columns.get(f, part.column(f)) for f in fields], schema=batch.schema
                )

    return docs.mapInArrow(textbytes.released(run), schema)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    group_bytes: int = 4 << 20,
) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (word spans hit, disjoint, in order) and ``item_ids`` (strings, sorted).

    Null or empty texts have no words and no spans; items without words match nothing; an item without an id hits but is
    not listed; repeated items and rows are each kept; an empty benchmark hits nothing. The three new columns replace any of those names.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / group_bytes))
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "spans", "item_ids") or c == text]
    out = docs.select(
        *kept,
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(SPANS).alias("spans"),
        F.array().cast("array<string>").alias("item_ids"),
    )
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == g) if groups > 1 else items
        held = docs.sparkSession.sparkContext.broadcast(WindowSet([(r.i, r.t) for r in part.collect()], n))
        out = _scan_group(out, held, text)
    return out


def remove(found: DataFrame, text: str = "text", min_share: float = 0.0) -> DataFrame:
    """Drop documents of which more than ``min_share`` of the words is hit (by default, any word)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return found.where(hit <= F.lit(min_share) * F.col("n_words"))


def cut_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Delete the hit spans from the texts, from the first byte of the first word to the last word's end."""

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(text)
            out = []
            for value, spans in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist()):
                if value and spans:
                    w = textbytes.words(pa.array([value]))
                    raw, pos, parts = value.encode(), 0, []
                    for s in spans:
                        parts.append(raw[pos : int(w.starts[s["start"]])])
                        pos = int(w.ends[s["start"] + s["length"] - 1])
                    value = b"".join([*parts, raw[pos:]]).decode()
                out.append(value)
            columns = batch.columns
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return found.mapInArrow(textbytes.released(run), found.schema)
