"""Runs of repeated words, by Lyndon arrays from the first phase of a suffix sorter.

A run is a maximal stretch of words with a smallest period; here its length is three periods and ``least`` words at
least. Every run holds a Lyndon root: at some place of it, the longest Lyndon word that starts there, in the order of
the words or in the reverse order, is as long as the period. So both Lyndon arrays give all candidates, and a longest
common extension to the left and to the right of a root and its shift gives the run.

The Lyndon arrays come from Baier's grouping. Suffixes are grouped by their first word; groups are taken from the
highest down; each suffix of the group points to the nearest suffix before it that lies in a lower group, and what is
pointed to moves to a new group just above its own, whose context is longer by the group's for each pointer. When a
group is taken, its context is the longest Lyndon prefix of its suffixes. All steps are linear.

Before that, stretches that cannot hold a run are left out, exactly: in a run of at least 24 words and three periods
every window of eight words stands a second time, one period away, so a run lies in a stretch whose windows all repeat.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm import textbytes
from riskweave.llm.tables import free_name

LEAST = 24
#: Windows of so many words repeat inside a run: at most a third of ``LEAST``.
WINDOW = 8
#: Prefix hashes are taken modulo this prime; a match of two is checked on the words before it counts.
PRIME = (1 << 61) - 1
NEW = {"n_words": "long", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}


def lyndon_lengths(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, by grouping from the highest group down."""
    n = len(codes)
    members: list[list[int]] = [[] for _ in range(max(codes, default=-1) + 1)]
    for i, c in enumerate(codes):
        members[c].append(i)
    length = [1] * len(members)
    # Groups as a list from the lowest to the highest, and the places whose group is still to come.
    lower, higher = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    group = list(codes)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    out = [0] * n
    at = len(members) - 1
    while at >= 0:
        own = length[at]
        pointed: list[int] = []
        times: list[int] = []
        for i in members[at]:
            if group[i] != at:
                continue
            out[i] = own
            # Members leave from the first on, so what stands before i is in a lower group.
            before, after = left[i], right[i]
            if after < n:
                left[after] = before
            if before >= 0:
                right[before] = after
                if pointed and pointed[-1] == before:
                    times[-1] += 1
                else:
                    pointed.append(before)
                    times.append(1)
        moves: dict[tuple[int, int], list[int]] = {}
        for j, k in zip(pointed, times):
            moves.setdefault((k, group[j]), []).append(j)
        # Of those that leave one group, more pointers stand higher: put in first, right above their group.
        for k, g in sorted(moves, reverse=True):
            new, over = len(members), higher[g]
            members.append(moves[k, g])
            length.append(length[g] + k * own)
            lower.append(g)
            higher.append(over)
            lower[over], higher[g] = new, new
            for j in moves[k, g]:
                group[j] = new
        at = lower[at]
    return out


def _extents(codes: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of the stretches with that period around each ``(place, period)``."""
    n = len(codes)
    factor = random.Random(n).randrange(1 << 32, PRIME)
    sums = list(accumulate(codes.tolist(), lambda h, c: (h * factor + c + 1) % PRIME, initial=0))
    powers = list(accumulate(range(n), lambda p, _: p * factor % PRIME, initial=1))

    def equal(i: int, j: int, size: int) -> bool:
        p = powers[size]
        return (sums[i + size] - sums[i] * p - sums[j + size] + sums[j] * p) % PRIME == 0

    def common(i: int, j: int, most: int, step: int) -> int:
        """Longest common extension of two places to the right (step 1) or to the left (step -1)."""
        size = 1
        while size <= most and (equal(i, j, size) if step > 0 else equal(i - size, j - size, size)):
            size *= 2
        low, high = size // 2, min(size, most + 1)
        while high - low > 1:
            middle = (low + high) // 2
            if equal(i, j, middle) if step > 0 else equal(i - middle, j - middle, middle):
                low = middle
            else:
                high = middle
        return low

    out, done = [], {}
    for i, p in sorted(pairs, key=lambda x: (x[1], x[0])):
        if i + p <= done.get(p, 0):
            continue  # inside the last stretch of this period
        end = i + p + common(i, i + p, n - i - p, 1)
        start = i - common(i, i + p, i, -1)
        if not np.array_equal(codes[start : end - p], codes[start + p : end]):
            raise ArithmeticError("two different stretches of words have one hash")
        done[p] = end
        out.append((start, end, p))
    return out


def _stretches(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of words whose windows of ``WINDOW`` words all stand more than once, if a run could fit."""
    if len(codes) < LEAST:
        return
    grams = textbytes.grams(textbytes.mix(codes.astype(np.uint64) + np.uint64(1)), WINDOW)
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    repeated = np.zeros(len(grams) + 2, bool)
    repeated[1 + order[1:][same]] = repeated[1 + order[:-1][same]] = True
    edges = np.flatnonzero(repeated[1:] != repeated[:-1])
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if last - first + WINDOW - 1 >= LEAST:
            yield first, last + WINDOW - 1


def runs_of(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of numbered words, by start and period."""
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not looked for")
    found = set()
    for first, last in _stretches(codes):
        part = np.unique(codes[first:last], return_inverse=True)[1]
        for order in (part, part.max() - part):
            lengths = np.array(lyndon_lengths(order.tolist()))
            place = np.arange(len(part))
            # The first root of a run is followed by the same root, so the next length is the same.
            place = place[place + lengths < len(part)]
            place = place[lengths[place + lengths[place]] == lengths[place]]
            for start, end, p in _extents(part, list(zip(place.tolist(), lengths[place].tolist()))):
                if end - start >= max(least, 3 * p):
                    found.add((first + start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def collapse(docs: DataFrame, text: str = "text", source: Column | None = None, least: int = LEAST) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start and period) and ``collapsed``, the words that stay joined by a blank.

    Words are maximal stretches without ASCII blanks. ``source`` may repeat the text's tail before the search: a struct
    ``(first, period)`` by which word i >= first becomes word first + (i - first) % period; null leaves the text alone.
    Null, empty and blank texts have no words, no runs and collapse to the empty text. Rows that repeat are judged each
    on their own. Columns of the new names are replaced. A row's work grows with its words, and only that row is held.
    """
    kept = [c for c in docs.columns if c.lower() not in NEW]
    given, tail = free_name(docs.columns, "_text"), free_name(docs.columns, "_tail")
    repeat = source if source is not None else F.lit(None).cast("struct<first:bigint,period:bigint>")
    frame = docs.select(*kept, F.col(text).alias(given), repeat.alias(tail))

    def run(batches):
        for batch in batches:
            for a, b in textbytes.pieces(batch.column(given)):
                part = batch.slice(a, b - a)
                counts, runs, texts = [], [], []
                for value, again in zip(part.column(given), part.column(tail).to_pylist()):
                    words = (value.as_py() or "").encode().split()
                    known: dict[bytes, int] = {}
                    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                    if again and words:
                        at = np.arange(len(words))
                        first, period = again["first"], again["period"]
                        at = np.where(at >= first, first + (at - first) % period, at)
                        codes, words = codes[at], [words[i] for i in at.tolist()]
                    found = runs_of(codes, least)
                    if found:
                        words = [words[i] for i in np.flatnonzero(_kept(len(words), found)).tolist()]
                    counts.append(len(codes))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    texts.append(b" ".join(words).decode())
                struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                columns = [part.column(c) for c in range(len(kept))]
                columns += [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(struct)), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *NEW])

    schema = frame.select(*kept, *[F.lit(None).cast(kind).alias(name) for name, kind in NEW.items()]).schema
    return frame.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties go to the smaller start, then period."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def better(best, x):
        # Products of two lengths, in decimals wide enough for them.
        wide = lambda c: c.cast("decimal(19,0)")
        return F.when(best.isNull() | (wide(x["length"]) * wide(best["period"]) > wide(best["length"]) * wide(x["period"])), x).otherwise(best)

    return F.aggregate(runs, none, better)
