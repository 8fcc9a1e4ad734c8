"""Sharding by histogram sort: exact bytes below candidate boundaries, refined until the splitters fit.

Keys are pairs (hash of a group, row id) in one total order, so equal texts lie side by side. The driver keeps
a sorted list of probes with the exact bytes and rows below each. A round adds probes inside every interval
that is still too coarse and counts them in one pass over a narrow written table; tasks send one sum per
interval. When every splitter is within tolerance, or cannot be closer, the rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskweave.llm.tables import free_name
from riskweave.session import materialise

LOW = -(1 << 63)
SPAN = 1 << 64
#: Probes added to an interval in one round.
FAN = 16


def _order(key: int, tie: int) -> int:
    return ((key - LOW) << 64) | (tie - LOW)


def _pair(order: int) -> tuple[int, int]:
    return (order >> 64) + LOW, (order & (SPAN - 1)) + LOW


class Probes:
    """Boundaries in sorted order; ``bin`` of a row is the number of boundaries at or below its key."""

    def __init__(self, orders: list[int]):
        pairs = [_pair(o) for o in orders]
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.ties = np.array([t for _, t in pairs], np.int64)

    def bins(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = high.copy()
        shared = np.flatnonzero(high > low)
        for key in np.unique(keys[shared]):
            rows = shared[keys[shared] == key]
            a, b = low[rows[0]], high[rows[0]]
            out[rows] = a + np.searchsorted(self.ties[a:b], ties[rows], "right")
        return out


@dataclass
class Histogram:
    """Probes with the bytes and rows below each; the last entry is the end of the key space."""

    orders: list[int]
    bytes_below: list[int]
    rows_below: list[int]


def _counts(table: DataFrame, probes: Probes) -> dict[int, tuple[int, int]]:
    def run(frames):
        for f in frames:
            if len(f):
                sums = pd.DataFrame({"bin": probes.bins(f["key"].to_numpy(), f["tie"].to_numpy()), "bytes": f["size"], "rows": 1})
                yield sums.groupby("bin", as_index=False).sum()

    found = table.mapInPandas(run, "bin long, bytes long, rows long").groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    return {r.bin: (r.bytes, r.rows) for r in found.collect()}


def _steps(low: int, high: int, ties: tuple[int, int]) -> list[int]:
    """Up to ``FAN`` boundaries strictly between two; between groups as long as there is room, then inside one."""
    (a, _), (b, _) = _pair(low), _pair(min(high, (1 << 128) - 1))
    if b - a > 1:
        return sorted({_order(a + max(1, (b - a) * i // (FAN + 1)), LOW) for i in range(1, FAN + 1)} - {low, high})
    first, last = max(low + 1, _order(a, ties[0])), min(high, _order(a, ties[1]) + 1)
    if last <= first:
        return []
    return sorted({first + (last - first) * i // (FAN + 1) for i in range(1, FAN + 1)} | {first} - {low, high})


def histogram(table: DataFrame, shards: int, tolerance: float, bin_rows: int) -> tuple[Histogram, list[int]]:
    """Probes fine enough for ``shards`` splitters, and the splitters' places among them.

    ``table`` has ``key``, ``tie`` and ``size``. An interval is refined while it holds a wanted boundary and
    neither end is within ``tolerance`` of a shard of it, or while it has more than ``bin_rows`` rows; intervals of
    one row, or of rows that are equal in key and tie, are as fine as can be.
    """
    stats = table.agg(F.count("*"), F.sum("size"), F.min("tie"), F.max("tie")).first()
    rows, total = stats[0], stats[1] or 0
    if not rows:
        return Histogram([0], [0], [0]), [0] * (shards - 1)
    ties = (stats[2], stats[3])
    end = 1 << 128
    width = SPAN // (FAN * shards)
    orders = [0] + [_order(LOW + width * i, LOW) for i in range(1, FAN * shards)]
    allowed = tolerance * total / shards
    limit = max(1, min(bin_rows, 2 * rows // (FAN * shards)))
    known: Histogram | None = None
    while True:
        counts = _counts(table, Probes(orders[1:]))
        below_b, below_r, b, r = [], [], 0, 0
        for i in range(len(orders)):
            below_b.append(b)
            below_r.append(r)
            more = counts.get(i, (0, 0))
            b, r = b + more[0], r + more[1]
        known = Histogram(orders + [end], below_b + [b], below_r + [r])
        wanted = set()
        for s in range(1, shards):
            target = total * s / shards
            i = bisect_left(known.bytes_below, target)
            near = min(abs(known.bytes_below[j] - target) for j in (i - 1, i) if 0 <= j < len(known.bytes_below))
            if near > allowed and 0 < i:
                wanted.add(i - 1)
        wanted |= {i for i in range(len(orders)) if known.rows_below[i + 1] - known.rows_below[i] > limit}
        fresh = [o for i in wanted if known.rows_below[i + 1] - known.rows_below[i] > 1 for o in _steps(known.orders[i], known.orders[i + 1], ties)]
        fresh = sorted(set(fresh) - set(orders))
        if not fresh:
            break
        orders = sorted(orders + fresh)
    splitters = []
    for s in range(1, shards):
        target = total * s / shards
        i = bisect_left(known.bytes_below, target)
        close = [j for j in (i - 1, i) if 0 <= j < len(known.orders)]
        whole = [j for j in range(max(i - 2 * FAN, 0), min(i + 2 * FAN, len(known.orders))) if _pair(min(known.orders[j], end - 1))[1] == LOW and abs(known.bytes_below[j] - target) <= allowed]
        best = min(whole or close, key=lambda j: abs(known.bytes_below[j] - target))
        splitters.append(max(best, splitters[-1] if splitters else 0))
    return known, splitters


def shard(
    docs: DataFrame, key: str, tie: str, size: str, shards: int, tolerance: float = 0.02, bin_rows: int = 1_000_000
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard, in key order).

    ``key`` (long) groups rows that should stay together: a group is cut only where the tolerance, a share of
    the mean shard, could not be met otherwise, so a hot group spreads over as many shards as its bytes fill.
    ``tie`` (long) orders a group. Null keys, ties or sizes count as 0 and their columns stay as they are. Rows
    equal in key and tie are never separated. Columns named ``shard`` or ``slot`` are replaced. An empty table
    gives an empty result.
    """
    value = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    table = materialise(docs.select(value(key).alias("key"), value(tie).alias("tie"), value(size).alias("size")), "keys")
    known, splitters = histogram(table, shards, tolerance, bin_rows)
    probes = Probes(known.orders[1:-1])
    shard_of = np.searchsorted(np.array(splitters, np.int64), np.arange(len(known.orders)), "right")
    start_of_shard = [0, *(known.rows_below[s] for s in splitters)]
    start = np.array([known.rows_below[i] - start_of_shard[shard_of[i]] for i in range(len(known.orders))], np.int64)

    @F.pandas_udf("bin long, shard int, start long")
    def place(keys: pd.Series, ties: pd.Series) -> pd.DataFrame:
        at = probes.bins(keys.to_numpy(), ties.to_numpy())
        return pd.DataFrame({"bin": at, "shard": shard_of[at].astype("int32"), "start": start[at]})

    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    at, nr = free_name(docs.columns, "_place"), free_name(docs.columns, "_nr")
    placed = docs.withColumn(at, place(value(key), value(tie)))
    in_bin = W.partitionBy(f"{at}.bin").orderBy(value(key), value(tie), value(size))
    return placed.withColumn(nr, F.row_number().over(in_bin)).select(
        *kept, F.col(f"{at}.shard").alias("shard"), (F.col(f"{at}.start") + F.col(nr) - 1).alias("slot")
    )
