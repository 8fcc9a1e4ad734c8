"""Words and word n-grams of whole Arrow text batches, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from riskweave.session import release, released  # noqa: F401

BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Texts are hashed in pieces of about this many bytes, cut between words.
PIECE = 1 << 20


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _alnum_table() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing: 0-9, a-z, non-ASCII."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def _blank_table() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]``."""
    table = np.ones(256, dtype=bool)
    table[0x20] = False
    table[0x09:0x0E] = False
    return table


LOWER = _lower_table()
ALNUM = _alnum_table()
NON_BLANK = _blank_table()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (a fresh array)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column end to end, and where each text begins (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes (a longer text is a range of its own)."""
    _, offsets = flat(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last
        first = last


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    bounds: np.ndarray  # of each text's words: bounds[i] .. bounds[i + 1]
    texts: np.ndarray  # begin of each text in data

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def distinct(self) -> tuple[np.ndarray, pa.Array]:
        """The number of each word among the distinct words, and those, compared byte by byte."""
        if not len(self.starts):
            return np.zeros(0, np.int64), pa.array([], pa.large_binary())
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.starts] = 1
        edge[self.ends] -= 1
        body = self.data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        column = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        coded = column.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def hashes(self) -> np.ndarray:
        """64 bits for each word: the sum of a mixed value for each byte at each place.

        Unlike powers of a base modulo 2**64, of which Thue-Morse words collide whatever the base, places share no factor.
        """
        out = np.empty(len(self.starts), np.uint64)
        first = 0
        while first < len(out):
            last = int(np.searchsorted(self.starts, self.starts[first] + PIECE, "left"))
            last = max(last, first + 1)
            base, top = self.starts[first], self.ends[last - 1]
            s, e = self.starts[first:last] - base, self.ends[first:last] - base
            # Bytes before the next word count their place on; only those of a word are summed.
            place = np.arange(int(top - base)) - np.repeat(s, np.diff(s, append=top - base))
            value = mix((place.astype(np.uint64) << np.uint64(8) | self.data[base:top]) * BASE + STEP)
            sums = np.zeros(int(top - base) + 1, np.uint64)
            np.cumsum(value, dtype=np.uint64, out=sums[1:])
            out[first:last] = mix(sums[e] - sums[s] + (e - s).astype(np.uint64))
            first = last
        return out

    def text(self, word: int, n: int = 1) -> bytes:
        """Words joined by one blank."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[word : word + n], self.ends[word : word + n]))


def hashes_of(column: pa.Array) -> np.ndarray:
    """The same hashes for a column of single words (bytes, none null, empty ones allowed)."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Words(raw, offsets[:-1], offsets[1:], offsets[:1], offsets[:1]).hashes()


def words(column: pa.Array, table: np.ndarray = ALNUM) -> Words:
    data, offsets = flat(column)
    data = LOWER[data]
    inside = table[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words (also across texts: see ``within``)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    factor = 1
    for i in range(n):
        out += hashes[i : len(hashes) - n + 1 + i] * np.uint64(factor)
        factor = factor * int(STEP) % (1 << 64)
    return mix(out + np.uint64(n))


def within(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the ``grams`` lie in one text."""
    ok = np.ones(max(total - n + 1, 0), bool)
    for shift in range(1, n):
        at = bounds[1:-1] - shift
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def shingles(column: pa.Array, n: int, table: np.ndarray = NON_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted within each text, and each text's bounds in them.

    A text of fewer than ``n`` words, but not none, has its whole word sequence as one shingle.
    """
    found = words(column, table)
    h = found.hashes()
    ok = within(found.bounds, n, len(h))
    owner = found.owner()
    all_h, all_o = [grams(h, n)[ok]], [owner[: len(ok)][ok]]
    counts = found.counts
    for short in range(1, n):
        rows = np.flatnonzero(counts == short)
        if len(rows):
            at = found.bounds[rows]
            value, factor = np.zeros(len(rows), np.uint64), 1
            for i in range(short):
                value += h[at + i] * np.uint64(factor)
                factor = factor * int(STEP) % (1 << 64)
            all_h.append(mix(value + np.uint64(short)))
            all_o.append(rows)
    value, own = np.concatenate(all_h), np.concatenate(all_o)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[keep], own[keep]
    return value, np.searchsorted(own, np.arange(len(column) + 1))
