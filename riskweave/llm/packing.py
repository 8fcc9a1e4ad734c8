"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

Each document's tokens are cut into pieces whose lengths are powers of two, as many of the longest length as
fit and then the binary digits of the rest, longest first. Pieces of one length form a bucket; a batch of a
bucket has sequences of equal length, so there is nothing to pad.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import textbytes
from riskweave.llm.tables import free_name

#: Words whose ids a worker remembers, and new ones encoded at once; an encoding takes some hundred bytes a token.
KNOWN_WORDS = 500_000
NEW_WORDS = 8192
#: Bytes of text encoded at once.
PIECE = 2 << 20
#: One run of letters, none of which composes with another: exactly one unit of the splitter.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")
UNIT_END = "</w>"


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


NOT_BLANK = ~_table(b" \n")
MARK = _table(b".,;:!?")
LETTER = _table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: Second bytes of Latin letters that begin with C3.
LATIN = np.isin(np.arange(256), [i for i in range(0x80, 0xC0) if i not in (0x97, 0xB7)])


def units(column: pa.Array) -> textbytes.Words:
    """Parts of the texts that the vocabulary's splitter never joins: words, and the marks behind a word.

    ASCII letters are lower-cased, unless a special token may be meant, since those keep their case.
    """
    found = textbytes.words(column, NOT_BLANK)
    raw = textbytes.flat(column)[0]
    if ((raw[:-1] == ord("<")) & (raw[1:] == ord("|"))).any():
        found.data = raw
    data, starts, ends = found.data, found.starts, found.ends
    solid = np.flatnonzero(NOT_BLANK[data] & ~MARK[data])
    if not len(solid):
        return found
    last = solid[np.maximum(np.searchsorted(solid, ends) - 1, 0)]
    before = data[np.maximum(last - 1, 0)]
    letter = LETTER[data[last]] | ((before == 0xC3) & LATIN[data[last]] & (last - 1 >= starts))
    cut_here = (last >= starts) & (last < ends - 1) & letter
    first = np.arange(len(starts)) + np.cumsum(cut_here) - cut_here
    s, e = np.empty(len(starts) + int(cut_here.sum()), np.int64), np.empty(len(starts) + int(cut_here.sum()), np.int64)
    s[first], e[first] = starts, np.where(cut_here, last + 1, ends)
    s[first[cut_here] + 1], e[first[cut_here] + 1] = last[cut_here] + 1, ends[cut_here]
    return textbytes.Words(data, s, e, np.searchsorted(s, found.texts), found.texts)


class WordTokenizer:
    """Ids of whole texts for a vocabulary that drops blanks and folds case: ids of the words, end to end.

    Blanks never reach the merges of such a vocabulary, so each word is encoded once and remembered by its bytes,
    in flat arrays of some sixty bytes a word, since a worker keeps them. New words are encoded many at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        vocabulary = self.coder.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for w, i in vocabulary.items() if w.endswith(UNIT_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.hashes, self.places = pa.array([], pa.large_binary()), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words end to end, and how many each has."""
        plain = np.array([PLAIN.fullmatch(w) is not None for w in words], bool)
        sizes = np.zeros(len(words), np.int64)
        simple = [w for w, p in zip(words, plain.tolist()) if p]
        flat = np.zeros(0, np.uint32)
        if simple:
            flat = np.array(self.coder.encode_batch_fast([" ".join(simple)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closing[flat]) + 1
            if len(ends) == len(simple) and ends[-1] == len(flat):
                sizes[plain] = np.diff(ends, prepend=0)
            else:
                flat, plain = flat[:0], np.zeros(len(words), bool)
        coded = [c.ids for c in self.coder.encode_batch_fast([w for w, p in zip(words, plain.tolist()) if not p], add_special_tokens=False)]
        sizes[~plain] = [len(c) for c in coded]
        out = np.empty(int(sizes.sum()), np.uint32)
        is_plain = np.repeat(plain, sizes)
        out[is_plain] = flat
        out[~is_plain] = np.fromiter((i for c in coded for i in c), np.uint32)
        return out, sizes

    def _known(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Places of words among the remembered ones, -1 for others; a place found by hash holds the same bytes."""
        if not len(self.hashes):
            return np.full(len(words), -1, np.int64)
        place = self.places[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)].astype(np.int64)
        same = pc.equal(self.words.take(pa.array(place)), words).to_numpy(zero_copy_only=False)
        return np.where(same, place, -1)

    def _learn(self, words: pa.Array, hashes: np.ndarray) -> None:
        ids, bounds = [self.ids], [self.bounds]
        for first in range(0, len(words), NEW_WORDS):
            own, sizes = self._encoded([w.decode() for w in words.slice(first, NEW_WORDS).to_pylist()])
            ids.append(own)
            bounds.append(bounds[-1][-1] + np.cumsum(sizes))
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.places = np.insert(self.places, at, (len(self.words) + order).astype(np.int32))
        self.words = pa.concat_arrays([self.words, words])
        self.ids, self.bounds = np.concatenate(ids), np.concatenate(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's bounds in them (null: empty)."""
        found = units(texts)
        code, distinct = found.distinct()
        if len(self.words) + len(distinct) > KNOWN_WORDS:
            self._forget()
        hashes = textbytes.hashes_of(distinct)
        place = self._known(distinct, hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.words) + np.arange(len(new))
            self._learn(distinct.take(pa.array(new)), hashes[new])
        place = place[code]
        sizes = self.bounds[place + 1] - self.bounds[place]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.bounds[place] - (ends - sizes), sizes)
        return self.ids[at], np.concatenate([[0], ends])[found.bounds]


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and vocabulary, with what it remembers."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return WordTokenizer(path)


def cut(length: int, longest: int) -> list[int]:
    """Piece lengths: whole sequences, then the binary digits of the rest."""
    out = [longest] * (length // longest)
    rest = length % longest
    return out + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pack(docs: DataFrame, vocabulary: str, text: str = "text", longest: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: ``docs`` without its text, and

    ``start`` (tokens of the document before it), ``length`` (a power of two up to ``longest``), ``ids``
    (binary, little-endian unsigned 32-bit), ``doc_tokens`` (with the ending id), ``bucket`` (log2 of the
    length), ``sequence_id`` and ``offset`` (0: a sequence is one piece).

    A null or empty text is the ending id alone. Repeated rows are packed each on their own. Columns of the
    new names are replaced. ``sequence_id`` is unique within a result; it counts rows in their partition, so it
    is the same for the same input files and split size, and no shuffle is needed to give it.
    """
    new = ["start", "length", "ids", "doc_tokens"]
    taken = {*new, "bucket", "sequence_id", "offset", text.lower()}
    kept = [c for c in docs.columns if c.lower() not in taken]
    given = free_name(kept, "packed_text")
    frame = docs.select(*kept, F.col(text).alias(given))
    at_text = len(kept)

    def run(batches):
        coder = word_tokenizer(vocabulary)
        for batch in batches:
            for a, b in textbytes.pieces(batch.column(at_text), PIECE):
                part = batch.slice(a, b - a)
                ids, bounds = coder.encode(part.column(at_text))
                row, start, length, raw, whole = [], [], [], [], []
                for i in range(len(part)):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    n, pos = len(own) // 4, 0
                    for size in cut(n, longest):
                        row.append(i)
                        start.append(pos)
                        length.append(size)
                        raw.append(own[4 * pos : 4 * (pos + size)])
                        whole.append(n)
                        pos += size
                rest = part.select(list(range(at_text))).take(pa.array(row, pa.int32())) if at_text else None
                columns = [*(rest.columns if rest is not None else []), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary()), pa.array(whole, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    schema = frame.drop(given).withColumns({"start": F.lit(0).cast("long"), "length": F.lit(0).cast("long"), "ids": F.lit(b""), "doc_tokens": F.lit(0).cast("long")}).schema
    pieces = frame.mapInArrow(textbytes.released(run), schema)
    return pieces.select(
        "*",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
