"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums counts per language and bucket inside the tasks, and a task sends one row for each language and bucket it
met. The matrix of log probabilities has ``buckets x languages`` entries, is bounded by ``max_languages`` and is
broadcast. A batch of texts is scored at once: the buckets of all its n-grams stand end to end, gather rows of the
matrix, and are summed between the texts' bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import textbytes
from riskweave.llm.tables import free_name
from riskweave.session import materialise

#: log2 of the number of buckets.
BITS = 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Characters looked at together; n-grams across the cut of a longer text belong to the part they begin in.
PIECE = 1 << 17
#: Languages scored together.
COLUMNS = 16


def parts_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(buckets, owner)`` of all n-grams of the texts, lower-cased, with a blank at each end: some ``PIECE`` characters
    and one order at a time, owners ascending."""
    waiting: list[tuple[int, str, int]] = []  # text number, characters, how many of them may begin an n-gram
    size = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        padded = f" {text.lower()} "
        for at in range(0, len(padded), PIECE):
            begins = min(PIECE, len(padded) - at)
            waiting.append((i, padded[at : at + begins + max(ORDERS) - 1], begins))
            size += begins
            if size >= PIECE:
                yield from _buckets(waiting)
                waiting, size = [], 0
    if waiting:
        yield from _buckets(waiting)


def _buckets(parts: list[tuple[int, str, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    code = np.frombuffer("".join(p for _, p, _ in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(p) for _, p, _ in parts])
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(code))  # characters from here to the end of the part
    may = np.repeat(np.array([b for _, _, b in parts]) - sizes, sizes) + left > 0
    owner = np.repeat(np.array([i for i, _, _ in parts]), sizes)
    h = np.zeros(len(code), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(code) < order:
            break
        h = h[: len(code) - order + 1] * np.uint32(0x01000193) + (code[order - 1 :] + np.uint32(order)) * np.uint32(0x9E3779B1)
        if order in ORDERS:
            whole = may[: len(h)] & (left[: len(h)] >= order)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
            if whole.any():
                yield (mixed >> np.uint32(32 - BITS))[whole].astype(np.int64), owner[: len(h)][whole]


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray  # buckets x languages, log probabilities

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Log probability of each text with each language, but for a shared constant."""
        total = np.repeat(self.prior[None], len(texts), axis=0)
        for buckets, owner in parts_of(texts):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            for at in range(0, len(self.languages), COLUMNS):
                total[owner[first], at : at + COLUMNS] += np.add.reduceat(self.weights[buckets, at : at + COLUMNS], first, axis=0)
        return total

    def answers(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text; ``und`` and 0 without a letter or a lesson."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        total = self.scores([t if k else None for t, k in zip(texts, known.tolist())])
        best = total.argmax(axis=1)
        posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], np.where(known, posterior, 0.0)


def _batches(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some ``PIECE`` characters of text each."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.cumsum(sizes) // PIECE
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def train(labelled: DataFrame, text: str = "text", language: str = "lang", max_languages: int = 1000, smoothing: float = 0.1) -> Model:
    """Fit on every row that has a text and a language.

    Rows without either, or with an empty text, teach nothing. No such row gives a model that answers ``und``.
    More than ``max_languages`` distinct values raise ``ValueError``: the matrix would have no size bound.
    """

    def count(batches):
        held: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for part in _batches(batch, 0):
                texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
                names = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
                of = np.array([names[lang] for lang in langs], np.int64)
                for lang in langs:
                    seen[lang] = seen.get(lang, 0) + 1
                if len(seen) > max_languages:
                    raise ValueError(f"more than {max_languages} languages")
                for buckets, owner in parts_of(texts):
                    for lang, i in names.items():
                        own = buckets[of[owner] == i]
                        if len(own):
                            held[lang] = held.get(lang, 0) + np.bincount(own, minlength=1 << BITS)
        for lang, counts in held.items():
            met = np.flatnonzero(counts)
            # Bucket -1 holds the number of texts.
            buckets, n = np.append(met, -1), np.append(counts[met], seen[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(buckets, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"])

    kept = labelled.select(F.col(text).alias("t"), F.col(language).cast("string").alias("l")).where("t is not null and l is not null and t <> ''")
    partial = kept.mapInArrow(textbytes.released(count), "lang string, bucket int, n long")
    summed = materialise(partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "buckets")
    names = summed.where("bucket < 0").select("lang").limit(max_languages + 1).collect()
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(r.lang for r in names)
    counts = np.zeros((1 << BITS, len(languages)))
    if not languages:
        return Model([], np.zeros(0), counts)
    # At most one row for each bucket of each language.
    table = summed.toArrow()
    at = {lang: i for i, lang in enumerate(languages)}
    column = np.array([at[lang] for lang in table.column("lang").to_pylist()], np.int64)
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    docs = np.zeros(len(languages))
    docs[column[bucket < 0]] = n[bucket < 0]
    weights = np.log((counts + smoothing) / (counts + smoothing).sum(axis=0))
    return Model(languages, np.log(docs / docs.sum()), weights)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the posterior probability of the answer).

    Null texts and texts without a letter get ``und`` and 0. Columns of those names are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    language, posterior = free_name(kept, "lang_pred"), free_name(kept, "score")
    return answered(docs.select(*kept, *([] if text in kept else [text])), model, text, language, posterior).select(*kept, language, posterior)


def answered(docs: DataFrame, model: Model, text: str, language: str, posterior: str) -> DataFrame:
    """``docs``, all columns as they are, with the answers under two names that are free."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in _batches(batch, at):
                names, scores = held.value.answers(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*part.schema.names, language, posterior])
            textbytes.release()

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + [T.StructField(language, T.StringType()), T.StructField(posterior, T.DoubleType())])
    return docs.mapInArrow(textbytes.released(run), schema)


def in_training(doc_id) -> F.Column:
    """The fold that may teach: crc32 of the id's text modulo 4 is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(True))


__all__ = ["Model", "predict", "train", "in_training"]
