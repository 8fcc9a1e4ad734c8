"""Hidden Markov language model of word sequences, trained by Baum-Welch over all partitions.

A text is its words, ASCII letters lower-cased, and one end. Hidden states emit classes of words (buckets of a hash;
the end is a class of its own), and a class emits the word by its count in the training texts:

    P(text) = P_hmm(classes) * product of (c(word) + 1) / (c(class) + distinct(class) + 1)

so every word has a probability and the table of states by classes has a fixed size, while counts are kept for every
word. Words are counted exactly: blocks of documents list their distinct words in the order of a hash, slices of that
order meet in one task for all blocks, and the counts return to the blocks; slices are as many as the listed words ask
for, so no task and no driver holds the vocabulary.

Training runs rounds of Baum-Welch. Each task adds up the expected counts of its blocks and sends one row for each
class it met; the rows are summed by class and the driver, which holds only the bounded table, normalises them.

The forward recursion is scaled and exact. Long texts are cut into chunks that run side by side: products of the
transition matrices over each chunk carry the messages across the cuts, so cuts change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm import textbytes
from riskweave.session import materialise

#: Bytes of text in a block of documents (a longer text is a block of its own).
BLOCK = 2 << 20
#: Number of word classes; class 0 is the end of a text.
CLASSES = 1 << 15
#: Listed words that meet in one task.
SLICE = 1 << 20
CHUNK = 512
#: Steps between two scalings of a product; a factor of 1e-15 a step is far from the least double.
RESCALE = 16
END = b""


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states, rows sum to one
    emit: np.ndarray  # classes x states, columns sum to one


def initial(states: int, prior: np.ndarray, seed: int = 13) -> Model:
    """States near the class frequencies ``prior``, told apart by fixed noise."""
    rng = np.random.default_rng(seed)
    emit = prior[:, None] * rng.uniform(0.5, 1.5, (len(prior), states))
    move = rng.uniform(0.5, 1.5, (states, states))
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Packed:
    """Chunks of sequences side by side, longest first: step t of all chunks that have one lies together."""

    def __init__(self, classes: np.ndarray, sizes: np.ndarray, chunk: int = CHUNK):
        per = -(-sizes // chunk)
        first = np.cumsum(per) - per  # number of each sequence's first chunk
        seq = np.repeat(np.arange(len(sizes)), per)
        place = np.arange(len(seq)) - first[seq]
        begin = (np.cumsum(sizes) - sizes)[seq] + place * chunk
        length = np.minimum(sizes[seq] - place * chunk, chunk)
        order = np.argsort(-length, kind="stable")
        self.row = np.empty(len(order), np.int64)  # where each chunk stands
        self.row[order] = np.arange(len(order))
        self.first, self.per = first, per
        self.seq, begin, self.length = seq[order], begin[order], length[order]
        steps = int(self.length[0]) if len(order) else 0
        self.active = np.searchsorted(-self.length, -np.arange(steps), "left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        where = np.concatenate([begin[:n] + t for t, n in enumerate(self.active)]) if steps else np.zeros(0, np.int64)
        self.classes = classes[where]

    def step(self, t: int) -> slice:
        return slice(int(self.offset[t]), int(self.offset[t + 1]))

    def last(self) -> np.ndarray:
        """Where each chunk's last step lies."""
        return self.offset[self.length - 1] + np.arange(len(self.length))


def _over(a: np.ndarray) -> np.ndarray:
    return a / a.sum(axis=-1, keepdims=True)


def _products(model: Model, p: Packed, e: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For the chunks in ``rows`` (ascending): emissions and moves from the first step to the last, up to a factor."""
    k = len(model.start)
    out = e[rows][:, :, None] * np.eye(k)
    for t in range(1, len(p.active)):
        n = int(np.searchsorted(rows, p.active[t]))
        if not n:
            break
        m = (out[:n].reshape(-1, k) @ model.move).reshape(n, k, k)
        np.multiply(m, e[p.offset[t] + rows[:n]][:, None, :], out=out[:n])
        if t % RESCALE == 0:
            out[:n] /= (out[:n].reshape(n, k * k) @ np.ones(k * k))[:, None, None]
    return out


def _messages(model: Model, p: Packed, e: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk: the state's distribution before its first emission, and the backward vector after its last step."""
    k = len(model.start)
    before, after = np.empty((len(p.length), k)), np.ones((len(p.length), k))
    before[p.row[p.first]] = model.start
    long = np.flatnonzero(p.per > 1)
    if not len(long):
        return before, after
    rows = np.sort(p.row[np.concatenate([p.first[s] + np.arange(p.per[s]) for s in long])])
    product = _products(model, p, e, rows)
    at = np.empty(len(p.length), np.int64)
    at[rows] = np.arange(len(rows))
    for r in range(int(p.per.max()) - 1):
        own = long[p.per[long] > r + 1]
        here, there = p.row[p.first[own] + r], p.row[p.first[own] + r + 1]
        before[there] = _over((before[here][:, None, :] @ product[at[here]])[:, 0]) @ model.move
    if backward:
        for r in range(int(p.per.max()) - 1, 0, -1):
            own = long[p.per[long] > r]
            here, there = p.row[p.first[own] + r - 1], p.row[p.first[own] + r]
            after[here] = _over((product[at[there]] @ after[there][:, :, None])[:, :, 0] @ model.move.T)
    return before, after


def _forward(model: Model, p: Packed, e: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward vectors and the scale of every step, which is the step's probability after all before it."""
    alpha, scale = np.empty_like(e), np.empty(len(e))
    prior, one = before, np.ones(len(model.start))
    for t, n in enumerate(p.active):
        at = p.step(t)
        a = np.multiply(prior[:n], e[at], out=alpha[at])
        a /= np.dot(a, one, out=scale[at])[:, None]
        prior = a @ model.move
    return alpha, scale


def log_probabilities(model: Model, classes: np.ndarray, sizes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """log10 of the probability of each sequence of classes."""
    p = Packed(classes, sizes, chunk)
    e = model.emit[p.classes]
    _, scale = _forward(model, p, e, _messages(model, p, e, backward=False)[0])
    owner = np.concatenate([p.seq[:n] for n in p.active]) if len(p.active) else np.zeros(0, np.int64)
    return np.bincount(owner, np.log10(scale), minlength=len(sizes))


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def zero(cls, model: Model) -> Counts:
        return cls(np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit))

    def add(self, model: Model, classes: np.ndarray, sizes: np.ndarray, chunk: int = CHUNK) -> None:
        """Expected counts of the sequences under the model."""
        p = Packed(classes, sizes, chunk)
        if not len(p.classes):
            return
        e = model.emit[p.classes]
        before, after = _messages(model, p, e, backward=True)
        alpha, scale = _forward(model, p, e, before)
        after /= (alpha[p.last()] * after).sum(axis=1, keepdims=True)
        # With the forward scales, forward times backward vector is the posterior of the state.
        e /= scale[:, None]
        seen = np.empty_like(e)  # scaled emission times backward vector
        back = np.ascontiguousarray(model.move.T)
        later = 0
        for t in range(len(p.active) - 1, -1, -1):
            beta = after[: p.active[t]].copy()
            if later:
                np.dot(v, back, out=beta[:later])
            v = np.multiply(e[p.step(t)], beta, out=seen[p.step(t)])
            later = len(v)
        # Neighbouring steps inside chunks, then across cuts.
        pairs = np.zeros_like(self.move)
        for t in range(len(p.active) - 1):
            pairs += alpha[p.offset[t] : p.offset[t] + p.active[t + 1]].T @ seen[p.step(t + 1)]
        inner = np.ones(len(p.row), bool)
        inner[p.first] = False
        cut = np.flatnonzero(inner)
        pairs += alpha[p.last()[p.row[cut - 1]]].T @ seen[p.row[cut]]
        self.move += pairs * model.move
        share = alpha * seen / e
        self.start += share[p.row[p.first]].sum(axis=0)
        for k in range(len(model.start)):
            self.emit[:, k] += np.bincount(p.classes, share[:, k], minlength=len(self.emit))


def maximised(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray, pinch: float = 1.0) -> Model:
    """The model of expected counts; so many tokens of ``prior`` keep every class possible in every state."""
    emit = emit + pinch * prior[:, None]
    return Model(_over(start + 0.1), _over(move + 0.1), emit / emit.sum(axis=0))


def _one(column: pa.Array) -> pa.Array:
    """A list array of one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _squeezed(numbers: np.ndarray) -> pa.Array:
    """A binary of small numbers, coded by how often each byte stands: frequent words take few bits."""
    return pa.array([pa.compress(numbers.tobytes(), codec="zstd", asbytes=True)], pa.binary())


def _loose(column: pa.Array, row: int, kind, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(column[row].as_buffer(), size * np.dtype(kind).itemsize, codec="zstd"), kind)


def _hash(words: pa.Array) -> np.ndarray:
    """32 bits for each word."""
    return (textbytes.hashes_of(words) >> np.uint64(32)).astype(np.int64)


def _blocks(docs: DataFrame, row_id: str, text: str, teaches: Column) -> DataFrame:
    """One row for each block of documents: ids, folds, sizes, numbered tokens, distinct words by hash and their training counts."""
    frame = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"), F.coalesce(teaches, F.lit(True)).alias("teaches"))
    id_kind = frame.schema["id"].dataType.simpleString()

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in textbytes.pieces(batch.column(1), BLOCK):
                part = batch.slice(a, b - a)
                found = textbytes.words(part.column(1), textbytes.NON_BLANK)
                code, distinct = found.distinct()
                distinct = pa.concat_arrays([distinct.cast(pa.binary()), pa.array([END], pa.binary())])
                order = np.argsort(_hash(distinct), kind="stable")
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order))
                sizes = found.counts + 1
                tokens = np.full(int(sizes.sum()), place[-1], np.uint32)
                word = np.ones(len(tokens), bool)
                word[np.cumsum(sizes) - 1] = False
                tokens[word] = place[code]
                learnt = np.repeat(part.column(2).to_numpy(zero_copy_only=False), sizes)
                taught = np.bincount(tokens[learnt], minlength=len(distinct))
                words = distinct.take(pa.array(order))
                columns = [pa.array([number], pa.int64()), _one(part.column(0)), _one(part.column(2)), _one(pa.array(sizes, pa.int64()))]
                columns += [_squeezed(tokens), _squeezed(_classes(words).astype(np.uint16)), _one(words), _one(pa.array(taught, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "teaches", "sizes", "tokens", "kinds", "words", "taught"])
                number += 1

    return frame.mapInArrow(run, f"block long, ids array<{id_kind}>, teaches array<boolean>, sizes array<long>, tokens binary, kinds binary, words array<binary>, taught array<int>")


def _classes(words: pa.Array) -> np.ndarray:
    # The bits of the hash that don't decide the slice.
    kind = (textbytes.hashes_of(words) % np.uint64(CLASSES - 1)).astype(np.int64) + 1
    kind[pc.binary_length(words).to_numpy() == 0] = 0
    return kind


def _counted(blocks: DataFrame) -> DataFrame:
    """``(block, part, c, classes, sums, distinct)``: training counts of the block's words in one slice of the hash.

    The first row of a slice also has, for the classes met there, the sum of all its words' counts and their number.
    """
    listed = blocks.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = -(-listed // SLICE)

    def cut(batches):
        for batch in batches:
            for row in range(len(batch)):
                words, taught = batch.column("words")[row].values, batch.column("taught")[row].values
                edges = np.searchsorted(_hash(words) * parts >> 32, np.arange(parts + 1)).astype(np.int32)
                blocks = pa.array(np.repeat(batch.column("block")[row].as_py(), parts))
                lists = [pa.ListArray.from_arrays(pa.array(edges), column) for column in (words, taught)]
                yield pa.RecordBatch.from_arrays([blocks, pa.array(np.arange(parts), pa.int32()), *lists], names=["block", "part", "words", "taught"])

    def count(table: pa.Table) -> pa.Table:
        lists = table.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        words = coded.dictionary
        c = np.bincount(code, table.column("taught").combine_chunks().flatten().to_numpy(), len(words)).astype(np.int64)
        kind = _classes(words)
        sums, distinct = np.bincount(kind, c, CLASSES).astype(np.int64), np.bincount(kind[c > 0], minlength=CLASSES)
        met = np.flatnonzero(distinct)
        sizes = lists.value_lengths().to_numpy()
        counts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(c[code], pa.int64()))
        first = lambda column: pa.array([column.tolist()] + [None] * (len(sizes) - 1), pa.list_(pa.int64()))
        return pa.table([table.column("block"), table.column("part"), counts, first(met), first(sums[met]), first(distinct[met])], names=["block", "part", "c", "classes", "sums", "distinct"])

    slices = blocks.select("block", "words", "taught").mapInArrow(cut, "block long, part int, words array<binary>, taught array<int>")
    return slices.groupBy("part").applyInArrow(count, "block long, part int, c array<long>, classes array<long>, sums array<long>, distinct array<long>")


def _sequences(blocks: DataFrame, counted: DataFrame, weight: np.ndarray, total: int) -> DataFrame:
    """Blocks with each document's known tokens, base score and score inside the classes, and all tokens' classes."""
    held = blocks.sparkSession.sparkContext.broadcast(np.log10(weight))
    id_kind = blocks.schema["ids"].dataType.simpleString()
    known = counted.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "c"))), lambda x: x["c"])).alias("c"))
    both = blocks.select("block", "ids", "teaches", "sizes", "tokens", "kinds").join(known, "block")

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                sizes = np.asarray(batch.column("sizes")[row].values)
                c = np.asarray(batch.column("c")[row].values)
                tokens = _loose(batch.column("tokens"), row, np.uint32, int(sizes.sum()))
                kind = _loose(batch.column("kinds"), row, np.uint16, len(c)).astype(np.int64)
                first = np.cumsum(sizes) - sizes
                base = np.log10((c + 1) / total)
                inside = np.where(kind > 0, np.log10(c + 1.0) - held.value[kind], 0.0)
                sums = [np.add.reduceat(v[tokens], first) for v in ((c > 0).astype(np.int64), base, inside)]
                columns = [batch.column(name).slice(row, 1) for name in ("ids", "teaches", "sizes")]
                columns += [_one(pa.array(v)) for v in sums]
                columns.append(_squeezed(kind.astype(np.uint16)[tokens]))
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "teaches", "sizes", "known", "base", "inside", "classes"])

    return both.mapInArrow(run, f"ids {id_kind}, teaches array<boolean>, sizes array<long>, known array<long>, base array<double>, inside array<double>, classes binary")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row in range(len(batch)):
        sizes = np.asarray(batch.column("sizes")[row].values)
        yield row, _loose(batch.column("classes"), row, np.uint16, int(sizes.sum())).astype(np.int64), sizes


def _round(sequences: DataFrame, model: Model, prior: np.ndarray, pinch: float) -> Model:
    """One round of Baum-Welch over all training texts."""
    held = sequences.sparkSession.sparkContext.broadcast(model)
    k = len(model.start)
    names = [f"s{i}" for i in range(k)]

    def run(batches):
        model, total = held.value, None
        for batch in batches:
            for row, classes, sizes in _texts(batch):
                teaches = batch.column("teaches")[row].values.to_numpy(zero_copy_only=False)
                if teaches.any():
                    total = total or Counts.zero(model)
                    total.add(model, classes[np.repeat(teaches, sizes)], sizes[teaches])
        if total is not None:
            used = np.flatnonzero(total.emit.any(axis=1))
            values = np.concatenate([total.start[None], total.move, total.emit[used]])
            # Negative keys: the start, then the moves out of each state.
            keys = np.concatenate([-1 - np.arange(1 + k), used])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(values[:, i], pa.float32()) for i in range(k))], names=["key", *names])

    rows = sequences.select("teaches", "sizes", "classes").mapInArrow(run, "key int, " + ", ".join(f"{n} float" for n in names))
    # At most one row for each class and state; sums of floats are doubles.
    summed = rows.groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    keys = summed.column("key").to_numpy()
    values = np.stack([summed.column(n).to_numpy() for n in names], axis=1) if len(keys) else np.zeros((0, k))
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    start += values[keys == -1].sum(axis=0)
    inner = keys < -1
    move[-2 - keys[inner]] = values[inner]
    emit[keys[keys >= 0]] = values[keys >= 0]
    return maximised(start, move, emit, prior, pinch)


def score(docs: DataFrame, teaches: Column, row_id: str = "doc_id", text: str = "text", states: int = 8, rounds: int = 5) -> DataFrame:
    """``(row_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Rows for which ``teaches`` is true (or null) train the model; all are scored. Null and empty texts are the end
    alone. ``base_score`` is the log10 probability under single words with one added to every count, ``score`` that of
    the hidden Markov model. Rows that repeat count and are scored each on their own; a null id is an id. Without
    training rows every class is equally likely. Other columns are ignored.
    """
    blocks = materialise(_blocks(docs, row_id, text, teaches), "blocks", BLOCK)
    counted = materialise(_counted(blocks), "counts", BLOCK)
    # At most one row for each class.
    lists = counted.where("classes is not null").select(F.explode(F.arrays_zip("classes", "sums", "distinct")).alias("x"))
    sums = lists.groupBy("x.classes").agg(F.sum("x.sums").alias("c"), F.sum("x.distinct").alias("distinct")).collect()
    # Classes that no training word met share as much as there are distinct words, each of which was new once.
    distinct = sum(r["distinct"] for r in sums)
    weight, prior = np.ones(CLASSES), np.full(CLASSES, (distinct + 1) / CLASSES)
    for row in sums:
        weight[row["classes"]] += row["c"] + row["distinct"]
        prior[row["classes"]] += row["c"]
    taught = sum(r["c"] for r in sums)
    total = taught + distinct + 1
    sequences = materialise(_sequences(blocks, counted, weight, total), "sequences", BLOCK)
    prior /= prior.sum()
    model = initial(states, prior)
    for _ in range(rounds if taught else 0):
        model = _round(sequences, model, prior, (distinct + 1) / states)
    return _scored(sequences, model, row_id, taught)


def _scored(sequences: DataFrame, model: Model, row_id: str, taught: int) -> DataFrame:
    held = sequences.sparkSession.sparkContext.broadcast(model)
    id_kind = sequences.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for row, classes, sizes in _texts(batch):
                value = log_probabilities(held.value, classes, sizes) + np.asarray(batch.column("inside")[row].values)
                lists = [batch.column(name)[row].values for name in ("ids", "teaches", "sizes", "known", "base")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(value)], names=["id", "teaches", "n_tokens", "n_known", "base_score", "score"])

    out = sequences.mapInArrow(run, f"id {id_kind}, teaches boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(row_id), (~F.col("teaches")).alias("held_out"), "n_tokens", "n_known", F.lit(taught).cast("long").alias("train_tokens"), "base_score", "score")
