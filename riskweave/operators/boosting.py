"""Boosted trees of several classes under one softmax loss.

A round grows one tree a class.  All trees of a round grow together, level by level, and a level is one aggregate:
tasks add up gradients, curvatures and rows by (feature, open node, bin), the sums are shuffled by feature, a row for
each feature and task, and every task of the second half gives its best split of each node.  The driver holds the trees, one row for a node and
task, and the cuts; their sizes come from the parameters and the number of classes, not from the rows.  Nor do the sums
of a task, so the first half has as many tasks as there are cores, however many rows, and what is shuffled stays the same.

Gradients are whole multiples of 2**-24 and are added as whole numbers, so the order of tasks or a repeated task changes
no tree.  Rows carry their margins up to the last written round; the trees since then are walked anew, and every
``WRITE_ROUNDS`` rounds the margins are written.

A level is a job, which takes longer to start than to run on a table of some ten thousand rows.  The trees of a round
ask nothing of each other, so a table of at most ``HELD`` bytes is broadcast once, binned, and a task grows all levels of
a class's tree: a round is one job, and nothing is shuffled.  Both ways give the same trees, bit by bit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import materialise, release

MAX_BINS = 32
WRITE_ROUNDS = 10
UNIT = float(1 << 24)
# Cells of node, feature and bin that a task holds, and nodes; a level with more takes several aggregates.
CELLS = 2_000_000
NODES = 2048
# Rows below which another task costs more than it saves.
TASK_ROWS = 512
# Cells of row and tree worked on at a time, and of node, feature and bin.
WALKS = 1_000_000
SCORES = 100_000
# Rows worked on at a time.
BLOCK = 16_384
# Bytes of a table that a worker, and the driver for a moment, hold.  A larger one grows its trees level by level.
HELD = 256 << 20
# A split's gain is more than this.
LEAST_GAIN = 1e-9


@dataclass
class Round:
    """Trees of one round: nodes of all classes end to end, the roots first; the right child follows the left one."""

    feature: list = field(default_factory=list)  # -1 at a leaf
    cut: list = field(default_factory=list)  # the last bin that goes left
    threshold: list = field(default_factory=list)  # the largest value that goes left
    left: list = field(default_factory=list)
    value: list = field(default_factory=list)  # part of the margin, learning rate included
    rows: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, value: float, rows: int) -> None:
        for column, cell in zip(self.columns(), (-1, 0, 0.0, -1, value, rows, 0.0)):
            column.append(cell)

    def columns(self) -> tuple:
        return self.feature, self.cut, self.threshold, self.left, self.value, self.rows, self.gain


class Walker:
    """Several rounds as arrays, to send rows down all their trees."""

    def __init__(self, rounds: list[Round], n_classes: int, on_bins: bool):
        starts = np.cumsum([0, *[len(r.feature) for r in rounds]])
        self.n_classes = n_classes
        self.roots = (starts[:-1, None] + np.arange(n_classes)).ravel().astype(np.int64)
        feature = np.array([f for r in rounds for f in r.feature], np.int64)
        cut = np.array([c for r in rounds for c in (r.cut if on_bins else r.threshold)], np.float64)
        left = np.array([c + s if c >= 0 else -1 for r, s in zip(rounds, starts) for c in r.left], np.int64)
        self.value = np.array([v for r in rounds for v in r.value], np.float64)
        self.depth, at = 0, self.roots
        while len(at := at[feature[at] >= 0]):
            self.depth, at = self.depth + 1, np.concatenate([left[at], left[at] + 1])
        # Nothing is greater than a leaf's cut, so a row stays there.
        inner = feature >= 0
        self.feature = np.where(inner, feature, 0)
        self.left = np.where(inner, left, np.arange(len(left)))
        self.cut = np.where(inner, cut, 255).astype(np.uint8) if on_bins else np.where(inner, cut, np.inf)

    def ends(self, x: np.ndarray) -> np.ndarray:
        """Rows x trees: where each row ends; what is not a number goes right."""
        cells = (x if x.dtype == np.uint8 else np.where(np.isnan(x), np.inf, x)).ravel()  # cuts are finite
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None] * x.shape[1]
        for _ in range(self.depth):
            at = self.left.take(at) + (cells.take(self.feature.take(at) + row) > self.cut.take(at))
        return at

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Rows x classes: what the rounds add."""
        out = np.zeros((len(x), self.n_classes))
        if not len(self.roots):
            return out
        step = max(1, WALKS // len(self.roots))
        for a in range(0, len(x), step):
            found = self.value[self.ends(x[a : a + step])]
            out[a : a + step] = found.reshape(len(found), -1, self.n_classes).sum(axis=1)
        return out


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()))


def _bytes(values: np.ndarray) -> pa.Array:
    """One binary cell for each row of an array."""
    values = np.ascontiguousarray(values)
    n, width = len(values), values.nbytes // max(1, len(values))
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _from_bytes(column: pa.Array, dtype, width: int) -> np.ndarray:
    if pa.types.is_binary(column.type):  # cells lie end to end
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(-1, width)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _blocks(batches, width: int):
    """Bins, labels and margins of ``BLOCK`` rows or some more at a time."""
    held: list = []
    for batch in batches:
        if batch.num_rows:
            held.append((_from_bytes(batch["bins"], np.uint8, width), batch["y"].to_numpy(), _matrix(batch["margin"])))
        if sum(len(y) for _, y, _ in held) >= BLOCK:
            yield tuple(map(np.concatenate, zip(*held)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def gradients(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by row and class, in units of 2**-24."""
    p = _softmax(margins)
    return gradients_of(p, y[:, None] == np.arange(p.shape[1]))


def gradients_of(p: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of shares of classes, beside whether the class is the row's."""
    return np.rint((p - own) * UNIT), np.maximum(np.rint(p * (1 - p) * UNIT), 1.0)


def total_loss(p: np.ndarray, y: np.ndarray) -> int:
    """Sum of the rows' log-losses in units of 2**-24."""
    return int(np.rint(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)) * UNIT).sum())


def best_splits(cells: np.ndarray, n_cuts, l2: float, min_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, gain)`` of a feature's best cut in each node (nodes x bins x gradient, curvature); gain 0: there is none."""
    left = np.cumsum(cells, axis=1)
    whole = left[:, -1:, :]
    right = whole - left

    def score(part):
        return (part[..., 0] / UNIT) ** 2 / (part[..., 1] / UNIT + l2)

    gain = score(left) + score(right) - score(whole)
    least = max(min_weight * UNIT, 1.0)
    allowed = (left[..., 1] >= least) & (right[..., 1] >= least) & (np.arange(cells.shape[1]) < n_cuts)
    gain = np.where(allowed, gain, 0.0)
    at = gain.argmax(axis=1)
    return at, gain[np.arange(len(at)), at]


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest takes, after the number of bytes: all lowest bytes, all next ones and so on."""
    values = np.asarray(values, np.int64)
    folded = (values << 1) ^ (values >> 63)  # the sign to the lowest bit
    width = max(1, (int(folded.max()).bit_length() + 7) // 8)
    return bytes([width]) + folded.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, n: int) -> list[np.ndarray]:
    """The arrays of ``n`` numbers that stand end to end in ``data``."""
    out, at = [], 0
    while at < len(data):
        width = data[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, width * n, at + 1).reshape(width, n).T
        folded = wide.view("<i8").ravel()
        out.append((folded >> 1) ^ -(folded & 1))
        at += 1 + width * n
    return out


SUMS = "feature int, met int, cells binary"
SPLITS = "slot int, feature int, bin int, gain double, left binary, whole binary"


def _add_up(held, first_round: bool, slots_from: int, n_slots: int, width: int, bins: int):
    """Map half of a level: for each feature the sums that are not empty, by open node and bin; feature -1 holds the loss."""

    def run(batches):
        done, growing, slot_of = held.value
        total = np.zeros((width, 3, n_slots * bins))
        loss = n = 0
        for x, y, margins in _blocks(batches, width):
            margins = margins + done.margins(x)
            loss += total_loss(_softmax(margins), y)
            n += len(y)
            g, h = gradients(margins, y)
            slot = slot_of[growing.ends(x)] - slots_from
            row, k = np.nonzero((slot >= 0) & (slot < n_slots))
            place, g, h = slot[row, k] * bins, g[row, k], h[row, k]
            for f, column in enumerate(np.ascontiguousarray(x.T)):
                at = place + column.take(row)
                total[f, 0] += np.bincount(at, g, n_slots * bins)
                total[f, 1] += np.bincount(at, h, n_slots * bins)
                total[f, 2] += np.bincount(at, None, n_slots * bins)
        if not n:
            return
        for f in range(width):
            met = np.nonzero(total[f, 2])[0]
            if len(met):
                yield _sums(f, met, total[f][:, met].T)
        if first_round:
            yield _sums(-1, np.zeros(1, np.int64), np.array([[loss, n, 0]]))

    return run


def _sums(f: int, place: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    """Sums of one feature: the steps from place to place, then gradients, curvatures and rows."""
    packed = b"".join(_planes(column) for column in (np.diff(place, prepend=0), *np.rint(cells).T))
    return pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([len(place)], pa.int32()), pa.array([packed], pa.binary())], ["feature", "met", "cells"])


def _choose(n_cuts: np.ndarray, n_slots: int, slots_from: int, bins: int, l2: float, min_weight: float):
    """Reduce half: this task's best split of each node, the smaller feature and cut among equal ones."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for f, met, cells in zip(*(batch[c].to_pylist() for c in ("feature", "met", "cells"))):
                if f not in total:
                    total[f] = np.zeros((n_slots * bins, 3), np.int64)
                steps, *sums = _from_planes(cells, met)
                total[f][np.cumsum(steps)] += np.stack(sums, axis=1)
        if -1 in total:
            yield _splits([-1], [-1], [0], [0.0], total[-1][:1], total.pop(-1)[:1])
        if not total:
            return
        gain, feature, cut = np.full(n_slots, -1.0), np.zeros(n_slots, np.int64), np.zeros(n_slots, np.int64)
        left, whole = np.zeros((n_slots, 3), np.int64), np.zeros((n_slots, 3), np.int64)
        for f in sorted(total):
            cells = total[f].reshape(n_slots, bins, 3)
            at, found = best_splits(cells, n_cuts[f], l2, min_weight)
            better = np.nonzero(found > gain)[0]
            gain[better], feature[better], cut[better] = found[better], f, at[better]
            left[better] = np.cumsum(cells[better], axis=1)[np.arange(len(better)), at[better]]
            whole[better] = cells[better].sum(axis=1)
        yield _splits(np.arange(n_slots) + slots_from, feature, cut, gain, left, whole)

    return run


def _splits(slot, feature, cut, gain, left, whole) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(slot, pa.int32()), pa.array(feature, pa.int32()), pa.array(cut, pa.int32()), pa.array(gain, pa.float64()), _bytes(left), _bytes(whole)],
        ["slot", "feature", "bin", "gain", "left", "whole"])


class Table:
    """All rows of a table: bins by feature, labels and margins after the rounds met so far.

    A worker keeps it from round to round, so it walks the trees that are new to it only.
    """

    def __init__(self, bins: np.ndarray, y: np.ndarray, prior: np.ndarray):
        self.by_feature, self.y, self.prior = np.ascontiguousarray(bins.T), y, prior
        self.met, self.written, self.recent = -1, None, None

    @staticmethod
    def size(n: int, width: int, n_classes: int) -> int:
        """Bytes: four copies of the bins, which the driver has on their way, two margins of each row and class, a dozen cells of each row while a tree grows."""
        return n * (4 * width + 16 * n_classes + 96)

    def forward(self, rounds: list) -> None:
        """Margins after these rounds, added in the order in which they are written level by level."""
        met, self.met = self.met, -1
        if not 0 <= met <= len(rounds):
            met, self.written = 0, np.tile(self.prior, (len(self.y), 1))
            self.recent = np.zeros_like(self.written)
        for t in range(met, len(rounds)):
            if t and t % WRITE_ROUNDS == 0:
                self.written += self.recent
                self.recent[:] = 0.0
            for a in range(0, len(self.y), BLOCK):
                self.recent[a : a + BLOCK] += rounds[t].value.margins(np.ascontiguousarray(self.by_feature[:, a : a + BLOCK].T))
        self.met = len(rounds)

    def slopes(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Gradients and curvatures of class ``k``, and the sum of all rows' losses."""
        g, h, loss = np.empty(len(self.y)), np.empty(len(self.y)), 0
        for a in range(0, len(self.y), BLOCK):
            part = slice(a, a + BLOCK)
            p, y = _softmax(self.written[part] + self.recent[part]), self.y[part]
            g[part], h[part] = gradients_of(p[:, k], y == k)
            loss += total_loss(p, y)
        return g, h, loss

    def tree(self, g: np.ndarray, h: np.ndarray, n_cuts: np.ndarray, bins: int, depth: int, l2: float, min_weight: float) -> list:
        """A class's next tree, a list of ``(feature, bin, gain, left, whole)`` of its open nodes for each level."""
        rows, levels = [np.arange(len(g))], []
        cells = self.sums(rows, g, h, bins)
        for level in range(depth):
            splits, deeper, fewer, parents = self.splits(rows, cells, n_cuts, l2, min_weight), [], [], []
            levels.append(splits)
            for node, (f, cut, gain, left, _) in enumerate(splits):
                if gain > LEAST_GAIN:
                    goes = self.by_feature[f].take(rows[node]) <= cut
                    deeper += [rows[node][goes], rows[node][~goes]]
                    left[2] = len(deeper[-2])
                    fewer.append(int(len(deeper[-1]) < len(deeper[-2])))
                    parents.append(node)
            if not deeper or level + 1 == depth:
                break
            # The rows of the smaller side are added up, the other side is what is left of the whole.
            part = self.sums([deeper[2 * i + side] for i, side in enumerate(fewer)], g, h, bins)
            both, i, side = np.empty((len(parents), 2, *cells.shape[1:])), np.arange(len(parents)), np.array(fewer)
            both[i, side], both[i, 1 - side] = part, cells[parents] - part
            rows, cells = deeper, both.reshape(-1, *cells.shape[1:])
        return levels

    def sums(self, rows: list[np.ndarray], g: np.ndarray, h: np.ndarray, bins: int) -> np.ndarray:
        """Nodes x features x bins x gradient, curvature, of these rows of each node; whole numbers all."""
        row = np.concatenate(rows)
        place = np.repeat(np.arange(len(rows)) * bins, [len(r) for r in rows])
        g, h = g.take(row), h.take(row)
        total = np.empty((len(rows), len(self.by_feature), bins, 2))
        for f, column in enumerate(self.by_feature):
            at = place + column.take(row)
            total[:, f, :, 0] = np.bincount(at, g, len(rows) * bins).reshape(-1, bins)
            total[:, f, :, 1] = np.bincount(at, h, len(rows) * bins).reshape(-1, bins)
        return total

    def splits(self, rows: list[np.ndarray], cells: np.ndarray, n_cuts: np.ndarray, l2: float, min_weight: float) -> list:
        """Best split of each node, the smaller feature and cut among equal ones; rows of its left side are not counted yet."""
        nodes, width, bins, _ = cells.shape
        out = []
        step = max(1, SCORES // (width * bins))
        for a in range(0, nodes, step):
            part = cells[a : a + step]
            at, gain = best_splits(part.reshape(-1, bins, 2), np.tile(n_cuts, len(part))[:, None], l2, min_weight)
            at, gain = at.reshape(-1, width), gain.reshape(-1, width)
            feature = gain.argmax(axis=1)
            for i, f in enumerate(feature.tolist()):
                cut, own = int(at[i, f]), part[i, f]
                left, whole = own[: cut + 1].sum(axis=0), own.sum(axis=0)
                out.append((f, cut, float(gain[i, f]), [int(left[0]), int(left[1]), 0], [int(whole[0]), int(whole[1]), len(rows[a + i])]))
        return out


def _class_trees(held, rounds: list, n_cuts: np.ndarray, bins: int, depth: int, l2: float, min_weight: float):
    """One round: the sum of losses before it and the tree of each class of a task."""

    def run(classes):
        table = held.value
        table.forward(rounds)
        for k in classes:
            g, h, loss = table.slopes(k)
            yield k, loss, table.tree(g, h, n_cuts, bins, depth, l2, min_weight)
        release()

    return run


def cut_points(rows: DataFrame, width: int, bins: int = MAX_BINS) -> list[np.ndarray]:
    """Increasing cuts of each feature between its ``bins`` quantiles; without infinite ones, so no path asks for them."""
    cells = rows.select(F.posexplode("x").alias("feature", "v")).where(~F.isnan("v"))
    found = cells.groupBy("feature").agg(F.percentile_approx("v", [i / bins for i in range(1, bins)], 10_000).alias("cuts"))
    cuts = [np.zeros(0)] * width
    for r in found.collect():  # one row a feature
        found_cuts = np.unique(np.array(r["cuts"], np.float64))
        cuts[r["feature"]] = found_cuts[np.isfinite(found_cuts)]
    return cuts


def _binned(cuts: list[np.ndarray], prior: np.ndarray):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"])
            out = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [_bytes(out), batch["y"], _lists(np.tile(prior, (len(x), 1)))], ["bins", "y", "margin"])

    return run


def _moved(held, width: int):
    """Margins with the rounds since the last written ones added."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            margins = _matrix(batch["margin"]) + held.value.margins(_from_bytes(batch["bins"], np.uint8, width))
            yield pa.RecordBatch.from_arrays([batch["bins"], batch["y"], _lists(margins)], ["bins", "y", "margin"])

    return run


STATE = "bins binary, y int, margin array<double>"


class SoftmaxBoosting:
    """``n_estimators`` rounds of a tree for each class on ``features`` (vector) and ``label`` (0 to n_classes - 1).

    Splits take the greatest fall of the loss's second-order form, leaves are Newton steps, first margins the logs of
    the classes' shares.  Each side of a split has a sum of curvatures of ``min_weight`` or more.  ``losses`` is the mean log-loss before each round.  A row without features or label is not
    learnt from; a value that is not a number goes right at every split.
    """

    def __init__(self, n_classes: int, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 6,
                 l2: float = 1.0, min_weight: float = 1.0, max_bins: int = MAX_BINS):
        if not 2 <= max_bins <= 256:
            raise ValueError("max_bins lies between 2 and 256")
        self.n_classes, self.n_estimators, self.learning_rate, self.max_depth = n_classes, n_estimators, learning_rate, max_depth
        self.l2, self.min_weight, self.max_bins = l2, min_weight, max_bins
        self.prior = np.zeros(n_classes)
        self.rounds: list[Round] = []
        self.losses: list[float] = []
        self.width = 0

    # -- fitting -----------------------------------------------------------------------------

    def fit(self, rows: DataFrame) -> "SoftmaxBoosting":
        spark = rows.sparkSession
        rows = rows.where("features is not null and label is not null").select(
            vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
        rows = materialise(rows, "boosting-rows")
        counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # one row a class
        if not counts:
            raise ValueError("no rows to fit")
        share = np.array([counts.get(k, 0) for k in range(self.n_classes)], np.float64)
        self.prior = np.log(np.maximum(share, 0.5) / share.sum())
        self.width = len(rows.select("x").first()[0])
        cuts = cut_points(rows, self.width, self.max_bins)
        n = sum(counts.values())
        most_nodes = min(1 << (self.max_depth - 1), n) if self.max_depth > 0 else 1
        # A round of one level is one job either way.
        if self.max_depth > 1 and Table.size(n, self.width, self.n_classes) <= HELD and most_nodes * self.width * self.max_bins <= CELLS:
            return self._fit_held(spark, rows, cuts)
        tasks = max(1, min(spark.sparkContext.defaultParallelism, n // TASK_ROWS))
        state = materialise(rows.mapInArrow(_binned(cuts, self.prior), STATE).repartition(tasks), "boosting-state").coalesce(tasks)
        written = 0
        for t in range(self.n_estimators):
            if t - written == WRITE_ROUNDS:
                moved = spark.sparkContext.broadcast(Walker(self.rounds[written:], self.n_classes, True))
                state = materialise(state.mapInArrow(_moved(moved, self.width), STATE), "boosting-state").coalesce(tasks)
                written = t
            done = Walker(self.rounds[written:], self.n_classes, True)

            def splits(level, tree, open_nodes):
                found = self._level(spark, state, done, tree, open_nodes, cuts, level == 0, tasks == 1)
                return [(r["feature"], r["bin"], r["gain"], *(np.frombuffer(r[c], np.int64).tolist() for c in ("left", "whole")))
                        for r in map(found.get, range(len(open_nodes)))]

            self.rounds.append(self._grow(cuts, splits))
        return self

    def _fit_held(self, spark: SparkSession, rows: DataFrame, cuts: list[np.ndarray]) -> "SoftmaxBoosting":
        """A job a round, a task a class; for at most ``HELD`` bytes, which bound what the driver collects and sends too."""
        context = spark.sparkContext
        binned = rows.mapInArrow(_binned(cuts, self.prior), STATE).select("bins", "y").toArrow()
        y = binned["y"].to_numpy()
        bins = np.concatenate([_from_bytes(chunk, np.uint8, self.width) for chunk in binned["bins"].chunks])
        held = context.broadcast(Table(bins, y, self.prior))
        del binned, bins
        n_cuts = np.array([len(c) for c in cuts])
        classes = context.parallelize(range(self.n_classes), self.n_classes)
        walkers: list = []
        try:
            for _ in range(self.n_estimators):
                run = _class_trees(held, walkers, n_cuts, self.max_bins, self.max_depth, self.l2, self.min_weight)
                found = sorted(classes.mapPartitions(run).collect())  # a row a class, of a tree's nodes
                self.losses.append(float(found[0][1] / UNIT / len(y)))
                levels = [[split for _, _, tree in found for split in tree[level : level + 1]] for level in range(self.max_depth)]
                self.rounds.append(self._grow(cuts, lambda level, *_: sum(levels[level], [])))
                walkers.append(context.broadcast(Walker(self.rounds[-1:], self.n_classes, True)))
        finally:
            for sent in (held, *walkers):
                sent.destroy()
        return self

    def _grow(self, cuts: list[np.ndarray], splits) -> Round:
        """Trees of a round, level by level; ``splits`` gives the best split of each open node, the classes one after another."""
        tree = Round()
        for _ in range(self.n_classes):
            tree.add(0.0, 0)
        open_nodes = list(range(self.n_classes))
        for level in range(max(1, self.max_depth)):
            deeper = []
            for node, (feature, cut, gain, left, whole) in zip(open_nodes, splits(level, tree, open_nodes), strict=True):
                tree.value[node], tree.rows[node] = self._step(whole), whole[2]
                if gain <= LEAST_GAIN or not self.max_depth:
                    continue
                tree.feature[node], tree.cut[node], tree.gain[node] = feature, cut, gain
                tree.threshold[node], tree.left[node] = float(cuts[feature][cut]), len(tree.feature)
                for part in (left, [a - b for a, b in zip(whole, left)]):
                    deeper.append(len(tree.feature))
                    tree.add(self._step(part), part[2])
            open_nodes = deeper
            if not open_nodes:
                break
        return tree

    def _step(self, sums: list[int]) -> float:
        return float(-self.learning_rate * (sums[0] / UNIT) / (sums[1] / UNIT + self.l2))

    def _level(self, spark, state, done, tree, open_nodes, cuts, first, one_split) -> dict:
        """Best split of each open node, by its place in the list."""
        slot_of = np.full(len(tree.feature), -1, np.int64)
        slot_of[open_nodes] = np.arange(len(open_nodes))
        held = spark.sparkContext.broadcast((done, Walker([tree], self.n_classes, True), slot_of))
        n_cuts = np.array([len(c) for c in cuts])
        block = max(1, min(NODES, CELLS // (self.width * self.max_bins)))
        # The sums do not grow with the rows, so more tasks than cores would only have to be started.
        tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), self.width, spark.sparkContext.defaultParallelism)
        found: dict = {}
        for a in range(0, len(open_nodes), block):
            size = min(block, len(open_nodes) - a)
            sums = state.mapInArrow(_add_up(held, first and a == 0, a, size, self.width, self.max_bins), SUMS)
            if not one_split:  # the sums of one task are whole already
                sums = sums.repartition(tasks, "feature")
            best = sums.mapInArrow(_choose(n_cuts, size, a, self.max_bins, self.l2, self.min_weight), SPLITS)
            for r in best.collect():  # nodes x tasks at most
                if r["slot"] < 0:
                    loss, n = np.frombuffer(r["whole"], np.int64)[:2]
                    self.losses.append(float(loss / UNIT / n))
                elif r["slot"] not in found or (-r["gain"], r["feature"]) < (-found[r["slot"]]["gain"], found[r["slot"]]["feature"]):
                    found[r["slot"]] = r
        held.unpersist()
        return found

    # -- using -------------------------------------------------------------------------------

    def margins(self, spark: SparkSession, features: str):
        """The raw score of each class, an array column; null without features."""
        held = spark.sparkContext.broadcast((Walker(self.rounds, self.n_classes, False), self.prior))

        def run(column: pa.Array) -> pa.Array:
            walker, prior = held.value
            there = column.drop_null()
            out = prior + walker.margins(_matrix(there)) if len(there) else np.zeros((0, len(prior)))
            if len(there) == len(column):
                return _lists(out)
            rows = iter(out.tolist())
            return pa.array([next(rows) if v else None for v in column.is_valid().to_pylist()], pa.list_(pa.float64()))

        return F.arrow_udf(run, "array<double>").asNondeterministic()(F.when(F.col(features).isNotNull(), vector_to_array(features)))

    @property
    def importances(self) -> np.ndarray:
        """Shares of the gain by feature."""
        out = np.zeros(self.width)
        for r in self.rounds:
            inner = np.array(r.feature) >= 0
            np.add.at(out, np.array(r.feature)[inner], np.array(r.gain)[inner])
        return out / out.sum() if out.sum() else out

    # -- storage -----------------------------------------------------------------------------

    TREES = "round int, node int, feature int, cut int, threshold double, left int, value double, rows bigint, gain double"

    def save(self, spark: SparkSession, path: str) -> None:
        nodes = [(t, i, *cells) for t, r in enumerate(self.rounds) for i, cells in enumerate(zip(*r.columns()))]
        spark.createDataFrame(nodes, self.TREES).write.mode("overwrite").parquet(f"{path}/nodes")
        about = [(self.n_classes, self.n_estimators, self.learning_rate, self.max_depth, self.l2, self.min_weight, self.max_bins,
                  self.width, self.prior.tolist(), self.losses)]
        spark.createDataFrame(
            about, "n_classes int, n_estimators int, learning_rate double, max_depth int, l2 double, min_weight double, max_bins int, "
            "width int, prior array<double>, losses array<double>").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SoftmaxBoosting":
        about = spark.read.parquet(f"{path}/about").first().asDict()
        width, prior, losses = about.pop("width"), about.pop("prior"), about.pop("losses")
        out = cls(**about)
        out.width, out.prior, out.losses = width, np.array(prior), list(losses)
        for r in spark.read.parquet(f"{path}/nodes").orderBy("round", "node").toLocalIterator():
            if r["node"] == 0:
                out.rounds.append(Round())
            for column, cell in zip(out.rounds[-1].columns(), r[2:]):
                column.append(cell)
        return out
