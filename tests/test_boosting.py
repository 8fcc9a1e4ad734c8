"""Boosting under a softmax loss beside a plain version of the same rules."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskweave.operators import attribution, boosting, models
from riskweave.session import tune

UNIT = 2.0**24


def make(n=240, width=5, seed=3, n_classes=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).round(2)
    x[:, 3] = rng.integers(0, 3, n)  # ties
    x[::17, 1] = np.nan
    y = ((x[:, 0] > 0).astype(int) + (x[:, 3] > 1)).astype(int) % n_classes
    return x, y


def table(spark, x, y, parts=6):
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(len(x))]
    made = spark.createDataFrame(rows, "id int, x array<double>, label int").repartition(parts, "id")
    return made.select("id", array_to_vector("x").alias("features"), "label")


class Plain:
    """Each tree grown by itself, row by row, every split tried on a list of rows."""

    def __init__(self, x, y, k, rounds, rate, depth, l2, least):
        self.x, self.k, self.rate, self.depth, self.l2, self.least = x, k, rate, depth, l2, least
        self.cuts = []
        for f in range(x.shape[1]):
            v = np.sort(x[:, f][~np.isnan(x[:, f])])
            at = [int(np.ceil(len(v) * i / 32)) - 1 for i in range(1, 32)]
            self.cuts.append(np.unique(v[at]))
        self.prior = np.log(np.bincount(y, minlength=k) / len(y))
        self.trees, self.losses = [], []
        m = np.tile(self.prior, (len(y), 1))
        for _ in range(rounds):
            p = np.exp(m - m.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            self.losses.append(float(-np.log(p[np.arange(len(y)), y]).mean()))
            trees = []
            for c in range(k):
                g = np.rint((p[:, c] - (y == c)) * UNIT) / UNIT
                h = np.maximum(np.rint(p[:, c] * (1 - p[:, c]) * UNIT), 1) / UNIT
                trees.append(self.grow(g, h, np.arange(len(y)), 0))
            self.trees.append(trees)
            m = m + np.array([[self.value(t, row) for t in trees] for row in x])

    def grow(self, g, h, rows, level):
        def score(r):
            return g[r].sum() ** 2 / (h[r].sum() + self.l2)

        best = (1e-9, None)
        if level < self.depth:
            for f, cuts in enumerate(self.cuts):
                for cut in cuts:
                    goes = self.x[rows, f] <= cut
                    a, b = rows[goes], rows[~goes]
                    if min(h[a].sum(), h[b].sum()) >= self.least:
                        gain = score(a) + score(b) - score(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, cut, a, b))
        if best[1] is None:
            return -self.rate * g[rows].sum() / (h[rows].sum() + self.l2)
        f, cut, a, b = best[1]
        return f, cut, self.grow(g, h, a, level + 1), self.grow(g, h, b, level + 1)

    def value(self, tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def margins(self, x):
        return self.prior + np.array([[sum(self.value(t[c], row) for t in self.trees) for c in range(self.k)] for row in x])


@pytest.fixture(scope="module")
def data(spark):
    tune(spark)
    x, y = make()
    return x, y, table(spark, x, y).cache()


def margins_of(spark, model, rows):
    got = rows.select("id", model.margins(spark, "features").alias("m")).collect()
    return np.array([r.m for r in sorted(got, key=lambda r: r.id)])


def test_equal_to_the_plain_version(spark, data, monkeypatch):
    x, y, rows = data
    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 2)  # margins are written between rounds
    model = boosting.SoftmaxBoosting(3, 5, 0.3, 3).fit(rows)
    plain = Plain(x, y, 3, 5, 0.3, 3, 1.0, 1.0)
    assert np.allclose(margins_of(spark, model, rows), plain.margins(x), atol=1e-9)
    assert np.allclose(model.losses, plain.losses, atol=1e-6)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))


def test_blocks_and_splits_change_no_tree(spark, data, monkeypatch):
    x, y, rows = data
    whole = boosting.SoftmaxBoosting(3, 3, 0.3, 4).fit(rows)
    monkeypatch.setattr(boosting, "NODES", 2)
    monkeypatch.setattr(boosting, "materialise", lambda df, name: df.repartition(5).cache())  # several splits, so a shuffle
    parts = boosting.SoftmaxBoosting(3, 3, 0.3, 4).fit(rows)
    assert [r.columns() for r in whole.rounds] == [r.columns() for r in parts.rounds] and whole.losses == parts.losses


def test_copies_of_rows_keep_the_splits(spark, data):
    """Three copies of every row are one row of three times the weight: same cuts, same first features."""
    _, _, rows = data
    model = boosting.SoftmaxBoosting(3, 1, 0.3, 2, l2=0.0, min_weight=0.0).fit(rows)
    copies = boosting.SoftmaxBoosting(3, 1, 0.3, 2, l2=0.0, min_weight=0.0).fit(rows.withColumn("c", F.explode(F.array(*map(F.lit, range(3))))))
    assert np.allclose(margins_of(spark, model, rows), margins_of(spark, copies, rows), atol=1e-6)


def test_nulls_are_not_learnt_from_and_get_no_margins(spark, data):
    _, _, rows = data
    odd = rows.withColumn("features", F.when(F.col("id") != 1, F.col("features"))).withColumn("label", F.when(F.col("id") != 2, F.col("label")))
    model = boosting.SoftmaxBoosting(3, 2, 0.3, 2).fit(odd)
    without = boosting.SoftmaxBoosting(3, 2, 0.3, 2).fit(rows.where("id not in (1, 2)"))
    assert [r.columns() for r in model.rounds] == [r.columns() for r in without.rounds]
    got = {r.id: r.m for r in odd.select("id", model.margins(spark, "features").alias("m")).collect()}
    assert got[1] is None and len(got[2]) == 3
    with pytest.raises(ValueError):
        boosting.SoftmaxBoosting(3).fit(rows.where("id < 0"))


def test_equal_features_one_value_and_one_split_a_tree(spark):
    """A feature without a second value gives no split; among equal features the first is taken."""
    x = np.array([[7.0, float(i % 2), float(i % 2)] for i in range(60)])
    y = np.array([i % 2 * 2 for i in range(60)])
    model = boosting.SoftmaxBoosting(3, 2, 0.5, 3).fit(table(spark, x, y))
    assert {f for r in model.rounds for f in r.feature} <= {-1, 1}
    assert model.importances.tolist() == [0.0, 1.0, 0.0]


def test_detector_and_attribution(spark, data, tmp_path):
    x, y, rows = data
    detector = models.VulnerabilityDetector("gradient_boosting", {"n_estimators": 4, "max_depth": 3}).fit(rows)
    assert detector.softmax and np.mean([r.prediction == r.label for r in detector.transform(rows).collect()]) > 0.8
    for k in range(3):
        explained = attribution.tree_attribution(detector, rows, k).join(attribution.raw_output(detector, rows, k), "id").collect()
        assert len(explained) == len(x) and all(abs(r.base_value + sum(r.shap_values) - r.raw) < 1e-9 for r in explained)
    detector.save_model(spark, str(tmp_path / "m"))
    again = models.VulnerabilityDetector.load_model(spark, str(tmp_path / "m"))
    assert np.array_equal(margins_of(spark, detector.softmax, rows), margins_of(spark, again.softmax, rows))
    assert again.softmax.losses == detector.softmax.losses


def test_sums_take_few_bytes_and_come_back_whole():
    rng = np.random.default_rng(5)
    place = np.flatnonzero(rng.random(4000) < 0.6)
    cells = np.stack([rng.integers(-(1 << 26), 1 << 26, len(place)), rng.integers(1, 1 << 25, len(place)), rng.integers(1, 50, len(place))], axis=1)
    cells[7, 0], cells[8, 0] = -(1 << 26), (1 << 26) - 1
    sent = boosting._sums(3, place, cells.astype(float))
    assert sum(len(v) for c in sent.columns for v in c.to_pylist() if isinstance(v, bytes)) < 12 * len(place)
    steps, *back = boosting._from_planes(sent["cells"][0].as_py(), sent["met"][0].as_py())
    assert (np.cumsum(steps) == place).all() and (np.stack(back, axis=1) == cells).all()
    extremes = np.array([0, -1, 1, (1 << 61) - 1, -(1 << 61)])
    assert (boosting._from_planes(boosting._planes(extremes), 5)[0] == extremes).all()


@pytest.mark.parametrize("n, parts", [(3000, 40), (6000, 3), (60, 5)])
def test_a_level_has_as_many_tasks_as_cores_whatever_the_rows(spark, monkeypatch, n, parts):
    tune(spark)
    seen = []
    plain = boosting.SoftmaxBoosting._level

    def level(self, spark, state, *rest):
        seen.append(state.rdd.getNumPartitions())
        return plain(self, spark, state, *rest)

    monkeypatch.setattr(boosting.SoftmaxBoosting, "_level", level)
    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 1)
    x, y = make(n)
    boosting.SoftmaxBoosting(3, n_estimators=2, max_depth=1).fit(table(spark, x, y, parts))
    assert set(seen) == {max(1, min(spark.sparkContext.defaultParallelism, n // boosting.TASK_ROWS))}


def odd_table(n=700):
    x, y = make(n, width=6, n_classes=4)
    x[::19, 2], x[::23, 2], x[:, 5] = np.inf, -np.inf, 4.0
    return x, (y + np.arange(n) // 5) % 4


def test_held_and_level_by_level_grow_the_same_trees(spark, monkeypatch):
    """Past a write of the margins, with several splits and blocks, values that are infinite or no number, equal ones and equal rows."""
    tune(spark)
    x, y = odd_table()
    rows = table(spark, np.concatenate([x, x[:90]]), np.concatenate([y, y[:90]])).cache()
    cuts = boosting.cut_points(rows.select(vector_to_array("features").alias("x")), 6)
    monkeypatch.setattr(boosting, "cut_points", lambda *_: cuts)
    held = boosting.SoftmaxBoosting(4, 12, 0.4, 4).fit(rows)
    levels = []
    plain = boosting.SoftmaxBoosting._level
    monkeypatch.setattr(boosting.SoftmaxBoosting, "_level", lambda *a: levels.append(a) or plain(*a))
    monkeypatch.setattr(boosting, "HELD", 0)
    monkeypatch.setattr(boosting, "NODES", 5)
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    by_level = boosting.SoftmaxBoosting(4, 12, 0.4, 4).fit(rows)
    assert len(levels) == 48
    assert [r.columns() for r in held.rounds] == [r.columns() for r in by_level.rounds] and held.losses == by_level.losses
    assert np.array_equal(margins_of(spark, held, rows), margins_of(spark, by_level, rows))


def test_a_round_of_a_table_that_a_worker_holds_is_one_job(spark):
    tune(spark)
    x, y = odd_table()
    rows = table(spark, x, y).cache()
    rows.count()
    spark.sparkContext.setJobGroup("boosting-held", "")
    try:
        model = boosting.SoftmaxBoosting(4, 30, 0.1, 6).fit(rows)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("boosting-held")
    assert len(model.losses) == 30 and all(b < a for a, b in zip(model.losses, model.losses[1:]))
    assert 30 <= len(jobs) <= 45


@pytest.mark.parametrize("depth, bins, held", [(6, 32, True), (20, 256, False)])
def test_trees_of_too_many_cells_grow_level_by_level(spark, monkeypatch, depth, bins, held):
    tune(spark)
    x, y = make(3000)
    taken = []
    monkeypatch.setattr(boosting.SoftmaxBoosting, "_fit_held", lambda self, *_: taken.append("held"))
    monkeypatch.setattr(boosting.SoftmaxBoosting, "_grow", lambda self, *_: taken.append("level") or boosting.Round())
    boosting.SoftmaxBoosting(3, 1, max_depth=depth, max_bins=bins).fit(table(spark, x, y))
    assert taken == (["held"] if held else ["level"])


def test_a_worker_walks_only_the_trees_that_are_new_to_it():
    x, y = odd_table(200)
    bins = np.nan_to_num(x, posinf=9, neginf=0).clip(0, 9).astype(np.uint8)
    rng = np.random.default_rng(1)

    class Sent:
        asked = 0

        def __init__(self):
            tree = boosting.Round()
            for _ in range(4):
                tree.add(float(rng.normal()), 1)
            tree.feature[1], tree.cut[1], tree.left[1] = 3, 1, 4
            tree.add(float(rng.normal()), 1)
            tree.add(float(rng.normal()), 1)
            self.walker = boosting.Walker([tree], 4, True)

        @property
        def value(self):
            self.asked += 1
            return self.walker

    def slopes(table, rounds):
        table.forward(rounds)
        return table.slopes(2)

    def fresh(rounds):
        return slopes(boosting.Table(bins, y, np.zeros(4)), rounds)

    def same(found, expected):
        return np.array_equal(found[0], expected[0]) and np.array_equal(found[1], expected[1]) and found[2] == expected[2]

    rounds = [Sent() for _ in range(25)]
    kept = boosting.Table(bins, y, np.zeros(4))
    for t in (0, 1, 2, 9, 10, 11, 11, 25, 3):  # the last one: a task of an earlier round, repeated
        assert same(slopes(kept, rounds[:t]), fresh(rounds[:t]))
    before = rounds[0].asked
    slopes(kept, rounds[:4])
    assert rounds[0].asked == before
    assert np.array_equal(slopes(kept, [])[0], np.rint((0.25 - (y == 2)) * UNIT))


def test_blocks_of_rows_change_no_sum(monkeypatch):
    x, y = odd_table(500)
    bins = np.nan_to_num(x, posinf=9, neginf=0).clip(0, 9).astype(np.uint8)

    def grown():
        table = boosting.Table(bins, y, np.log(np.full(4, 0.25)))
        table.forward([])
        g, h, loss = table.slopes(1)
        return loss, table.tree(g, h, np.full(6, 9), 32, 4, 1.0, 1.0)

    whole = grown()
    monkeypatch.setattr(boosting, "BLOCK", 7)
    monkeypatch.setattr(boosting, "SCORES", 1)
    assert grown() == whole and len(whole[1]) == 4
    for level in whole[1]:
        for f, cut, gain, left, all_ in level:
            assert left[2] <= all_[2] <= 500 and (gain == 0 or 0 < left[2] < all_[2])


def test_bins_come_back_from_slices_of_a_column():
    values = np.arange(60, dtype=np.uint8).reshape(12, 5)
    column = boosting._bytes(values)
    assert (boosting._from_bytes(column, np.uint8, 5) == values).all()
    assert (boosting._from_bytes(column.slice(3, 4), np.uint8, 5) == values[3:7]).all()
    assert (boosting._from_bytes(column.cast(pa.large_binary()), np.uint8, 5) == values).all()
