import math

import numpy as np
import pytest

from riskweave.operators import features, matrix, ranks, summary
from riskweave.plans import golden
from riskweave.session import tune
from pyspark.sql import functions as F

# Code, then nodes, depth, functions, dangerous calls, strings, mean string length,
# cyclomatic complexity, lines, characters, mean and longest line, empty lines.
EXPECTED = [
    ("def test(): return 42", 5, 3, 1, 0, 0, 0, 1, 1, 21, 21.0, 21, 0),
    ("password = 'secret123'", 5, 3, 0, 0, 1, 9.0, 1, 1, 22, 22.0, 22, 0),
    ("result = eval('2 + 2')", 8, 4, 0, 1, 1, 5.0, 1, 1, 22, 22.0, 22, 0),
    ("", 1, 0, 0, 0, 0, 0, 1, 1, 0, 0.0, 0, 1),
    ("x = a + b * a + 'ab'\n", 17, 6, 0, 0, 1, 2.0, 1, 2, 21, 10.0, 20, 1),
]
NAMES = [
    "ast_nodes", "ast_depth", "function_count", "dangerous_calls", "string_count", "avg_string_length",
    "cyclomatic_complexity", "line_count", "char_count", "avg_line_length", "max_line_length", "empty_lines",
]
MORE = [
    "async def f():\n    async for i in x:\n        await i\n",
    "class A:\n    '''One\n    two\n    '''\n    def m(self):\n        'Doc'\n        return a and b and c or d\n",
    "try:\n    a()\nexcept A:\n    pass\nexcept (B, C):\n    pass\n",
    "s = 'token = \"abc\"'; t = f'key = {\"x\"}'; u = 'api_key=\"k\" password=\"p\"'\n",
    "def broken(",
    "from a import b\nimport c, d\nx = y ** 2 // 3 % z\nopen('f'); obj.eval(x)\n",
    "'''Module\n\ndoc.'''\nx: int = -1 if not y else ~z\nlambda a: a @ b\n",
    "# c\n   # d\n\t\n \u3000\nx = 1 # no\n",
]


def rows(spark, codes):
    tune(spark)
    table = spark.createDataFrame(list(enumerate(codes)), "file_id int, code string")
    return {r.file_id: r for r in features.all_features(table).collect()}


def test_golden_values(spark):
    got = rows(spark, [e[0] for e in EXPECTED])
    for i, expected in enumerate(EXPECTED):
        assert [got[i][n] for n in NAMES] == pytest.approx(list(expected[1:])), expected[0]
    last = got[len(EXPECTED) - 1]
    assert last.halstead_volume == pytest.approx(20.6797, abs=1e-4)
    assert last.halstead_difficulty == pytest.approx(1.25)
    assert last.halstead_effort == pytest.approx(25.8496, abs=1e-4)


def test_tree_features_equal_brute_force(spark):
    codes = MORE + [code for _, _, code in golden.pairs()]
    got = rows(spark, codes)
    for i, code in enumerate(codes):
        for name, value in golden.features_of(code).items():
            assert got[i][name] == pytest.approx(value), (name, code)
        lengths = [len(x) for x in code.split("\n")]
        assert got[i].avg_line_length == pytest.approx(sum(lengths) / len(lengths))
        assert got[i].comment_lines == sum(x.strip().startswith("#") for x in code.split("\n"))
        assert got[i].empty_lines == sum(not x.strip() for x in code.split("\n"))


def test_scaling_uses_the_fitted_statistics(spark):
    tune(spark)
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    new = spark.createDataFrame([(2.0, 7.0), (4.0, 5.0)], "a double, b double")
    fitted = matrix.scale_fit(train, ["a", "b"])
    got = [tuple(r) for r in matrix.scale_apply(new, fitted, ["a", "b"]).collect()]
    assert got == [(0.0, 0.0), (pytest.approx(2 / math.sqrt(2)), 0.0)]
    one = spark.createDataFrame([(4.0,)], "a double")
    assert matrix.scale_apply(one, matrix.scale_fit(one, ["a"]), ["a"]).first().a == 0.0


def skewed(spark, n=3000):
    """A third of all rows share one key and one value."""
    rng = np.random.default_rng(3)
    data = [(i, "hot" if i % 3 == 0 else f"k{i % 5}", 7.0 if i % 3 == 0 else float(rng.integers(0, 400)) / 8) for i in range(n)]
    return data, spark.createDataFrame(data, "id int, label string, x double").repartition(7)


def test_shuffled_rank_is_exact_under_skew(spark):
    data, table = skewed(spark)
    got = ranks.shuffled_rank(table, ["label"], 42, "id").collect()
    for label in {d[1] for d in data}:
        mine = sorted(r["rank"] for r in got if r.label == label)
        size = sum(d[1] == label for d in data)
        assert mine == list(range(1, size + 1))
        assert {r.group_size for r in got if r.label == label} == {size}


def test_running_sums_under_skew(spark):
    data, table = skewed(spark)
    got = {
        (r.label, r.x): r
        for r in ranks.running_sums(table, ["label"], "x", {"n": F.count("*"), "s": F.sum("id")}, buckets=8).collect()
    }
    for label in {d[1] for d in data}:
        xs = sorted({d[2] for d in data if d[1] == label})
        assert sorted(x for k, x in got if k == label) == xs
        for i, x in enumerate(xs):
            r = got[label, x]
            assert r.n_upto == sum(d[1] == label and d[2] <= x for d in data)
            assert r.s_upto == sum(d[0] for d in data if d[1] == label and d[2] <= x)
            assert r.n_total == sum(d[1] == label for d in data)
            after = xs[i + 1] if i + 1 < len(xs) else None
            assert r.n_next == (None if after is None else sum(d[1] == label and d[2] == after for d in data))


def test_exact_quantiles(spark):
    data, table = skewed(spark, 1000)
    got = {(r.label, r.q): r.value for r in ranks.exact_quantiles(table, ["label"], "x", (0.25, 0.5, 0.75, 1.0)).collect()}
    for label in {d[1] for d in data}:
        xs = [d[2] for d in data if d[1] == label]
        for q in (0.25, 0.5, 0.75, 1.0):
            assert got[label, q] == pytest.approx(float(np.quantile(xs, q)))


def test_top_per_group_is_exact(spark):
    data, table = skewed(spark)
    got = ranks.top_per_group(table, ["label"], [F.desc("x"), "id"], 10, "id", salts=4).collect()
    for label in {d[1] for d in data}:
        best = sorted((d for d in data if d[1] == label), key=lambda d: (-d[2], d[0]))[:10]
        assert sorted(r.id for r in got if r.label == label) == sorted(d[0] for d in best)


def test_chunks_keep_order_and_size(spark):
    table = spark.range(23).repartition(5)
    got = [r.members for r in ranks.chunks(table, "id", 5).orderBy("chunk").collect()]
    assert got == [list(range(i, min(i + 5, 23))) for i in range(0, 23, 5)]


def test_stratified_split_shares(spark):
    _, table = skewed(spark)
    got = matrix.stratified_split(table, test_size=0.25).groupBy("label", "part").count().collect()
    sizes = {(r.label, r.part): r["count"] for r in got}
    for label in {k for k, _ in sizes}:
        whole = sizes[label, "test"] + sizes[label, "train"]
        assert sizes[label, "test"] == math.floor(0.25 * whole)


def test_summary_of_nothing(spark):
    schema = "file_path string, severity string, vulnerability_type string, confidence double"
    empty = spark.createDataFrame([], schema)
    assert [tuple(r) for r in summary.finding_summary(empty).collect()] == [("total", "", 0)]


def test_tf_idf_rows_have_unit_length(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, "x")], "id int, text string")
    got = matrix.tf_idf(docs, "id", "text", max_features=4).collect()
    for key in {r.id for r in got}:
        assert sum(r.weight**2 for r in got if r.id == key) == pytest.approx(1.0)
    assert {r.term for r in got} == {"aa", "bb", "aa bb", "aa bb aa"}


def test_tf_idf_keeps_the_most_frequent_runs(spark):
    """Counting only runs of frequent words keeps the same terms as counting every run."""
    from collections import Counter

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(v)}" for v in rng.geometric(0.25, 60)) for _ in range(40)]
    counts = Counter()
    for text in texts:
        words = text.split()
        for n in (1, 2, 3):
            counts.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size in (5, 12):
        kept = sorted(counts, key=lambda t: (-counts[t], t))[:size]
        assert {r.term for r in matrix.tf_idf(docs, "id", "text", size).collect()} == set(kept)


def test_tf_idf_counts_only_what_goes_on_from_kept_terms(spark, monkeypatch):
    """Ties, short and missing texts, repeated and null ids; long runs of rare words are never counted."""
    from collections import Counter

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(v)}" for v in rng.geometric(0.3, 40)) + f" one{i} two{i} three{i}" for i in range(30)]
    texts += ["Äa äa x äa", "", None, "z", "w1 w1"]
    ids = [None if i % 9 == 4 else i // 2 for i in range(len(texts))]
    counts, by_id = Counter(), {}
    for key, text in zip(ids, texts):
        words = [w for w in (text or "").lower().split() if len(w) > 1]
        for n in (1, 2, 3):
            found = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
            counts.update(found)
            by_id.setdefault(key, Counter()).update(found)
    counted = []
    plain = matrix._run_counts

    def run_counts(words, held, n):
        out = plain(words, held, n)
        counted.extend(r.term for r in out.where(F.lit(n > 1)).collect())
        return out

    monkeypatch.setattr(matrix, "_run_counts", run_counts)
    docs = spark.createDataFrame(list(zip(ids, texts)), "id int, text string").repartition(3)
    for size in (4, 30, 100_000):
        counted.clear()
        kept = set(sorted(counts, key=lambda t: (-counts[t], t))[:size])
        weights = {}
        for key, found in by_id.items():
            idf = {t: np.log((len(texts) + 1) / (sum(t in f for f in by_id.values()) + 1)) + 1 for t in found if t in kept}
            norm = np.sqrt(sum((found[t] * idf[t]) ** 2 for t in idf))
            weights |= {(key, t): found[t] * idf[t] / norm for t in idf}
        got = {(r.id, r.term): r.weight for r in matrix.tf_idf(docs, "id", "text", size).collect()}
        assert got == pytest.approx(weights)
        if size == 4:
            assert counted and not any("one" in t or "two" in t for t in counted)
    none = spark.createDataFrame([], "id int, text string")
    assert matrix.tf_idf(none, "id", "text").collect() == []
