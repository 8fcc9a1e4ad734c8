"""Manifest, periodic runs and hidden Markov model against brute force."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import compare, database
from riskweave.llm import hmm, merkle, periodic, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, STEP int, idx int, folded string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def odd_rows(n=150):
    rng = random.Random(9)
    texts = [None, "", " \n\t ", "One", "Ü ß 12 É", "a b " * 40, "x\u00a0y\x1fz w\x0bv", "A" * 70000 + " b", "Long wOrds " * 9000]
    rows = [(i, rng.choice(texts) if i % 3 else f"Doc {i} says {rng.random()} and " * rng.randint(1, 9), rng.choice(["en", "de", None, "ÿ", "z", ""]), "s", i, 1, 2, "x") for i in range(n)]
    rows += [rows[4]] * 20 + [(None, "Null id", "en", None, None, 1, 2, "x")] * 2 + [(7, "other Text", "en", "s", 1, 1, 2, "x")]
    return rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(levels, at, now):
    """Siblings of a leaf, and the root folded from another hash, over the levels of one tree."""
    proof = ""
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        place = at % 8
        proof += "".join(run[:place] + run[place + 1 :])
        now = h(*run[:place], now, *run[place + 1 :])
        at //= 8
    return proof, now


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: h(*map(field, (r[0], r[3], r[2], r[4], t)))
    key = lambda v: (v is not None, v)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[lang] = (own, levels_of([leaf(r, r[1]) for r in own]))
    top = levels_of([trees[lang][1][-1][0] for lang in langs])
    out = []
    for t, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, r in enumerate(own):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, r[1].translate(FOLD) if touched and r[1] is not None else r[1])
            proof, sub = climbed(levels, i, now)
            above, root = climbed(top, t, sub)
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], h(proof + above), root, root == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [odd_rows(), odd_rows()[:1], [(i, f"T{i}", f"l{i:02d}", "s", 1, 1, 2, "x") for i in range(11)]], ids=["odd", "one", "many groups"])
def test_manifest_equals_brute_force(spark, tmp_path, rows):
    got = queries.op11_merkle_manifest(spark, written(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == brute_manifest(rows)
    assert len(rows) < 20 or {r[-1] for r in got} == {True, False}


def test_manifest_of_nothing(spark, tmp_path):
    assert queries.op11_merkle_manifest(spark, written(spark, tmp_path, [])).collect() == []


def test_manifest_tables_link_to_their_parents(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit("g").alias("g"), merkle.digest(F.col("id").cast("string")).alias("leaf"))
    leaves, runs, roots = merkle.manifest(rows, "g", "k")
    assert [leaves.count(), runs.where("at_level = 1").count(), runs.where("at_level = 2").count(), runs.where("at_level = 3").count()] == [100, 13, 2, 1]
    ends = runs.where("up_tree is null").collect()
    assert len(ends) == 1 and ends[0].digest == roots.first().root
    proofs = merkle.proofs(leaves, runs, roots, "k", "leaf").collect()
    assert len(proofs) == 100 and all(r.verified for r in proofs)


def lyndon(code):
    """Duval's step at every place."""
    out = []
    for i in range(len(code)):
        j, k = i + 1, i
        while j < len(code) and code[k] <= code[j]:
            k = i if code[k] < code[j] else k + 1
            j += 1
        out.append(j - k)
    return out


def brute_runs(code, least=24):
    found = []
    for q in range(1, len(code) // 3 + 1):
        start = None
        for i in range(len(code) - q + 1):
            same = i < len(code) - q and code[i] == code[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                size = i + q - start
                if size >= max(least, 3 * q) and not any(s <= start and start + size <= s + n and q % p == 0 for s, n, p in found):
                    found.append((start, size, q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_lengths_in_both_orders():
    rng = random.Random(1)
    for _ in range(600):
        code = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        code = np.unique(code, return_inverse=True)[1].tolist() if code else []
        for order in (code, [max(code, default=0) - c for c in code]):
            order = np.unique(order, return_inverse=True)[1].tolist() if order else []
            assert periodic.lyndon_lengths(order) == lyndon(order)


def repetitive(rng, n, letters):
    out = []
    while len(out) < n:
        if rng.random() < 0.5:
            out += [rng.randrange(letters) for _ in range(rng.randint(1, 10))]
        else:
            word = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
            out += word * rng.randint(2, 30) + word[: rng.randint(0, len(word))]
    return out


def test_runs_equal_all_periods():
    rng = random.Random(2)
    for _ in range(600):
        code = repetitive(rng, rng.randint(20, 120), rng.randint(1, 5))
        assert periodic.runs_of(np.array(code)) == brute_runs(code)
    fibonacci = [0]
    for _ in range(14):
        fibonacci = [b for a in fibonacci for b in ([0, 1] if a == 0 else [0])]
    assert periodic.runs_of(np.array(fibonacci)) == brute_runs(fibonacci)


def brute_periodic(doc_id, text):
    words = WORD.findall(text or "")
    n, crc = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = crc // 10
    if crc % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, h(lines), h(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [r for r in odd_rows(60) if not (r[1] or "").startswith("Long")]
    for i in range(100, 400):
        words = [rng.choice(["a", "B", "b", "é", "c,"]) for _ in range(5)]
        code = repetitive(rng, rng.randint(0, 90), 5)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words[c] for c in code), "en", "s", 1, 1, 2, "x"))
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    got = queries.op12_periodic_runs(spark, written(spark, tmp_path, rows))
    assert dict(got.dtypes) == dict(doc_id="bigint", n_runs="bigint", start="bigint", length="bigint", period="bigint", exponent_milli="bigint", runs_sha256="string", collapsed_sha256="string")
    want = sorted((brute_periodic(r[0], r[1]) for r in rows), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(w[1] > 1 for w in want)


def test_periodic_long_text_clashing_columns_and_nothing(spark):
    frame = spark.createDataFrame([(1, "a b c " * 100_000, 5, 6, 7), (2, None, 5, 6, 7)], "doc_id long, text string, _text int, Runs int, _tail int")
    out = periodic.collapse(frame).orderBy("doc_id").collect()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed, r._text, r._tail) for r in out] == [(300_000, [(0, 300_000, 3)], "a b c", 5, 7), (0, [], "", 5, 7)]
    assert periodic.collapse(frame.limit(0)).collect() == []


def plain_probability(model, classes):
    a = model.start * model.emit[classes[0]]
    for c in classes[1:]:
        a = (a @ model.move) * model.emit[c]
    return a.sum()


def path_counts(model, classes):
    """Expected counts by walking every path of states."""
    out, total = hmm.Counts.zero(model), 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(classes)):
        p = model.start[path[0]] * model.emit[classes[0], path[0]]
        for a, b, c in zip(path, path[1:], classes[1:]):
            p *= model.move[a, b] * model.emit[c, b]
        total += p
        out.start[path[0]] += p
        for s, c in zip(path, classes):
            out.emit[c, s] += p
        for a, b in zip(path, path[1:]):
            out.move[a, b] += p
    return [x / total for x in (out.start, out.move, out.emit)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_recursions_equal_all_paths(chunk):
    rng = np.random.default_rng(chunk)
    prior = rng.dirichlet(np.ones(5))
    model = hmm.initial(3, prior)
    for _ in range(8):
        texts = [rng.integers(0, 5, rng.integers(1, 8)) for _ in range(rng.integers(1, 6))]
        classes, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
        assert np.allclose(hmm.log_probabilities(model, classes, sizes, chunk), [math.log10(plain_probability(model, t)) for t in texts])
        counts = hmm.Counts.zero(model)
        counts.add(model, classes, sizes, chunk)
        want = [path_counts(model, t) for t in texts]
        for got, i in ((counts.start, 0), (counts.move, 1), (counts.emit, 2)):
            assert np.allclose(got, sum(w[i] for w in want))
        model = hmm.maximised(counts.start, counts.move, counts.emit, prior)
        assert np.allclose(model.move.sum(axis=1), 1) and np.allclose(model.emit.sum(axis=0), 1)


def test_long_sequence_is_whole():
    rng = np.random.default_rng(0)
    model = hmm.initial(4, rng.dirichlet(np.ones(50)))
    classes = rng.integers(0, 50, 200_000)
    whole = hmm.log_probabilities(model, classes, np.array([len(classes)]))
    a, total = model.start, 0.0
    for i, c in enumerate(classes):
        a = (a if not i else a @ model.move) * model.emit[c]
        total += math.log10(a.sum())
        a = a / a.sum()
    assert abs(whole[0] - total) < 1e-6 * abs(total)


def alternating(n=300):
    """Texts whose words alternate between two vocabularies, so a model with states beats single words."""
    rng = random.Random(4)
    pick = lambda side: f"{side}{rng.randint(1, 12)}"
    rows = [(i, " ".join(pick("AB"[j % 2]) for j in range(rng.randint(2, 30))), "en", "s", 1, 1, 2, "x") for i in range(n)]
    return rows + [(n, None, "en", "s", 1, 1, 2, "x"), (n + 1, "", "en", "s", 1, 1, 2, "x"), (n + 2, "unseen wörds Here", "en", "s", 1, 1, 2, "x"), rows[5], rows[5]]


def brute_base(rows):
    tokens = lambda t: [*WORD.findall((t or "").translate(FOLD)), None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    return sorted((r[0], held(r[0]), len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r[1])), 6)) for r in rows)


def test_hidden_markov_query(spark, tmp_path):
    rows = alternating()
    got = queries.op13_hidden_markov(spark, written(spark, tmp_path, rows)).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute_base(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_probabilities_sum_to_one_and_rounds_help(spark):
    rows = alternating(200)
    frame = spark.createDataFrame(rows, SCHEMA)
    of = lambda **options: sum(r.score for r in hmm.score(frame, F.col("doc_id") % 5 > 0, **options).collect())
    few, more = of(states=2, rounds=0), of(states=2, rounds=12)
    assert more > few
    # Two-token texts: the chance of any first word, known or not, then the end, is at most one in all.
    words = [f"{s}{i}" for s in "ab" for i in range(1, 13)] + ["never"]
    probe = [(10_000 + i, w, "en", "s", 1, 1, 2, "x") for i, w in enumerate(words)] + [(20_000, "", "en", "s", 1, 1, 2, "x")]
    scored = hmm.score(frame.unionByName(spark.createDataFrame(probe, SCHEMA)), F.col("doc_id") < 10_000, states=2).where("doc_id >= 10000").collect()
    assert 0 < sum(10**r.score for r in scored) <= 1


def test_hidden_markov_of_nothing(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert hmm.score(nothing, F.lit(True)).collect() == []
    rows = hmm.score(spark.createDataFrame(alternating(9), SCHEMA), F.lit(False)).collect()
    assert len(rows) == 14 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="supplied tables not present")
def test_manifest_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(queries.op11_merkle_manifest(spark, folder), database(folder), queries.ORACLES["op11_merkle_manifest"]) is None


def test_a_task_leaves_no_freed_memory_with_its_worker():
    import gc
    import numpy as np
    import psutil
    from riskweave.llm import textbytes

    def held():
        gc.collect()
        return psutil.Process().memory_info().rss >> 20

    def run(batches):
        for n in batches:
            # Small blocks, every fiftieth of which stays, so that the heap cannot shrink from its end.
            blocks = [np.ones(8000, np.uint8) for _ in range(n)]
            stay.extend(blocks[::50])
            yield len(blocks)

    sizes = []
    for function in (run, textbytes.released(run)):
        stay, before = [], held()
        assert list(function(iter([20000, 20000]))) == [20000, 20000]
        sizes.append(held() - before)
    assert sizes[1] < max(sizes[0] / 2, 40)
