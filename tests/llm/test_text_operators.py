"""Operators on documents against brute force, with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import decontaminate, language, licenses, line_dedup, minhash, packing, queries, sharding, textbytes

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, Shard int, lang string"


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    rows = [(i, "\n".join(line(rng.randint(4, 30)) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    base = line(200)
    for i in range(60, 100):  # near copies of one text
        words = base.split(" ")
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, rows[3][1]) for i in range(100, 140)]  # exact copies
    rows += [(140, None), (141, ""), (142, " \n\t "), (143, "one"), (144, "One"), (145, "½ § 12"), (146, "\x1fa\x0bb c")]
    rows += [(147, line(20000)), (None, rows[0][1]), (148, rows[148 - 60][1]), (148, rows[148 - 60][1])]
    return [(d, t, 9, "en") for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_shingles_equal_regular_expressions():
    texts = [t for _, t, _, _ in corpus()]
    found = textbytes.words(pa.array(texts, pa.string()))
    assert found.counts.tolist() == [len(alnum(t)) for t in texts]
    at = 0
    for text in texts:
        for word in alnum(text):
            assert found.text(at) == word.encode()
            at += 1
    for n in (1, 4, 5):
        _, bounds = textbytes.shingles(pa.array(texts, pa.string()), n)
        assert np.diff(bounds).tolist() == [len(shingle_set(t, n)) for t in texts]


def test_equal_words_have_equal_hashes_across_pieces(monkeypatch):
    texts = pa.array(["aa bb cc dd " * 50, "bb cc", "x" * 5000 + " aa"])
    whole = textbytes.words(texts).hashes()
    monkeypatch.setattr(textbytes, "PIECE", 64)
    assert (textbytes.words(texts).hashes() == whole).all()


def shards_of(frame, n, tolerance=0.02):
    keyed = frame.select("*", F.xxhash64("text").alias("key"), (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"))
    return sharding.shard(keyed, "key", "doc_id", "size", n, tolerance)


def test_shards_are_even_gapless_and_keep_small_groups(docs):
    rows = shards_of(docs.where("doc_id <> 147"), 7).collect()
    assert len(rows) == len(corpus()) - 2
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(7))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sums = [sum(r["size"] for r in by[s]) for s in range(7)]
    largest = max(r["size"] for r in rows)
    assert max(sums) - min(sums) <= 2 * largest
    again = shards_of(docs.where("doc_id <> 147").repartition(2), 7).collect()
    place = lambda rs: sorted((r.doc_id or -1, r.text or "", r.shard, r.slot) for r in rs)
    assert place(rows) == place(again)


def test_a_hot_group_is_cut_and_order_is_total(spark):
    hot = [(i, "same text" * 5, 0, "en") for i in range(3000)] + [(i, f"text {i}" * 5, 0, "en") for i in range(3000, 6000)]
    frame = spark.createDataFrame(hot, SCHEMA)
    rows = shards_of(frame, 10).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sums = [r.b for r in rows]
    assert len(sums) == 10 and max(sums) < 1.05 * min(sums)


def test_sharding_of_nothing_and_of_equal_rows(spark, nothing):
    assert shards_of(nothing, 4).collect() == []
    same = spark.createDataFrame([(None, None, 1, None)] * 5, SCHEMA)
    rows = shards_of(same, 4).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(5))


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("word_bpe_49k.json")


def test_packing_round_trip(docs, vocabulary):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary)
    given = docs.where("doc_id is not null and doc_id <> 148")
    rows = packing.pack(given, vocabulary).collect()
    assert "Shard" in rows[0].asDict() and len({r.sequence_id for r in rows}) == len(rows)
    by = collections.defaultdict(list)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and r.length == 1 << r.bucket
        by[r.doc_id].append(r)
    for doc_id, text, _, _ in corpus():
        if doc_id is None or doc_id == 148:
            continue
        want = coder.encode(text or "", add_special_tokens=False).ids + [2]
        parts = sorted(by[doc_id], key=lambda r: r.start)
        got = np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist()
        assert got == want and [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        assert all(p.doc_tokens == len(want) for p in parts)


def test_packing_of_nothing_and_repeated_rows(docs, nothing, vocabulary):
    assert packing.pack(nothing, vocabulary).collect() == []
    twice = packing.pack(docs.where("doc_id = 148"), vocabulary).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


@pytest.mark.parametrize(
    "text",
    ["It's. foo). 12.5, don't, _a. a_. ½. ß. ŉ ſt.", "<|ENDOFTEXT|> <|endoftext|>. A<|startoftext|>b", "''s '. Été. ×. ÷, é. ...", "K. İa.", "a\tb c\x0bd.", "x" * 300 + "."],
)
def test_word_ids_equal_the_tokenizer(text, vocabulary):
    coder = packing.WordTokenizer(vocabulary)
    texts = [text, None, "", text.lower(), text + " " + text]
    ids, bounds = coder.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == coder.coder.encode(t or "", add_special_tokens=False).ids


def test_word_cache_forgets_without_harm(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 50)
    coder = packing.WordTokenizer(vocabulary)
    for _, text, _, _ in corpus()[:30]:
        ids, _ = coder.encode(pa.array([text]))
        assert ids.tolist() == coder.coder.encode(text, add_special_tokens=False).ids


def test_remembered_words_take_little_memory(vocabulary, monkeypatch):
    """A worker keeps them over tasks and stages, beside whatever these need; new ones are encoded some at a time."""
    import gc
    import tracemalloc

    coder = packing.WordTokenizer(vocabulary)
    encoded, most = coder._encoded, []
    monkeypatch.setattr(coder, "_encoded", lambda words: most.append(len(words)) or encoded(words))
    texts = pa.array([" ".join(f"w{i}" for i in range(a, a + 1000)) for a in range(0, 40000, 1000)])
    tracemalloc.start()
    gc.collect()
    before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    coder.encode(texts)
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 100 * 40000 and max(most) < 10000
    ids, bounds = coder.encode(texts.slice(7, 1))
    assert sum(most) == 40000 and ids.tolist() == coder.coder.encode(texts[7].as_py(), add_special_tokens=False).ids


def test_words_of_equal_hash_keep_their_own_ids(vocabulary, monkeypatch):
    monkeypatch.setattr(packing.textbytes, "hashes_of", lambda column: np.zeros(len(column), np.uint64))
    coder = packing.WordTokenizer(vocabulary)
    for text in ("some words here", "here other words", "some other words", "words here"):
        ids, _ = coder.encode(pa.array([text]))
        assert ids.tolist() == coder.coder.encode(text, add_special_tokens=False).ids


def test_cut_is_the_binary_expansion():
    for n in [*range(1, 300), 4095, 4096, 4097, 12289]:
        parts = packing.cut(n, 4096)
        assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)
        assert len(parts) == n // 4096 + bin(n % 4096).count("1")


def brute_hits(text, items, n):
    words, hit, who = alnum(text), set(), set()
    for item, source in items:
        w = alnum(source)
        if not w:
            continue
        size = min(n, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                who |= {str(item)} - {"None"}
    return len(words), hit, sorted(who)


@pytest.mark.parametrize("group_bytes", [1 << 20, 400])
def test_decontamination_equals_brute_force(spark, docs, group_bytes):
    texts = {d: t for d, t, _, _ in corpus()}
    items = [(1, " ".join(texts[5].split()[2:20])), (2, texts[7].upper()), (3, None), (4, "!!"), (5, "one"), (6, " ".join(texts[9].split()[:3])), (6, "one"), (None, texts[2])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(docs, bench, group_bytes=group_bytes)
    got = {}
    for r in found.collect():
        n, hit, who = brute_hits(r.text, items, 10)
        assert r.n_words == n and list(r.item_ids) == who
        assert {p for s in r.spans for p in range(s.start, s.start + s.length)} == hit
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))
        got[r.doc_id] = bool(hit)
    kept = {r.doc_id for r in decontaminate.remove(found).collect()}
    assert kept == {d for d, dirty in got.items() if not dirty}
    for r in decontaminate.cut_spans(found).collect():
        n, hit, _ = brute_hits(texts.get(r.doc_id), items, 10)
        assert len(alnum(r.text)) == n - len(hit)


def test_decontamination_of_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(nothing, none).collect() == []
    assert decontaminate.find(docs, none).where("size(spans) > 0").count() == 0


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(3)
    bases = ["".join(rng.choice("abc dé") for _ in range(rng.randint(10, 24))).strip() or "x" for _ in range(12)]
    bases += ["aaaaaaaaaaaa", "", "   ", "abababababab", "ab" * 3000]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(line) + 1)
                line[at : at + rng.choice([0, 1])] = rng.choice([[], ["é"], ["a"]])
            lines.append("".join(line))
        rows.append((d, "\n".join(lines) if d % 20 else None, 1, "en"))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    first, occurrences = {}, []
    for d, text, _, _ in rows:
        for n, line in enumerate((text or "").split("\n")):
            if len(line.strip(" ")) >= 8:
                occurrences.append((d, n, line))
                first.setdefault(line, (d, n))
    near = {x for x in first if any(first[y] < first[x] and one_edit(x, y) for y in first if x != y)}
    assert near
    want = collections.defaultdict(lambda: ([], []))
    for d, n, line in occurrences:
        if first[line] != (d, n):
            want[d][0].append(n)
        elif line in near:
            want[d][1].append(n)
    found = line_dedup.find(frame, min_chars=8)
    for r in found.collect():
        assert (list(r.exact), list(r.near)) == want[r.doc_id], r
        assert r.Shard == 1
    cleaned = {r.doc_id: r.text for r in line_dedup.remove(found).collect()}
    for d, text, _, _ in rows:
        gone = {*want[d][0], *want[d][1]}
        left = "\n".join(x for n, x in enumerate((text or "").split("\n")) if n not in gone)
        if not gone:
            assert cleaned[d] == text
        elif left.strip():
            assert cleaned[d] == left
        else:
            assert d not in cleaned


def test_line_dedup_query_judges_short_lines(spark, tmp_path):
    texts = ["Menu\n\nx\r\n\r", "Menu\n\n\t\nMenu \nown\nx\r\n\r", "Menv\n\n\t\n\u2003\n\u2003\nown\nown", None, ""]
    spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op7_line_dedup(spark, str(tmp_path)).collect()
    kept = ["Menu\n\nx\r\n\r", "\n\t\nMenu \nown\n\r", "Menv\n\n\t\n\u2003\n\u2003", "", ""]
    assert {r.doc_id: (r.n_exact, r.n_near, r.kept_md5) for r in rows} == {i: (n, 0, hashlib.md5(k.encode()).hexdigest()) for i, (n, k) in enumerate(zip([0, 2, 2, 0, 0], kept))}


def test_line_dedup_of_nothing_null_ids_and_repeated_rows(spark, nothing):
    assert line_dedup.find(nothing).collect() == []
    line = "a line that is long enough to count as one"
    rows = [(None, line, 1, "en"), (1, line, 1, "en"), (2, "other " + line, 1, "en"), (2, "other " + line, 1, "en")]
    got = sorted((r.doc_id or 0, list(r.exact), list(r.near)) for r in line_dedup.find(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, [], []), (1, [0], []), (2, [], []), (2, [], [])]


def test_licence_places_equal_brute_force(spark, docs):
    extra = [
        (200, "MIT License mit-license, the MIT LICENSE.", 0, ""), (201, "Released under the Apache License; apache license", 0, ""),
        (202, "GNU General Public License", 0, ""), (203, "Licensed under CC BY-NC 4.0.", 0, ""), (204, "mitlicense mit licenses", 0, ""),
        (205, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the", 0, ""),
        (206, "permission license charge person software", 0, ""), (207, "mit license " * 3000, 0, ""),
    ]
    frame = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    rows = licenses.scan(frame).collect()
    assert len(rows) == frame.count()
    texts = {d: t for d, t, _, _ in [*corpus(), *extra]}
    for r in rows:
        words, places, labels = alnum(texts[r.doc_id]), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[203] == "cc-by-nc" and labels[205] == "mit" and labels[206] == "" and labels[204] == ""


def test_licences_of_files_with_several(spark):
    ts = licenses.templates()
    both = [(a, b) for a in ts for b in ts if a.number < b.number] + [tuple(ts)]
    rows = [(i, " and x. ".join(" ".join(t.words) for t in pair), 0, "") for i, pair in enumerate(both)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all({t.label for t in pair} <= set(got[i].labels.split(",")) and got[i].score > 0.999 for i, pair in enumerate(both))


def test_licences_of_nothing(nothing):
    assert licenses.scan(nothing).collect() == []


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 7, 100, 5000)]
    sets.append(np.concatenate([sets[4][:4000], rng.integers(0, 2**63, 1000, dtype=np.uint64)]))
    sketch = minhash.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert (sketch != np.uint64(2**64 - 1)).all()
    assert abs((sketch[4] == sketch[5]).mean() - 4000 / 6000) < 0.15 and (sketch[4] == sketch[3]).mean() < 0.1


def brute_components(rows, n):
    ids = {d: shingle_set(t, n) for d, t, _, _ in rows if d is not None}
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(ids)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(ids[a] & ids[b])
            if both and 100 * both >= 80 * (len(ids[a]) + len(ids[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}, ids


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_all_pairs(docs, n):
    want, sets = brute_components(corpus(), n)
    rows = minhash.near_duplicates(docs, n=n).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == want[r.doc_id])


def test_near_duplicates_along_a_chain(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[5 * i : 5 * i + 120]), 0, "") for i in range(40)]
    want, _ = brute_components(rows, 5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and len(set(want.values())) < 20


def test_near_duplicates_of_nothing(nothing):
    assert minhash.near_duplicates(nothing).collect() == []


def test_language_is_learnt_and_unknown_where_there_is_no_letter(spark):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12))
    rows = [(i, make("abcde") if i % 2 else make("vwxyzé"), 0, "aa" if i % 2 else "zz") for i in range(300)]
    rows += [(900, None, 0, "aa"), (901, "", 0, "aa"), (902, "12 ½ !", 0, "zz"), (903, "abcab", 0, None), (904, make("abcde") * 30000, 0, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    teaches = language.in_training(F.col("doc_id"))
    model = language.train(frame.where(teaches))
    got = {r.doc_id: r for r in language.predict(frame, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].lang_pred == ("aa" if i % 2 else "zz") for i in held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_lessons(spark, nothing, docs):
    model = language.train(nothing)
    assert language.predict(nothing, model).collect() == []
    assert {r.lang_pred for r in language.predict(docs, model).collect()} == {"und"}
    many = spark.createDataFrame([(i, "x", 0, f"l{i}") for i in range(5)], SCHEMA)
    with pytest.raises(Exception, match="languages"):
        language.train(many, max_languages=4)


def test_hash_of_ids_is_little_endian(spark, vocabulary):
    row = packing.pack(spark.createDataFrame([(1, "", 0, "")], SCHEMA), vocabulary).select("ids", F.crc32("ids").alias("c")).first()
    assert bytes(row.ids) == (2).to_bytes(4, "little") and row.c == zlib.crc32(bytes(row.ids)) and hashlib.md5(row.ids).digest()


def test_clashing_columns_pass_through(spark, vocabulary):
    """Extra columns with names that the operators use inside, or give to results."""
    names = ["packed_text", "_at", "_gone", "_place", "_nr", "_answer", "key_", "Score", "SLOT", "spans", "start", "n_lines"]
    frame = spark.createDataFrame([(i, f"text number {i} " * 5, *range(len(names))) for i in range(20)], ["doc_id", "text", *names])
    same = lambda df, gone: all(r[n] == names.index(n) for r in df.collect() for n in names if n not in gone)
    assert same(packing.pack(frame, vocabulary), {"start"})
    assert same(line_dedup.find(frame), {"n_lines"})
    assert same(shards_of(frame, 3), {"SLOT"})
    model = language.train(frame.withColumn("lang", F.lit("aa")))
    assert same(language.predict(frame, model), {"Score"})
    assert same(decontaminate.find(frame, spark.createDataFrame([(1, "text")], "item_id long, text string")), {"spans"})
    assert minhash.near_duplicates(frame).count() == licenses.scan(frame).count() == 20


def thue_morse(n, letters="ab"):
    word = letters[0]
    swap = str.maketrans(letters, letters[::-1])
    while len(word) < n:
        word += word.translate(swap)
    return word


def test_words_that_defeat_polynomial_hashes(spark, vocabulary):
    """Two long words of equal polynomial hash modulo 2**64, whatever the base, stay two words."""
    a, b = thue_morse(2048), thue_morse(2048, "ba")
    assert a != b and len({*textbytes.words(pa.array([f"{a} {b}"])).hashes().tolist()}) == 2
    coder = packing.WordTokenizer(vocabulary)
    ids, bounds = coder.encode(pa.array([a, b]))
    assert [ids[x:y].tolist() for x, y in zip(bounds, bounds[1:])] == [coder.coder.encode(t, add_special_tokens=False).ids for t in (a, b)]
    rows = minhash.near_duplicates(spark.createDataFrame([(1, a, 0, ""), (2, b, 0, "")], SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 2)}


def brute_language(rows, teaches):
    """Posterior of each text over counts of all n-grams in a plain dictionary of buckets."""

    def grams(text):
        low = f" {text.lower()} "
        for order in language.ORDERS:
            for i in range(len(low) - order + 1):
                h = 0
                for k in range(order):
                    h = (h * 0x01000193 + (ord(low[i + k]) + k + 1) * 0x9E3779B1) % 2**32
                yield ((h ^ (h >> 15)) * 0x85EBCA77 % 2**32) >> (32 - language.BITS)

    counts, docs = {}, collections.Counter()
    for d, text, _, lang in rows:
        if teaches(d) and text and lang is not None:
            docs[lang] += 1
            counts.setdefault(lang, collections.Counter()).update(grams(text))
    total = {la: sum(c.values()) + 0.1 * 2**language.BITS for la, c in counts.items()}
    out = {}
    for d, text, _, _ in rows:
        if text and any(map(str.isalpha, text)):
            bag = collections.Counter(grams(text))
            logs = {la: np.log(docs[la] / sum(docs.values())) + sum(k * np.log((c[g] + 0.1) / total[la]) for g, k in bag.items()) for la, c in counts.items()}
            top = max(logs.values())
            out[d] = (max(sorted(logs), key=logs.get), 1 / sum(np.exp(v - top) for v in logs.values()))
        else:
            out[d] = ("und", 0.0)
    return out


@pytest.mark.parametrize("piece", [7, 1 << 17])
def test_language_posterior_equals_plain_counts(spark, monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    rng = random.Random(8)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
    rows = [(i, make("abc ß") if i % 2 else make("abD É"), 0, "xx" if i % 2 else "yy") for i in range(120)]
    rows += [(200, None, 0, "xx"), (201, "", 0, "yy"), (202, "12 !", 0, None), (203, "ΑΣ Σ", 0, None)]
    texts = [t for _, t, _, _ in rows]
    want = brute_language(rows, lambda d: d % 3 > 0)
    buckets = [np.sort(np.concatenate([b[o == i] for b, o in language.parts_of(texts)])).tolist() for i in (0, 203 - 200 + 120)]
    monkeypatch.setattr(language, "PIECE", 1 << 17)
    assert buckets == [np.sort(np.concatenate([b for b, _ in language.parts_of([texts[i]])])).tolist() for i in (0, 123)]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = language.train(frame.where("doc_id % 3 > 0"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(frame, model).collect()}
    assert {d: a for d, (a, _) in got.items()} == {d: a for d, (a, _) in want.items()}
    assert all(abs(got[d][1] - want[d][1]) < 1e-9 for d in got)


def test_long_text_has_all_its_grams():
    text = "abcdefg hij" * 30_000
    n = sum(len(b) for b, _ in language.parts_of([text]))
    assert n == 3 * (len(text) + 2) - 3


def test_queries_keep_their_contracts(spark, tmp_path):
    """Columns, types, law, folds and checksums of the registered queries."""
    rows = [(i, f"text number {i} of a small table, " * (1 + i % 5), "s", "en") for i in range(60)] + [(60, None, "s", None), (61, "", "s", "en"), (61, "twice é", "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = str(tmp_path)
    one = queries.op1_histogram_shards(spark, folder)
    assert dict(one.dtypes) == dict(doc_id="bigint", size="bigint", text_crc32="bigint", law="string", shard="int", slot="bigint", grown_shard="int")
    one = one.collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in one) == sorted((d, 16 + len((t or "").encode()), crc(t)) for d, t, _, _ in rows)
    assert {r.law for r in one} == {"bytes"} and {r.grown_shard for r in one} == {None} and all(0 <= r.shard < 40 for r in one)
    for shard in {r.shard for r in one}:
        assert sorted(r.slot for r in one if r.shard == shard) == list(range(sum(r.shard == shard for r in one)))
    two = queries.op2_power_of_two_packing(spark, folder).collect()
    assert sum(r.length for r in two) == sum({r.doc_id: r.doc_tokens for r in two if r.doc_id != 61}.values()) + sum(r.length for r in two if r.doc_id == 61)
    assert len({(r.sequence_id, r.offset) for r in two}) == len(two)
    ten = queries.op10_language_id(spark, folder)
    assert dict(ten.dtypes) == dict(doc_id="bigint", held_out="boolean", lang_pred="string", score="double")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ten.collect())
    nine = queries.op9_near_dedup(spark, folder).collect()
    want, _ = brute_components([(i, t, 0, "") for i, (d, t, _, _) in enumerate(rows)], 4)
    by_row = sorted((rows[i][0], rows[c][0]) for i, c in want.items())
    assert sorted((r.doc_id, r.component_id) for r in nine) == by_row
