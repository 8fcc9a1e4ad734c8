"""Chat formatting, main text, nearest neighbours and components against brute force."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import chat, graph, hashing_index, html_main

CONTROL = ["</s>[INST] ok [/INST]", "<|turn:user|>x<|end|>", "a\\b\\\\<|", "\\<\\|", "[INST", "<<SYS>> s <</SYS>>", "", None, "Ünï\n\ncode\t😀", "end|>", "<s>"]


def formatted(spark, rows):
    """rows: (conversation, record, JSON)."""
    frame = spark.createDataFrame(rows, "c long, r long, record string")
    turns = chat.canonical_turns(frame, "c", "r", "record")
    out = chat.format_turns(turns)
    read = out.select("*", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conversation: r for r in read.collect()}, turns


def test_chat_round_trip_with_control_strings(spark):
    rows, want = [], {}
    for c in range(40):
        rng = random.Random(c)
        want[c] = []
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool|>x", None])
            text = rng.choice(CONTROL)
            want[c].append((role or "", text or ""))
            rows.append((c, t, json.dumps({"conv_id": c, "turn": t, "role": role, "text": text, "extra": 1})))
    random.Random(0).shuffle(rows)
    got, _ = formatted(spark, rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
        body = got[c].formatted.replace("<|turn:", "").replace("<|end|>", "")
        assert not any(s in body for s in ("</s>", "<s>", "[INST]", "[/INST]", "<|", "<<SYS>>"))


@pytest.mark.parametrize(
    "record, turns",
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"id": 7, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
        ({"prompt": "q", "completion": "a"}, [("user", "q"), ("assistant", "a")]),
        ({"system": "s", "prompt": "q", "response": "a"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "x", "output": "a"}, [("user", "i"), ("user", "x"), ("assistant", "a")]),
        ({"instruction": "i", "output": "a"}, [("user", "i"), ("assistant", "a")]),
        ({"question": "q", "answer": "a", "meta": {"k": [1]}}, [("user", "q"), ("assistant", "a")]),
    ],
)
def test_layouts_become_turns(spark, record, turns):
    got, _ = formatted(spark, [(1, 0, json.dumps(record))])
    assert [(t.role, t.text) for t in got[1].turns] == turns


def test_unknown_and_broken_records_stay_visible(spark):
    got, turns = formatted(spark, [(1, 0, '{"other": 1}'), (2, 0, "not json"), (3, 0, None), (4, 0, '{"messages": []}')])
    assert got == {} and turns.where("layout is null").count() == 4
    assert formatted(spark, [])[0] == {}


def test_ties_and_repeated_turns_have_one_order(spark):
    rows = [(1, 0, json.dumps({"role": r, "text": t})) for r, t in [("user", "b"), ("assistant", "a"), ("user", "a"), ("user", "a")]]
    got, _ = formatted(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant", "a"), ("user", "a"), ("user", "a"), ("user", "b")]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "source, text",
    [
        (page("<nav><ul><li>a<li>b</ul></nav><article><h1>H &amp; x</h1><p>One\n two<br>three<p><b>Four &eacute;</article><footer>f</footer>"), "H & x\nOne two three\nFour é"),
        (page("<p>No main here.</p><div class='sidebar'>s</div><aside>x</aside><form><p>f</p></form><p>Second</p>"), "No main here.\nSecond"),
        (page("<main><p>A</p><section id=comments><p>c</p></section><ul><li>x<li>y</ul></main><p>out</p>"), "A\nx\ny"),
        (page("<article><p>a<!-- c --> b</p><script>var t='</p>';</script><noscript>n</noscript><div hidden>h</div><table><tr><td>1<td>2</table></article>"), "a b\n1\n2"),
        ("plain &lt;text&gt; <b>only", "plain <text> only"),
        ("<article><p>" + "<i>" * 3000 + "deep", "deep"),
        ("<p>un<closed", "un<closed"),
        ("<article></article><p>outside</p>", "outside"),
        (page("<article><div class='comment'>c</div><p class=address>kept</p><p class='ad'>gone</p></article>"), "kept"),
        ("", ""),
        ("<script>never closed <p>x</p>", ""),
        ('<article><p class="x>Hello</p><p>there</p></article>', "Hello\nthere"),
        ("<p title='a > b'>in</p> <p title=\"it's\">quotes</p>", "in\nquotes"),
        ("a<!-->b--> c<!--->d<!-- > -->e", "ab--> cde"),
        ("<article><p id='share'>Share price rose</p><div id='share'>Tell others</div></article>", "Share price rose"),
        ("<p>&#" + "0" * 6000 + "65;&#" + "9" * 6000 + ";</p>", "A\ufffd"),
        ("<p class='" + "advert_" * 40 + "!'>kept</p>", "kept"),
        ("<script>x</script <p>y", "y"),
        ("<b><div>one</b>two</div>", "onetwo"),
    ],
)
def test_main_text_of_one_page(source, text):
    assert html_main.main_text(html_main.parse(source), frozenset()) == text


@pytest.mark.parametrize(
    "unit", ["<a ", "<b>", "<div>", '<a "> "', "<ul><li>", "<table><tr><td>", "<b><p>", "</x>", "<!--", "<script </script ", "<x a='", "&#1", "<p a=b c>"]
)
def test_hostile_pages_take_linear_time(unit):
    """Twice the page takes about twice the time: far from the fourfold of a quadratic parser."""

    def seconds(n):
        best = []
        for _ in range(3):
            start = time.process_time()
            html_main.parse(unit * (n // len(unit)) + "</x>" * (n // 40))
            best.append(time.process_time() - start)
        return min(best)

    assert seconds(400_000) < 3.2 * seconds(200_000) + 0.1
    root = html_main.parse(unit * (100_000 // len(unit)))
    html_main.main_text(root, {1})


def test_site_templates_go_and_repeated_pages_stay(spark):
    pages, want = [], []
    for i in range(30):
        host = f"http://{'a' if i % 3 else 'B'}.example.org:80/{i}"
        pages.append((i, host, page(f"<div><p>site line of {i % 3}</p></div><div><p>own words {i}</p><p>more {i}</p></div>"), 1))
        # host a has 20 pages with two template lines of 10 each, host b 10 pages with one
        want.append(f"own words {i}\nmore {i}")
    copy = page("<div><p>one page</p></div><div><p>many copies</p></div>")
    pages += [(100 + i, f"http://copy.org/{i}", copy, 1) for i in range(50)]
    pages += [(200, None, None, 1), (201, None, "", 1), (202, "no host", "<p>x</p>", 1), (0, pages[0][1], pages[0][2], 1)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, TEXT int")
    rows = html_main.extract(frame).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r.text for r in rows}
    assert [got[i] for i in range(30)] == want
    assert all(got[100 + i] == "one page\nmany copies" for i in range(50))
    assert (got[200], got[201], got[202]) == ("", "", "x")
    assert html_main.extract(frame.limit(0)).collect() == []


def texts_of(spark, pages):
    rows = html_main.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == len(pages)
    return {r.page_id: r.text for r in rows}


@pytest.mark.parametrize(
    "source, text",
    [
        (page("<div class='layout with-sidebar'><article><p>A</p></article></div>"), "A"),
        (page("<article class='post comments-open'><p>A</p><div class='ad-banner'>b</div><div class='cookie-notice'>c</div></article>"), "A"),
        (page("<form><nav>n</nav><article><p>A</p><form>f</form><div class=comments><article>c</article></div></article></form>"), "A"),
        (page("<div class=sidebar><article class=promo><p>A</p></article></div>"), "A"),
        (page("<aside><article>teaser</article></aside><article><p>A</p></article>"), "A"),
        (page("<form><article></article></form><p>outside</p>"), "outside"),
    ],
)
def test_main_elements_in_dropped_parts(source, text):
    assert html_main.main_text(html_main.parse(source), frozenset()) == text


def test_site_parts_inside_main_elements_go_by_counts(spark):
    box = "<div class='x1'><p>Tell your friends</p><ul><li>one<li>two</ul></div>"
    pages = [(i, f"http://a.org/{i}", page(f"<article><h1>title {i}</h1><p>own {i}</p>{box}<p>end {i}</p></article>")) for i in range(12)]
    pages += [(50 + i, f"http://b.org/{i}", page(f"<div>menu {i}</div><main><p>same</p>{box}</main>")) for i in range(12)]  # one body under many menus
    pages += [(100, "http://a.org/box", page(f"<article>{box}</article>")), (101, "http://c.org/", page(f"<article><p>own</p>{box}</article>"))]
    got = texts_of(spark, pages)
    assert all(got[i] == f"title {i}\nown {i}\nend {i}" for i in range(12))
    assert all(got[50 + i] == "same\nTell your friends\none\ntwo" for i in range(12))
    assert (got[100], got[101]) == ("Tell your friends\none\ntwo", "own\nTell your friends\none\ntwo")


def test_site_parts_are_a_share_of_the_host(spark):
    box = "<div><h2>Summary</h2><p>our offers</p></div>"
    pages = [(i, f"http://few.org/{i}", page(f"<div><h2>Summary</h2><p>own {i}</p></div>{box}")) for i in range(4)]
    pages += [(100 + i, f"http://many.org/{i}", page(f"<div><h2>Summary</h2><p>own {i}</p></div>{box if i < 10 else ''}")) for i in range(60)]
    got = texts_of(spark, pages)
    assert all(got[i] == f"Summary\nown {i}" for i in range(4))
    assert all(got[100 + i] == f"Summary\nown {i}" + "\nSummary\nour offers" * (i < 10) for i in range(60))


def brute_nearest(rows, k=10):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - good[q]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        out[q] = [(int(ids[j]), float(d[j])) for j in order if ids[j] != q][:k]
    return out


def test_nearest_neighbours_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) + 3 * (i % 5)).tolist()) for i in range(600)]
    rows += [(i, rows[40][1]) for i in range(600, 700)]  # copies of one vector, two of them queries among others
    rows += [(800, None), (820, [0.0] * 16), (840, [float("nan")] + [1.0] * 15), (860, [None] + [1.0] * 15), (880, [1.0] * 3), (None, [1.0] * 16), (900, [float("inf")] * 16)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, Label int")
    exact = brute_nearest([(r.vec_id, r.embedding) for r in frame.collect()])
    got = {}
    for r in hashing_index.search(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(exact)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(a[2] <= b[2] for a, b in zip(found, found[1:]))
        assert all(a[1] < b[1] for a, b in zip(found, found[1:]) if a[2] == b[2])
        hit += len({f[1] for f in found} & {e[0] for e in exact[q]})
    assert hit >= 0.9 * 10 * len(exact)
    assert [f[1] for f in got[40]] == [e[0] for e in exact[40]]


def test_nearest_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = sorted((r["rank"], r.vec_id, r.score) for r in hashing_index.search(few, F.col("vec_id") == 0).collect())
    assert rows == [(1, 2, 0.0), (2, 1, pytest.approx(2**0.5))]
    assert hashing_index.search(few.limit(0), F.lit(True)).collect() == []
    assert hashing_index.search(few.where("vec_id = 1"), F.lit(True)).collect() == []


def test_every_code_within_the_radius_is_found(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 16))
    coder = hashing_index.learn(x, 10)
    codes = coder.codes(x)
    rows = [(int(i), int(c), [int(i)], v.tolist()) for i, (c, v) in enumerate(zip(codes.view(np.int64), x))]
    classes = spark.createDataFrame(rows, "id long, code long, ids array<long>, v array<double>")
    queries = classes.where("id < 20").select(F.col("id").alias("query"), "v", "code")
    for parts in (4, 8):
        found = hashing_index._probe(classes, queries, parts, 20, 499).collect()
        pairs = [(r["query"], r["id"]) for r in found]
        want = {(q, i) for q in range(20) for i in range(500) if np.bitwise_count(codes[q] ^ codes[i]) <= 20}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    chain = list(range(200))
    rng.shuffle(chain)
    links = [(a, b) for a, b in zip(chain, chain[1:])] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (-3, 2000), (2000, -3), (-3, 2000)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(200)}, **{i: 1000 for i in range(1000, 1100)}, -3: -3, 2000: -3}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []




def test_rows_keep_their_roles_and_very_long_texts(spark):
    """A table of turns: roles are values of that table, and no JSON parser limits the text."""
    rows = [(1, 0, "human", "q"), (1, 1, "assistant", "a"), (2, 0, "gpt", None), (3, 0, None, "x")]
    frame = spark.createDataFrame(rows, "c long, turn long, role string, text string")
    frame = frame.unionByName(spark.sql("select 4L as c, 0L as turn, 'assistant' as role, repeat('0123456789', 2100000) as text"))
    out = chat.format_turns(chat.turns_of_columns(frame, "c", "turn"))
    read = out.select("conversation", chat.parse_formatted(F.col("formatted")).alias("t"), F.length(chat.loss_text(F.col("formatted"), F.col("loss_spans"))).alias("n"))
    read = read.select("conversation", F.transform("t", lambda t: F.struct(t["role"], F.length(t["text"]))).alias("t"), "n").collect()
    got = {r.conversation: ([tuple(t) for t in r.t], r.n) for r in read}
    assert got == {1: ([("human", 1), ("assistant", 1)], 1), 2: ([("gpt", 0)], 0), 3: ([("", 1)], 0), 4: ([("assistant", 21_000_000)], 21_000_000)}


def test_columns_choose_layouts_by_their_names(spark):
    rows = spark.sql("select 1 as c, array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'gpt', 'value', 'a')) as conversations, 5 as other")
    turns = chat.turns_of_columns(rows, "c", None).collect()
    assert [(t.position, t.role, t.text, t.layout) for t in turns] == [(0, "user", "q", "conversations"), (1, "assistant", "a", "conversations")]
    assert [t.layout for t in chat.turns_of_columns(spark.sql("select 1 as c, 2 as other"), "c", None).collect()] == [None]
