import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskweave.functions import text as helpers
from riskweave.functions.pystr import PY_SPACE, java_regex, py_fixed, py_strip
from riskweave.operators import evidence, pii

TEXTS = [
    "Email: test@example.com, Phone: (555) 123-4567",
    "ssn 123-45-6789 mac 00:1B:44:11:3A:B7 user='bob' pass = \"x\" cc 4111-1111-1111-1111 ip 10.0.0.1",
    "$1 \\ a@b.co $0",
    "",
    "no data at all",
    "two a.b@c.org,d@e.fr and 555.123.4567\n1-555-123-4567 +1 555 123 4567",
    "é1.2.3.4 and 1.2.3.4é; userm = 'q' passw='p' password='zz' username = 'u'",
    "\ue000a@b.co\ue001 4111111111111111",
    "١٢٣-٤٥-٦٧٨٩",
]
# The redacted forms of the first four.
REDACTED = [
    "Email: te************om, Phone: (55*********67",
    "ssn 12*******89 mac 00*************B7 us******b' pa******x\" cc 41***************11 ip 10****.1",
    "$1 \\ a@**co $0",
    "",
]


def table(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def mask(match):
    found = match.group(0)
    return "*" * len(found) if len(found) <= 4 else found[:2] + "*" * (len(found) - 4) + found[-2:]


def test_redaction(spark):
    got = {r.id: r.t for r in table(spark).select("id", pii.redact(F.col("text")).alias("t")).collect()}
    assert [got[i] for i in range(len(REDACTED))] == REDACTED
    for i, text in enumerate(TEXTS):
        for pattern in pii.PII_PATTERNS.values():
            text = re.sub(pattern, mask, text, flags=re.I)
        assert got[i] == text
    assert table(spark).select(pii.redact(F.col("text"), "#")).first()[0].startswith("Email: te####")


def test_detection_equals_findall(spark):
    got = {}
    for r in pii.detect(table(spark)).orderBy("id", "pii_type", "match_no").collect():
        got.setdefault((r.id, r.pii_type), []).append(tuple(r.groups) if r.groups else r.match)
    want = {
        (i, kind): re.findall(pattern, text, re.I)
        for i, text in enumerate(TEXTS)
        for kind, pattern in pii.PII_PATTERNS.items()
        if re.findall(pattern, text, re.I)
    }
    assert got == want
    types = {r.id: set(r.m) for r in table(spark).select("id", pii.pii_map(F.col("text")).alias("m")).collect()}
    assert types == {i: {k for j, k in want if j == i} for i in range(len(TEXTS))}


def test_hash(spark):
    got = [r[0] for r in table(spark).orderBy("id").select(pii.hash_sensitive(F.col("text"), "s")).collect()]
    assert got == [hashlib.sha256((t + "s").encode()).hexdigest()[:16] for t in TEXTS]


def test_evidence_equals_finditer(spark):
    code = "a = 1\npassword =\n  'x{y}'; PASSWORD='z'\ntry:\n  eval (q); eval(\nexcept\n :\n  md5(x)\ue000\nos.system(1)\ncur.execute('%s')\n"
    texts = [code, "", "nothing", code * 30]
    for kind, (pattern, template) in evidence.EVIDENCE_RULES.items():
        got = {r.id: r.e for r in table(spark, texts).select("id", evidence.evidence(F.col("text"), F.lit(kind)).alias("e")).collect()}
        for i, text in enumerate(texts):
            want = [
                f"Line {text[: m.start()].count(chr(10)) + 1}: " + template.replace("{match}", m.group(0).strip())
                for m in re.finditer(pattern, text, re.I | re.M)
            ]
            assert got[i] == want, kind
    assert table(spark, texts).select(evidence.evidence(F.col("text"), F.lit("exec_usage"))).first()[0] == []


def test_python_string_semantics(spark):
    assert set(PY_SPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    texts = ["\x1c a \u2003", "\u200b x", "\n\n", "a"]
    got = [r[0] for r in table(spark, texts).orderBy("id").select(py_strip(F.col("text"))).collect()]
    assert got == [t.strip() for t in texts]
    assert java_regex(r"[^\s/]\s\\s") == r"(?idU)[^\s\x1c-\x1f/][\s\x1c-\x1f]\\s"


def test_fixed_point_text(spark):
    values = [0.25, 0.75, 6.55, 0.15, 1.05, 2.675, 1e15, 123456.05, -0.04, -6.55, 0.0, 59.95]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 3):
        got = [tuple(r) for r in rows.select("x", py_fixed(F.col("x"), digits)).collect()]
        assert got == [(v, f"{v:.{digits}f}") for v in values]


@pytest.mark.parametrize(
    "size, text", [(0, "0B"), (1, "1.0B"), (1023, "1023.0B"), (1280, "1.2KB"), (1024**2, "1.0MB"), (5 * 1024**5, "5120.0TB")]
)
def test_sizes(spark, size, text):
    assert spark.range(1).select(helpers.format_file_size(F.lit(size))).first()[0] == text


def test_durations_names_and_checks(spark):
    one = spark.range(1)
    value = lambda column: one.select(column).first()[0]
    assert [value(helpers.format_duration(F.lit(s))) for s in (5.04, 60.0, 3599.9, 7200.0)] == ["5.0s", "1.0m", "60.0m", "2.0h"]
    assert value(helpers.sanitize_filename(F.lit(' .a<b>:"/\\|?*c. '))) == "a_b_______c".replace("_______", "_" * 8)[:3] + "_" * 8 + "c"
    assert value(helpers.sanitize_filename(F.lit(" .. "))) == "untitled"
    assert value(helpers.safe_divide(F.lit(1.0), F.lit(0.0), 9.0)) == 9.0
    assert value(helpers.clamp(F.lit(7.0), 1.0, 5.0)) == 5.0
    assert value(helpers.is_valid_email(F.lit("a.b@c.org"))) and not value(helpers.is_valid_email(F.lit("a@b")))
    assert value(helpers.is_valid_url(F.lit("https://x.y/z"))) and not value(helpers.is_valid_url(F.lit("http://ab c d")))
    assert value(helpers.truncate_string(F.lit("abcdefgh"), 6)) == "abc..."
    assert value(helpers.truncate_string(F.lit("abcdefgh"), 2)) == "abcdefgh"[: 2 - 3] + "..."
    for path, ok in {"a/b.PY": True, "b.py.txt": False, ".py": False, "a.b/c": False}.items():
        assert value(helpers.has_extension(F.lit(path), [".py"])) is ok


def test_flatten_round_trip(spark):
    nested = spark.range(2).select("id", F.struct(F.struct(F.lit(1).alias("c")).alias("b"), F.lit("x").alias("d")).alias("a"))
    flat = helpers.flatten_columns(nested)
    assert flat.columns == ["id", "a.b.c", "a.d"]
    assert helpers.unflatten_columns(flat).collect() == nested.collect()
