"""Line dedup within one edit, by joining deletion neighbourhoods.

Two lines are near if they are equal or one insertion, deletion or substitution of a character turns one into
the other. A line is deleted if an earlier line, anywhere in the corpus, is near it; earlier means smaller
``(doc_id, text key, line number)``.

Equal lines become one class. Two classes within one edit agree on one of two aligned halves, and on all but one of
four aligned quarters, so a line whose halves nobody shares, or whose three-quarter keys nobody shares, has no partner
and emits nothing more. The others emit a hashed key for each variant with one character deleted, in the quarters in
question: lines with the same variant and the same place of deletion differ by a substitution there, and a variant
equal to a whole line is a deletion. Each group of equal variants is joined to its earliest member only, which for
lines that agree but for one place is near every other; the edit distance of each joined pair is verified.

Hashes and places of all lines are written once; classes are counted on plain numbers, and only lines of classes that
repeat or may be near are looked at again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.tables import BROADCAST_BYTES, free_name, small_side, text_key
from riskweave.llm import textbytes
from riskweave.llm.textbytes import mix, powers
from riskweave.session import materialise

QUARTERS = 4
HALVES = ["k0", "k1", "k2", "k3"]


def _lines(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """``(d, t, n, line)``: document id, text key, line number from 0, line without carriage return."""
    return docs.select(
        F.col(row_id).cast("long").alias("d"), text_key(F.col(text)).alias("t"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("n", "line")
    )


def _class(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _long(line: Column, min_chars: int) -> Column:
    return F.length(F.trim(line)) >= min_chars


def _eligible(lines: DataFrame, min_chars: int, exact_chars: int | None) -> DataFrame:
    """Lines that are judged: for near repeats, or for exact ones only; those without a visible character never are if ``exact_chars`` is given."""
    long = _long(F.col("line"), min_chars)
    return lines.where(long if exact_chars is None else long | _long(F.col("line"), exact_chars) & F.col("line").rlike(r"[^\s\p{Z}]"))


def _first_id() -> Column:
    """The id, or what stands for a null id, which comes first."""
    return F.coalesce(F.col("d"), F.lit(-(2**63)))


def _half_keys(line: Column, size: Column) -> list[Column]:
    """Hashes of both halves of the line, as the shorter and as the longer line of a pair, whose cut is the shorter's."""
    keys = []
    for shorter in (size, size - 1):
        cut = F.shiftright(shorter, 1)
        left, right = F.substring(line, F.lit(1), cut), F.substring(line, size - shorter + cut + 1, shorter - cut)
        keys += [F.xxhash64(F.lit(0), shorter, left), F.xxhash64(F.lit(1), shorter, right)]
    return keys


def _quarter_keys(line: Column, size: Column) -> Column:
    """Hashes of the line without each of its quarters, as the shorter and as the longer line of a pair.

    The shorter line's length fixes the cuts: what stands before the left-out quarter counts from the left,
    what stands after it from the right.
    """
    keys = []
    for shorter in (size, size - 1):
        cut = [F.floor(shorter * i / QUARTERS).cast("int") for i in range(QUARTERS + 1)]
        for i in range(QUARTERS):
            left = F.substring(line, F.lit(1), cut[i])
            tail = (shorter - cut[i + 1]).cast("int")
            right = F.substring(line, (size - tail + 1).cast("int"), tail)
            value = F.xxhash64(F.lit(i), shorter, left, F.lit("|"), right)
            keys.append(F.struct(F.lit(i).alias("part"), shorter.cast("int").alias("size"), value.alias("value")))
    return F.array(*keys)


def _variants(frames):
    """For each survivor and quarter: a hash of the line without each character of that quarter.

    ``place`` is the place of the deletion for a substitution, and -1 where a variant must equal a whole line.
    """
    for f in frames:
        blocks = []
        for h1, h2, line, parts in zip(f["h1"], f["h2"], f["line"], f["parts"]):
            code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            size = len(code)
            up, down = powers(size + 2)
            values = mix(code + np.uint64(1)) * up[:size]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
            total = sums[-1]
            blocks.append(([h1], [h2], mix(total[None] + np.uint64(size)).view(np.int64), np.array([-1]), np.array([True])))
            for p in parts:
                shorter = p["size"]
                edges = [shorter * i // QUARTERS for i in range(QUARTERS + 1)]
                first, last = edges[p["part"]], size - (shorter - edges[p["part"] + 1])
                at = np.arange(first, last)
                if not len(at):
                    continue
                # Left of the place unchanged; right of it one place to the left.
                value = sums[at] + (total - sums[at + 1]) * down[1]
                value = mix(value + np.uint64(size - 1)).view(np.int64)
                place = at if shorter == size else np.full(len(at), -1)
                blocks.append(([h1] * len(at), [h2] * len(at), value, place, np.zeros(len(at), bool)))
                if sum(len(b[2]) for b in blocks[-64:]) > 200_000:
                    yield _frame(blocks)
                    blocks = []
        if blocks:
            yield _frame(blocks)


def _frame(blocks) -> pd.DataFrame:
    return pd.DataFrame({name: np.concatenate([b[i] for b in blocks]) for i, name in enumerate(("h1", "h2", "variant", "place", "whole"))})


def _shared(keyed: DataFrame, key: str, name: str) -> DataFrame:
    """``keyed`` without the rows whose key only one row has."""
    shared = materialise(keyed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), name)
    return keyed.join(small_side(shared, 8), key)


def _near(lines: DataFrame, places: DataFrame, classes: DataFrame) -> DataFrame:
    """``(h1, h2)`` of the classes with an earlier line within one edit."""
    halves = classes.select("h1", "h2", F.explode(F.array(*HALVES)).alias("half")).where("half is not null")
    survivors = materialise(_shared(halves, "half", "halves").select("h1", "h2").distinct(), "survivors")
    # The earliest place of each class left, and the line there; a repeated row may hold it twice.
    own = classes.select("h1", "h2", "d0").join(small_side(survivors, 16), ["h1", "h2"], "left_semi")
    firsts = places.join(small_side(materialise(own, "own"), 24), ["h1", "h2"]).where(_first_id() == F.col("d0"))
    firsts = materialise(firsts.groupBy("h1", "h2").agg(F.min(F.struct("d", "t", "n")).alias("first")), "firsts")
    here = (F.col("d").eqNullSafe(F.col("first.d"))) & (F.col("t") == F.col("first.t")) & (F.col("n") == F.col("first.n"))
    texts = lines.join(small_side(firsts, 48), ["h1", "h2"]).where(here).dropDuplicates(["h1", "h2"]).select("h1", "h2", "first", "line")
    texts = materialise(texts, "half_texts")

    keyed = texts.select("h1", "h2", F.explode(_quarter_keys(F.col("line"), F.length("line"))).alias("k")).select("h1", "h2", "k.part", "k.size", "k.value")
    parts = _shared(keyed, "value", "quarters").groupBy("h1", "h2").agg(F.collect_set(F.struct("part", "size")).alias("parts"))
    texts = materialise(texts.join(parts, ["h1", "h2"]), "survivor_texts")
    variants = texts.select("h1", "h2", "line", "parts").mapInPandas(textbytes.released(_variants), "h1 long, h2 long, variant long, place long, whole boolean")
    variants = materialise(variants.join(texts.select("h1", "h2", "first"), ["h1", "h2"]), "variants")
    member = F.struct("first", "h1", "h2")
    swapped = variants.where("place >= 0")
    leaders = swapped.groupBy("variant", "place").agg(F.min(member).alias("leader"), F.count("*").alias("n")).where("n > 1")
    substituted = swapped.join(leaders.drop("n"), ["variant", "place"]).select(member.alias("x"), F.col("leader").alias("y"))
    full = variants.where("whole").select("variant", member.alias("y")).distinct()
    deleted = variants.where("place < 0 and not whole").select("variant", member.alias("x")).join(full, "variant").drop("variant")
    pairs = substituted.unionByName(deleted).where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    side = lambda c: texts.select(F.col("h1").alias(f"{c}1"), F.col("h2").alias(f"{c}2"), F.col("line").alias(f"{c}_line"))
    pairs = pairs.select("x", "y", F.col("x.h1").alias("x1"), F.col("x.h2").alias("x2"), F.col("y.h1").alias("y1"), F.col("y.h2").alias("y2"))
    checked = pairs.join(side("x"), ["x1", "x2"]).join(side("y"), ["y1", "y2"]).where(F.levenshtein("x_line", "y_line", 1).between(0, 1))
    return checked.select(F.col("x1").alias("h1"), F.col("x2").alias("h2")).distinct()


def _gone(docs: DataFrame, row_id: str, text: str, min_chars: int, exact_chars: int | None) -> DataFrame:
    """``(d, t, exact, near)`` for the documents that lose lines."""
    lines = _eligible(_lines(docs, row_id, text), min_chars, exact_chars).select("d", "t", "n", *_class(F.col("line")), "line")
    long = _long(F.col("line"), min_chars)
    halves = [F.when(long, key).alias(name) for name, key in zip(HALVES, _half_keys(F.col("line"), F.length("line")))]
    places = materialise(lines.select("d", "t", "n", "h1", "h2", *halves), "places")
    counted = places.groupBy("h1", "h2").agg(F.min(_first_id()).alias("d0"), F.count("*").alias("c"), *[F.min(k).alias(k) for k in HALVES])
    classes = materialise(counted, "classes")
    near = materialise(_near(lines, places, classes).withColumn("near", F.lit(True)), "near")
    judged = classes.join(small_side(near, 17), ["h1", "h2"], "left").where("c > 1 or near")
    judged = materialise(judged.select("h1", "h2", "d0", F.coalesce("near", F.lit(False)).alias("near")), "judged")
    rows = places.select("d", "t", "n", "h1", "h2").join(small_side(judged, 25), ["h1", "h2"]).withColumn("later", _first_id() != F.col("d0"))
    # Places under the class's first id: only they can be its earliest place.
    early = materialise(rows.where("not later"), "early")
    firsts = early.groupBy("h1", "h2").agg(F.min(F.struct("d", "t", "n")).alias("first"))
    early = early.join(firsts, ["h1", "h2"]).withColumn("later", F.struct("d", "t", "n") != F.col("first")).drop("first")
    gone = rows.where("later").unionByName(early.where("near or later")).select("d", "t", "n", "later").distinct()
    number = lambda wanted: F.array_sort(F.collect_list(F.when(wanted, F.col("n"))))
    return gone.groupBy("d", "t").agg(number(F.col("later")).alias("exact"), number(~F.col("later")).alias("near"))


def find(docs: DataFrame, row_id: str = "doc_id", text: str = "text", min_chars: int = 30, exact_chars: int | None = None) -> DataFrame:
    """``docs`` with ``n_lines``, ``exact`` and ``near`` (numbers, from 0, of the lines that go, and why) in order.

    Lines of fewer than ``min_chars`` characters between outer blanks stay, and so do blank ones; with ``exact_chars``,
    those that have so many characters at least go as exact repeats, and are never near. Null texts have one empty line.
    Rows that repeat an id and a text are one document seen twice and lose the same lines; equal ids with other texts are
    documents of their own; a null id comes first; ids are whole numbers. Columns of the new names are replaced.
    """
    gone = materialise(_gone(docs, row_id, text, min_chars, exact_chars), "gone")
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "exact", "near") or c in (row_id, text)]
    none = F.array().cast("array<int>")
    at, other = free_name(docs.columns, "_at"), free_name(docs.columns, "_gone")
    given = docs.select(*kept, F.struct(F.col(row_id).cast("long").alias("d"), text_key(F.col(text)).alias("t")).alias(at))
    # Some 40 bytes a row and four for each line.
    bytes_ = gone.agg(F.sum(4 * F.size("exact") + 4 * F.size("near") + 96)).first()[0] or 0
    gone = gone.select(F.struct("d", "t").alias(other), "exact", "near")
    joined = given.join(F.broadcast(gone) if bytes_ <= BROADCAST_BYTES else gone, F.col(at).eqNullSafe(F.col(other)), "left")
    plain = F.coalesce(F.col(text), F.lit(""))
    return joined.select(
        *kept,
        (F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
        F.coalesce("exact", none).alias("exact"),
        F.coalesce("near", none).alias("near"),
    )


def left_over(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers; a text that loses none is not taken apart."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    # Bound to a variable, so that the text is split once and not for every line.
    bound = F.array(F.struct(lines.alias("lines"), kept.alias("kept")))
    joined = F.transform(bound, lambda s: F.array_join(F.transform(s["kept"], lambda i: F.get(s["lines"], i)), "\n"))
    return F.when(F.size(gone) == 0, text).otherwise(F.get(joined, F.lit(0)))


def remove(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` without the lines that go; documents that lose lines and keep none but blank ones are dropped."""
    gone = F.array_union("exact", "near")
    out = found.withColumn(text, left_over(F.col(text), gone))
    return out.where((F.size(gone) == 0) | (F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")) != ""))
