"""License scan by a positional index of rare words, in DataFrame functions only.

One pass over the texts keeps, for each document, the places of licence words and the key phrases it holds;
document frequencies of those words over all documents give their weights. For each
template whose mandatory phrases it holds, a document then looks up the rarest of the template's words that it has in
the template's postings; word places minus template places that agree mark an alignment.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskweave.llm.tables import literal_rows, small_side, text_key
from riskweave.session import materialise

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Template label, wording, phrases that must occur (any one of each inner tuple).
TEMPLATES = (
    ("mit", "released under the mit license", (("mit license",),)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", (("permission is hereby granted free of charge",),)),
    ("apache", "licensed under the apache license version 2 0", (("apache license",),)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", (("except in compliance with the license",),)),
    ("gpl", "this work is licensed under the gnu general public license version 3", (("general public license",),)),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", (("general public license",), ("free software foundation",))),
    ("lgpl", "licensed under the gnu lesser general public license", (("lesser general public license",),)),
    ("agpl", "licensed under the gnu affero general public license", (("affero general public license",),)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", (("redistribution and use in source and binary forms",),)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", (("for any purpose with or without fee is hereby granted",),)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", (("mozilla public license",),)),
    ("cc-by", "licensed under cc by 4 0", (("cc by 4",),)),
    ("cc-by-nc", "licensed under cc by nc 4 0", (("cc by nc",),)),
    ("unlicense", "this is free and unencumbered software released into the public domain", (("free and unencumbered software",),)),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]


def templates() -> list[Template]:
    return [Template(i, label, tuple(text.split()), phrases) for i, (label, text, phrases) in enumerate(TEMPLATES)]


def vocabulary() -> list[str]:
    """Words of the templates of four letters or more, and the short ones inside mandatory phrases that tell licences apart."""
    return sorted({w for t in templates() for w in t.words if len(w) > 3} | {"mit", "gnu", "cc", "nc"})


def key_phrases() -> list[str]:
    return sorted({p for t in templates() for group in t.phrases for p in group} | set(BASE))


def normal(text: Column) -> Column:
    """The words of a text, lower-cased, with one blank before, between and after them."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), SEPARATORS, " ")


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of a phrase among the words."""
    def here(word, i):
        ok = word == phrase[0]
        for step, other in enumerate(phrase[1:], 1):
            ok = ok & (F.get(words, i + step) == other)
        return F.when(F.coalesce(ok, F.lit(False)), i)

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def _labelled(label: str):
    return lambda at: F.struct(F.lit(label).alias("label"), at.alias("at"))


def evidence(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """``(id, key, n_words, places, phrases, base)``: what the one pass over the texts keeps of each row."""
    norm = docs.select(F.col(row_id).alias("id"), text_key(F.col(text)).alias("key"), normal(F.col(text)).alias("norm"))
    held = F.filter(F.array(*map(F.lit, key_phrases())), lambda p: F.contains(F.col("norm"), F.concat(F.lit(" "), p, F.lit(" "))))
    first = norm.select(
        "id", "key", (F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"), "norm", held.alias("phrases")
    )
    words = F.split(F.substring(F.col("norm"), F.lit(2), F.length("norm") - 2), " ")
    nothing = F.array().cast("array<struct<word:string,at:int>>")
    vocabulary_ = F.array(*map(F.lit, vocabulary()))
    known = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda s: F.array_contains(vocabulary_, s["word"]))
    base = [F.transform(_places(words, p.split()), _labelled(label)) for p, label in BASE.items()]
    some = F.size("phrases") > 0
    present = F.array_intersect(words, vocabulary_)
    return first.select(
        "id",
        "key",
        "n_words",
        "phrases",
        present.alias("present"),
        F.when(some, known).otherwise(nothing).alias("places"),
        F.when(some, F.concat(*base)).otherwise(F.array().cast("array<struct<label:string,at:int>>")).alias("base"),
    )


def scan(docs: DataFrame, row_id: str = "doc_id", text: str = "text", rarest: int = 6, least: float = 0.6) -> DataFrame:
    """One row for each row of ``docs``: ``(row_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    For each template whose phrase groups all occur in a file, the file's ``rarest`` words of highest IDF among the
    template's own are looked up; a template counts when the weight of its words
    found at one offset is at least ``least`` of the weight of those of its words that were looked up or could
    have been. ``score`` is the best such share, 0 without any. Null and empty
    texts have no words, labels or places. Repeated rows each get their row; equal ids with different texts are
    kept apart. Extra columns are ignored.
    """
    table = materialise(evidence(docs, row_id, text), "evidence")
    spark = docs.sparkSession
    counted = table.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = table.agg(F.count("*")).first()[0]
    frequency = {r.word: r.df for r in counted.collect()}  # at most one row per word of the vocabulary


    weight = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) + 1 for w in vocabulary()}
    postings = [(t.number, t.label, w, at) for t in templates() for at, w in enumerate(t.words) if w in weight]
    posting_table = literal_rows(spark, ["template", "label", "word", "place"], postings)

    hits = table.where(F.size("phrases") > 0).select("id", "key", "phrases", F.explode("places").alias("p")).select("id", "key", "phrases", "p.word", "p.at").distinct()
    verified = F.lit(False)
    for t in templates():
        ok = F.lit(True)
        for group in t.phrases:
            ok = ok & F.arrays_overlap("phrases", F.array(*map(F.lit, group)))
        verified = F.when(F.col("template") == t.number, ok).otherwise(verified)
    words_of = literal_rows(spark, ["template", "word", "weight"], sorted({(t, w, weight[w]) for t, _, w, _ in postings}))
    own = hits.select("id", "key", "phrases", "word").distinct().join(F.broadcast(words_of), "word").where(verified)
    ranked = own.withColumn("r", F.row_number().over(W.partitionBy("id", "key", "template").orderBy(F.desc("weight"), "word"))).where(F.col("r") <= rarest)
    looked = ranked.select(F.col("id").alias("i"), F.col("key").alias("k"), F.col("word").alias("w"), "template", "weight")
    matches = (
        hits.join(looked, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & (F.col("word") == F.col("w")))
        .join(F.broadcast(posting_table), ["word", "template"])
        .select("id", "key", "template", (F.col("at") - F.col("place")).alias("offset"), "word", "weight")
        .distinct()
    )
    aligned = matches.groupBy("id", "key", "template", "offset").agg(F.sum("weight").alias("found"))
    best = aligned.groupBy("id", "key", "template").agg(F.max("found").alias("found"))
    # What a template could have reached: its own rarest words, as many as were looked up.
    reach = {t.number: sum(sorted((weight[w] for w in set(t.words) if w in weight), reverse=True)[:rarest]) for t in templates()}
    numbers = literal_rows(spark, ["template", "label", "reach"], [(t.number, t.label, reach[t.number]) for t in templates()])
    share = F.least(F.col("found") / F.col("reach"), F.lit(1.0))
    found = (
        best.join(F.broadcast(numbers), "template")
        .where(share >= least)
        .groupBy(F.col("id").alias("i"), F.col("key").alias("k"))
        .agg(F.collect_set("label").alias("own_labels"), F.max(share).alias("own_score"))
    )
    found = materialise(found, "labels")
    joined = table.join(small_side(found, 64), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    at = F.transform("base", lambda b: b["at"])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("id").alias(row_id),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("own_labels", none))), ",").alias("labels"),
        F.coalesce("own_score", F.lit(0.0)).alias("score"),
    )


__all__ = ["BASE", "evidence", "scan", "templates", "vocabulary", "key_phrases"]
