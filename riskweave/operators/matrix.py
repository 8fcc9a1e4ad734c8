"""Feature matrices: fill, scale, label, split, weigh terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.features import ALL_FEATURES, all_features
from riskweave.operators.ranks import shuffled_rank
from riskweave.operators.rules import severity_label
from riskweave.session import materialise

# Words, for each term wanted, that may be as frequent as the last term kept before ties are no longer told apart.
LAST_WORDS = 10


def fill_missing(df: DataFrame, columns) -> DataFrame:
    return df.na.fill(0, list(columns))


def scale_fit(df: DataFrame, columns) -> DataFrame:
    """Mean and sample deviation of each column: one row."""
    measures = []
    for c in columns:
        measures += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
    return df.agg(*measures)


def scale_apply(df: DataFrame, fitted: DataFrame, columns) -> DataFrame:
    """Columns as z-scores under ``fitted``; a column without spread becomes zero."""
    columns = list(columns)
    # ``fitted`` is one row.
    joined = df.crossJoin(F.broadcast(fitted))

    def score(c):
        z = F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__std"))
        return F.coalesce(z, F.lit(0.0))

    return joined.withColumns({c: score(c) for c in columns}).select(*df.columns)


def labelled(samples: DataFrame, names=ALL_FEATURES) -> DataFrame:
    """Features of labelled code with ``label`` from ``severity``."""
    return all_features(samples, names).withColumn("label", severity_label(F.col("severity")))


def from_findings(found: DataFrame, names=ALL_FEATURES) -> DataFrame:
    """Features of each finding's snippet with its label, unscaled."""
    samples = found.withColumn("code", F.coalesce("code_snippet", F.lit("")))
    return fill_missing(labelled(samples, names), names)


def stratified_split(
    df: DataFrame, label: str = "label", id_col: str = "id", test_size: float = 0.2, seed=42
) -> DataFrame:
    """Add ``part``: ``test`` for the first share of each label in hash order, else ``train``.

    Rows without a label are a class of their own.  An empty set raises ``ValueError``.
    """
    if df.isEmpty():
        raise ValueError("no rows to split")
    ranked = shuffled_rank(df, [label], seed, id_col)
    test = F.col("rank") <= F.floor(F.lit(test_size) * F.col("group_size"))
    return ranked.withColumn("part", F.when(test, "test").otherwise("train")).drop("rank", "group_size")


def assemble(df: DataFrame, columns, output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def encode_labels(df: DataFrame, column: str, output: str) -> DataFrame:
    """Classes numbered in alphabetical order."""
    indexer = StringIndexer(inputCol=column, outputCol=output, stringOrderType="alphabetAsc")
    return indexer.fit(df).transform(df).withColumn(output, F.col(output).cast("int"))


class _Terms:
    """Kept terms as a tree over their words, numbered from 1; the root, the empty term, is 0 and -1 is no term.

    What begins a kept term is kept: it is as frequent and sorts before it.
    """

    def __init__(self, terms: list[str], last: list[str] | None = None):
        words = sorted({w for t in terms for w in t.split(" ")})
        number = {t: i for i, t in enumerate(["", *terms])}
        code = {w: i for i, w in enumerate(words)}
        parts = [t.rpartition(" ") for t in terms]
        keys = np.array([number[head] * len(words) + code[word] for head, _, word in parts], np.int64)
        order = np.argsort(keys)
        self.terms, self.words = np.array(["", *terms], object), pa.array(words, pa.string())
        self.keys, self.ends = keys[order], order + 1
        # The words that a longer term may end with; None: all.
        self.last = None if last is None else pa.array(last, pa.string())

    def steps(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(at), -1)
        key = at * len(self.words) + code
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((at >= 0) & (code >= 0) & (self.keys[place] == key), self.ends[place], -1)

    def runs(self, codes: np.ndarray, left: np.ndarray, longest: int):
        """The kept term of 0, 1, ... ``longest`` words that begins at each word; ``left``: words up to the text's end."""
        at = np.zeros(len(codes), np.int64)
        yield at
        for k in range(longest):
            code = np.full(len(codes), -1, np.int64)
            code[: max(0, len(codes) - k)] = codes[k:]
            at = self.steps(at, np.where(left > k, code, -1))
            yield at

    def coded(self, column: pa.Array):
        """Of words joined by blanks: the owner of each word, words up to its text's end, its number in the batch, and the batch's words."""
        column = pc.split_pattern(column, " ")
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        left = np.cumsum(counts)[owner] - np.arange(len(owner))
        found = column.flatten().dictionary_encode()
        return owner, left, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary

    def codes(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _run_counts(words: DataFrame, held, n: int) -> DataFrame:
    """``term, total``: runs of ``n`` words whose first ``n - 1`` are a kept term, counted by Arrow batch."""

    def run(batches):
        terms = held.value
        for batch in batches:
            _, left, number, names = terms.coded(batch["w"])
            if not len(number):
                continue
            *_, head = terms.runs(terms.codes(names)[number], left, n - 1)
            ends = np.ones(len(names), bool) if n == 1 or terms.last is None else pc.is_in(names, terms.last).to_numpy(zero_copy_only=False)
            at = np.flatnonzero((head >= 0) & (left >= n))
            at = at[ends[number[at + n - 1]]]
            key, total = np.unique(head[at] * len(names) + number[at + n - 1], return_counts=True)
            last = names.take(pa.array(key % len(names)))
            if n > 1:
                last = pc.binary_join_element_wise(pa.array(terms.terms[key // len(names)], pa.string()), last, " ")
            yield pa.RecordBatch.from_arrays([last, pa.array(total, pa.int64())], ["term", "total"])

    return words.select("w").mapInArrow(run, "term string, total long").groupBy("term").agg(F.sum("total").alias("total"))


def _term_counts(words: DataFrame, id_col: str, held, longest: int) -> DataFrame:
    """``id, number, tf``: how often each kept term stands in each row of ``words``."""

    def run(batches):
        terms = held.value
        for batch in batches:
            owner, left, number, names = terms.coded(batch["w"])
            _, *found = terms.runs(terms.codes(names)[number], left, longest)
            key = np.concatenate([(owner * len(terms.terms) + at)[at > 0] for at in found])
            key, tf = np.unique(key, return_counts=True)
            rows, term = key // len(terms.terms), key % len(terms.terms)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(term, pa.int32()), pa.array(tf, pa.int64())], [id_col, "number", "tf"])

    schema = T.StructType([words.schema[id_col], T.StructField("number", T.IntegerType()), T.StructField("tf", T.LongType())])
    counted = words.select(id_col, "w").mapInArrow(run, schema)
    return counted.groupBy(id_col, "number").agg(F.sum("tf").alias("tf"))


def frequent_terms(words: DataFrame, max_features: int, longest: int) -> list[str]:
    """The most frequent runs of 1 to ``longest`` neighbours in ``w``, words joined by blanks; equals in order of the term.

    A run is no more frequent than its beginning or its last word, and sorts after its beginning.  So runs of one word
    are counted first, and of the longer ones only those that go on from a kept one and end with a word as frequent as
    the last one kept; words that tie with it are only told apart while they are few.
    """
    context = words.sparkSession.sparkContext
    kept, singles, last = None, None, None
    names: list[str] = []
    for n in range(1, longest + 1):
        held = context.broadcast(_Terms(names, last))
        counts = _run_counts(words, held, n)
        if n == 1:
            counts = singles = materialise(counts, "word-counts")
        both = counts if kept is None else kept.unionByName(counts)
        kept = materialise(both.orderBy(F.desc("total"), "term").limit(max_features), "terms")
        held.unpersist()
        found = kept.orderBy(F.desc("total"), "term").collect()  # at most max_features rows
        names = [r["term"] for r in found]
        if not names:
            break
        if len(names) == max_features:
            common = singles.where(F.col("total") >= found[-1]["total"]).limit(LAST_WORDS * max_features + 1).collect()
            last = [r["term"] for r in common] if len(common) <= LAST_WORDS * max_features else None
    return names


def tf_idf(
    documents: DataFrame, id_col: str, text_col: str, max_features: int = 1000, longest: int = 3
) -> DataFrame:
    """``id, term, weight`` for word 1- to ``longest``-grams: the most frequent terms, smoothed
    idf, rows of unit length.

    Texts are cut into words once and written.  The kept terms, at most ``max_features``, are the bound of the
    broadcasts; only counts of kept terms are shuffled by document.
    """
    spark = documents.sparkSession
    # Words hold no blank, so a text's words travel as one string; null where there is none.
    found = F.regexp_extract_all(F.lower(text_col), F.lit(r"(?U)\b\w\w+\b"), 0)
    words = materialise(documents.select(F.col(id_col), F.nullif(F.array_join(found, " "), F.lit("")).alias("w")), "words")
    names = frequent_terms(words, max_features, longest)
    held = spark.sparkContext.broadcast(_Terms(names))
    counted = materialise(_term_counts(words, id_col, held, longest), "counts")
    total = documents.agg(F.count("*")).first()[0]
    spread_of = counted.groupBy("number").agg(F.count("*").alias("df"))
    terms = spark.createDataFrame(list(enumerate(names, 1)), "number int, term string")
    idf = spread_of.join(F.broadcast(terms), "number").select("number", "term", (F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    raw = counted.join(F.broadcast(idf), "number").withColumn("raw", F.col("tf") * F.col("idf"))
    rows = raw.groupBy(id_col).agg(F.collect_list(F.struct("term", "raw")).alias("row"))
    norm = F.sqrt(F.aggregate("row", F.lit(0.0), lambda acc, x: acc + x["raw"] * x["raw"]))
    return rows.withColumn("norm", norm).select(
        id_col, F.inline(F.transform("row", lambda x: F.struct(x["term"].alias("term"), (x["raw"] / F.col("norm")).alias("weight"))))
    )
