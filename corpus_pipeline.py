"""From raw documents to packed token sequences: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import decontaminate, language, line_dedup, minhash, packing
from riskweave.llm.tables import free_name
from riskweave.session import materialise, tune


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach; texts without a letter and undecided ones go."""
    tune(spark)
    model = language.train(docs.where(language.in_training(docs["doc_id"])))
    answer, share = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")
    found = language.answered(docs, model, "text", answer, share)
    # A posterior of one half or more: one language is likelier than all others together.
    return found.where((F.col(answer) != language.UNKNOWN) & (F.col(share) >= 0.5)).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat or nearly repeat an earlier line; those left without text go.

    Every line that is not blank is judged, those of fewer than 30 characters as exact repeats only.
    """
    found = line_dedup.find(_packed(docs), exact_chars=1)
    return _unpacked(_counted(line_dedup.remove(found), docs), docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    found = decontaminate.find(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(decontaminate.remove(found), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each a sequence whose length is a power of two, with their token ids."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


#: The documents' other columns travel as one, out of reach of the operators' own column names.
REST = "document_columns"


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]).alias(REST))


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"{REST}.`{c}`") for c in docs.columns])


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """``n_chars``, if the documents have it, counted anew."""
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn(REST, F.col(REST).withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]
#: Tokenizer, classifier and similarity search have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
