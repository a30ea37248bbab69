"""A corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Stages read only what their predecessor kept.

Defined results: a document with null text passes the toxicity and decontamination stages and
near-duplicates treat it as a class of its own; of equal rows (id and text) one stays after the
near-duplicate stage, rows with one id and different texts are different documents; a text of which nothing is left stays as an empty one; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import chunks, decontaminate, neardup, pieces, toxicity
from scholia.llm.textkit import cut, read, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score reaches the threshold."""
    small_batches(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model, docs.text) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    small_batches(spark)
    return neardup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; n_chars follows the text."""
    small_batches(spark)
    cleaned = chunks.without_copies(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    small_batches(spark)
    return decontaminate.without_hits(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with their checksum and the proof that they decode to the text."""
    import public_tokenizers

    small_batches(spark)
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("pieces", encode),
]

#: No SQL can express the learnt scores and the hashed signatures; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
