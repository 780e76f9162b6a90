"""The corpus pipeline: five stages over documents, each one operator's decision.

Every stage takes (spark, docs, sf_dir) and returns all documents it keeps, with the columns of documents;
the last returns pieces of packed sequences.

What holds of every stage: other columns than those of documents are left out, so none can clash; a row is judged by
its own text, even if its id is null or repeated; rows repeated whole have one fate (of those, near dedup keeps one);
texts of any length are read whole; ties go to the smaller doc_id, then to the smaller digest of the text; an
empty table gives an empty one. What holds of one stage alone is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import op1_packing, op4_secrets, op7_minhash, op8_langid, op9_lines
from quillon.llm.common import materialise_alone

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose likeliest language is less sure than this is rejected.
LEAST_SCORE = 0.5
#: The posterior of any longer text is near 1. So a document is rejected, too, whose n-grams have a mean
#: log-probability lower by this (in nats) than the text its language was learned from.
LEAST_FIT = -3.5
#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without text or of no sure language go, and those whose n-grams are not like
    the language's; lang becomes the predicted one. Without any labelled row there is nothing to judge by:
    documents without a letter go, the others stay as they are. A null lang is not learned from; a null or empty
    text has no letter. Repeated rows count as often in what is learned."""
    model = op8_langid.train(docs)
    told = op8_langid.label(docs.select(*COLUMNS), model, fit_col="lang_fit")
    if not model[0]:
        return told.filter(F.col("lang_fit").isNotNull()).select(*COLUMNS)
    sure = (F.col("lang_pred") != op8_langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE) & (F.col("lang_fit") >= LEAST_FIT)
    return told.filter(sure).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, by doc_id (null first) and place; so does a document all of whose lines
    did. A null text stays, as does a text without a word. n_chars is counted anew."""
    cut = op9_lines.dedup(docs.select(*COLUMNS))
    return _with_text(cut.filter((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines"))))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8. Rows that repeat an
    id are judged by their own texts; of rows repeated whole one stays. A null or empty text, or one without words, has
    no copies and stays, as does a row without an id."""
    return op7_minhash.remove(docs.select(*COLUMNS), words=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values that look live are masked; copied examples and all documents stay. A null source is one owner. A
    null text stays null. n_chars is counted anew."""
    return _with_text(op4_secrets.mask_live(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences, without their ids. A null text is packed as an empty one, its end id alone; every
    row is packed, repeated ones too."""
    return op1_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a Parquet table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, name)
    return STAGES[-1][1](spark, docs, sf_dir)
