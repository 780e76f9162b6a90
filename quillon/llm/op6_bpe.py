"""BPE encoding and decoding by speculate and verify (see bpe.py for the method)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import encoder
from quillon.llm.common import keep_columns, small_batches, table


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: (id, ids array<int>). A null text is an empty one: no ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "ids": pd.Series(enc.encode(pdf[text_col].fillna("").tolist()), dtype=object)})

    kind = docs.schema[id_col].dataType.simpleString()
    return keep_columns(docs, id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(ids: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """Texts of id arrays: (id, text). Ids outside the vocabulary fail; bytes that aren't UTF-8 become U+FFFD."""
    small_batches(ids.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "text": [enc.decode([] if x is None else list(x)) for x in pdf["ids"]]})

    kind = ids.schema[id_col].dataType.simpleString()
    return keep_columns(ids, id_col, "ids").mapInPandas(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: (id, n_tokens, ids_sha256, decoded_sha256).

    Null text: as empty (no ids, digests of the empty string). Repeated rows: one result each. Rows never
    meet each other, so hot keys and copies cost nothing extra; a very long text is encoded block by block.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        names = [str(i) for i in range(enc.table.size)]
        for pdf in batches:
            rows = []
            for i, ids in zip(pdf[id_col], enc.stream(pdf[text_col].fillna("").tolist()), strict=True):
                listed = ",".join([names[t] for t in ids])
                rows.append((i, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return keep_columns(docs, id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", F.col("n_tokens").cast("long"), "ids_sha256", "decoded_sha256"
    )
