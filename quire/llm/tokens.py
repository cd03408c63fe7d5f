"""Problem 7 as queries: token ids of every document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import DEFAULT_VOCABULARY, encoder
from quire.session import load


def token_ids(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """ARRAY<INT> of token ids, without special tokens; empty for null and for empty text.

    The vocabulary file must be at the same path on every executor.  Each Python
    worker builds the tables once and keeps the ids of words it has seen.
    """

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for value in batch:
                s = value.as_py()
                if s:
                    flat += encode(s)
                ends.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return ids(text)


def token_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """INT number of token ids, 0 for null; the ids themselves never leave the worker."""

    @F.arrow_udf("int")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = encoder(vocabulary).count
        for batch in batches:
            yield pa.array([count(s) if (s := v.as_py()) else 0 for v in batch], pa.int32())

    return counts(text)


def token_text(ids: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """STRING of token ids; '' for an empty list, NULL for NULL."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = encoder(vocabulary).decode
        for batch in batches:
            yield pa.array([None if (i := v.as_py()) is None else decode(i) for v in batch], pa.string())

    return texts(ids)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids) of each document by byte_bpe_50k."""
    return load(spark, d, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n_tokens, restored BOOLEAN): each document encoded and decoded again."""
    return (
        load(spark, d, "documents")
        .select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), token_ids(F.col("text")).alias("ids"))
        .select("doc_id", F.size("ids").alias("n_tokens"), (token_text(F.col("ids")) == F.col("_text")).alias("restored"))
    )
