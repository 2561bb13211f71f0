"""A training corpus from raw documents: language identification, removal of repeated passages, near-duplicate removal,
benchmark decontamination and tokenisation. Each stage reads what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ranklab.llm import bpe, decontaminate, langid, line_dedup, simhash
from ranklab.llm.catalog import VOCABULARY
from ranklab.llm.common import table, written
from ranklab.session import settle

#: The language model and the tokenizer have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known to a model learned from the training fold of `docs`."""
    return langid.drop_rejected(docs, langid.fit(docs))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages of several lines out of a document if they stand in an earlier one. `n_chars` follows the text;
    documents of which nothing is left go, documents that were empty before stay."""
    out = line_dedup.dedup_lines(docs, removed_col="_removed")
    return (out.filter((F.col("_removed") == 0) | (F.col("text") != "")).drop("_removed")
            .withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group."""
    return simhash.drop_near_duplicates(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents left."""
    return bpe.round_trip_digests(docs, bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = table(settle(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
