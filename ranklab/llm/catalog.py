"""The registered queries of this subpackage and their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ranklab.llm import (bpe, decontaminate, embed_dedup, fill_middle, html_extract, langid, line_dedup, secret_scan, sharding, simhash, spelling,
                         url_filter, warc)
from ranklab.llm.common import table
from ranklab.session import scratch_path, settle

VOCABULARY = "byte_bpe_50k.tiktoken"

URL_RULES = (url_filter.UrlRule("block", "net/"), url_filter.UrlRule("allow", "example.net/en/"),
             url_filter.UrlRule("block", "example.com/de/"), url_filter.UrlRule("allow", "org/fr/"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(settle(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op2_secrets")
def find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


@query("op3_url_filter", url_filter.oracle(URL_RULES))
def judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op4_line_dedup", line_dedup.ORACLE)
def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


@query("op5_decontaminate", decontaminate.ORACLE)
def find_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_html_extract")
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(table(spark, sf_dir, "pages"))


@query("op7_langid")
def identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


@query("op8_embed_dedup", embed_dedup.ORACLE)
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.digest(table(spark, sf_dir, "embeddings"))


@query("op9_simhash")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica in which some records have lost their first letters; lengths stay."""
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 6), 16, 10).cast("long")
    hit = number % 97 == 0
    return records.withColumn("record", F.when(hit, F.overlay("record", F.lit("warc"), F.lit(1))).otherwise(F.col("record")))


@query("op10_warc_fixity", warc.ORACLE)
def audit_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages audited against WARC files that were written with damage and are read back."""
    records = warc.to_records(table(spark, sf_dir, "pages"))
    path = scratch_path(spark, "warc")
    warc.write_warc(damaged(records), path)
    return warc.audit_records(records, warc.read_warc(spark, path))


@query("op11_sharding", sharding.ORACLE)
def deal_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


@query("op12_fill_middle", fill_middle.ORACLE)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants", spelling.ORACLE)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(table(spark, sf_dir, "documents"))
