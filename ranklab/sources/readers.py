"""Readers: entity tables, judgment logs, candidate files, label and list maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ranklab.functions.text import match_text
from ranklab.sources import judgment_log, schemas


def read_entities(spark: SparkSession, path: str, schema: str, fmt: str = "json", multi_line: bool = False) -> DataFrame:
    """Gigs or providers with an explicit schema. JSON lines (or parquet) split across tasks; a single JSON array
    file is read with `multi_line`, which one task has to parse."""
    reader = spark.read.schema(schema)
    if fmt == "json":
        return reader.option("multiLine", multi_line).json(path)
    if fmt == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return reader.format(fmt).load(path)


def taxonomy_overlay(entities: DataFrame, overlay: DataFrame | None, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Structured fields from the overlay table when there is one: an entity the overlay holds takes them from there."""
    if overlay is None:
        return entities
    over = overlay.select(id_col, *[F.col(c).alias(f"o_{c}") for c in cols])
    joined = entities.join(over, id_col, "left")
    return joined.select(*[F.coalesce(f"o_{c}", c).alias(c) if c in cols else F.col(c) for c in entities.columns])


def read_judgment_log(spark: SparkSession, path: str, register: bool = True, ledger: str | None = None) -> DataFrame:
    """Append-only JSONL log; a missing path is an empty log and blank lines are skipped. `seq` is the number a record got
    when it was first seen (`judgment_log`); lines not seen before are numbered first unless `register` is off, as it
    must be for a log that this job may not write beside."""
    if register:
        judgment_log.register(spark, path, ledger)
    return judgment_log.registered(spark, path, ledger)


def read_candidates_csv(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """Candidate rows; an empty cell is NULL, an empty label is unjudged."""
    raw = spark.read.option("header", True).csv(path)
    return type_candidates(raw, features)


def type_candidates(raw: DataFrame, features: Sequence[str]) -> DataFrame:
    cell = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    number = lambda c: cell(c).try_cast("double").alias(c) if c in raw.columns else F.lit(None).cast("double").alias(c)
    return raw.select(F.col("hire_id").cast("bigint").alias("query_id"), F.col("provider_id").cast("bigint").alias("doc_id"),
                      cell("label").try_cast("int").alias("label"), *[number(c) for c in features])


def labels_unnest(df: DataFrame, map_col: str = "labels") -> DataFrame:
    """{query: {doc: value}} -> (query_id, doc_id, value)."""
    outer = df.select(F.explode(map_col).alias("q", "m"))
    return outer.select("q", F.explode("m").alias("d", "value")).select(
        F.col("q").cast("bigint").alias("query_id"), F.col("d").cast("bigint").alias("doc_id"), "value")


def labels_nest(rows: DataFrame, value: str = "grade") -> DataFrame:
    """(query_id, doc_id, value) -> one row per query: (query_id, labels map). One query's labels are a judging
    pool, tens of documents; the outer map is left as rows, so no task holds all queries."""
    entry = F.struct(F.col("doc_id").cast("string"), F.col(value))
    return rows.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("labels"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file {query: {doc: value}} as long rows."""
    text = spark.read.text(path, wholetext=True)
    return labels_unnest(text.select(F.from_json("value", schemas.LABEL_MAP).alias("labels")))


def read_ranked_lists(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file {query: [doc, ...]} as (query_id, doc_id, rank)."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.LIST_MAP).alias("m"))
    rows = text.select(F.explode("m").alias("q", "ids")).select("q", F.posexplode("ids").alias("pos", "doc_id"))
    return rows.select(F.col("q").cast("bigint").alias("query_id"), "doc_id", (F.col("pos") + 1).alias("rank"))


def read_pool_sources(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file {query: {doc: [source, ...]}} as pool(query_id, doc_id, sources)."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.SOURCE_MAP).alias("m"))
    rows = text.select(F.explode("m").alias("q", "docs")).select("q", F.explode("docs").alias("d", "sources"))
    return rows.select(F.col("q").cast("bigint").alias("query_id"), F.col("d").cast("bigint").alias("doc_id"), "sources")


def read_predicted_tags(spark: SparkSession, path: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """A tag file -> (owner, tag_id, score, rank) and (tag_id, mean, sd), the latter empty for a raw file."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.TAG_FILE_MAP).alias("f"))
    tags = text.select(F.explode("f.tags").alias("i", "pairs")).select(F.col("i").cast("bigint").alias(owner), F.posexplode("pairs").alias("pos", "p"))
    tags = tags.select(owner, F.col("p")[0].cast("bigint").alias("tag_id"), F.col("p")[1].alias("score"), (F.col("pos") + 1).alias("rank"))
    stats = text.where(F.col("f.mean").isNotNull()).select(F.explode(F.arrays_zip("f.tag_ids", "f.mean", "f.sd")).alias("s"))
    return tags, stats.select(F.col("s.tag_ids").alias("tag_id"), F.col("s.mean").alias("mean"), F.col("s.sd").alias("sd"))


def gig_text() -> Column:
    return match_text(*schemas.GIG_TEXT)


def provider_text() -> Column:
    """Credentials are left out on purpose: they repeat the description."""
    return match_text(*schemas.PROVIDER_TEXT)
