"""Cleaning, typing, quality filters and surrogate ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ranklab.operators.ordering import global_rank

ENGAGEMENT_LINE = r"(?i)\s*Engagement duration:[^\n]*$"
GIG_STRUCT = {"budget_lo": "double", "budget_hi": "double", "seniority_needed": "string", "start_by": "string",
              "commitment": "int", "duration_weeks": "double"}
PROVIDER_STRUCT = {"rate_per_hour": "double", "seniority": "string", "available_from": "string", "capacity": "int",
                   "availability": "string"}


def clean_cell(value: Column) -> Column:
    """Trim; drop the quote that guards a spreadsheet formula; the word null becomes empty."""
    trimmed = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")
    unguarded = F.regexp_replace(trimmed, r"^'(?=[=+\-@\t\r])", "")
    return F.when(unguarded == "null", F.lit("")).otherwise(unguarded)


def clean_and_type_table(df: DataFrame, text_cols: Sequence[str], spec: dict[str, str]) -> DataFrame:
    """Clean the text columns; cast the structured columns the table has. An empty cell is NULL, never 0."""
    out = df
    for c in text_cols:
        if c in df.columns:
            out = out.withColumn(c, clean_cell(F.col(c)))
    for c, kind in spec.items():
        if c in df.columns:
            value = F.nullif(clean_cell(F.col(c).cast("string")), F.lit(""))
            typed = value if kind == "string" else value.try_cast("double")
            out = out.withColumn(c, typed.cast("int") if kind == "int" else typed)
    return out


def latest_written_manifest(log: DataFrame) -> DataFrame:
    """Per file the latest written hirer entry; on equal timestamps the later line wins. `max_by` combines
    map-side, so a file with very many entries costs one buffer."""
    rows = log.where((F.col("entity_type") == "HIRER") & (F.col("status") == "written"))
    entry = F.struct("timestamp", "line_no", "repaired", "decision")
    return rows.groupBy("file").agg(
        F.max_by(entry, F.struct(F.coalesce("timestamp", F.lit("")), F.col("line_no"))).alias("e")).select("file", "e.*")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key in source order: the winner's order value is found by a min, so a key that
    repeats on a third of all rows is combined map-side."""
    first = df.groupBy(key).agg(F.min(order).alias(order))
    return df.join(first, [key, order], "left_semi")


def quality_filter_gigs(gigs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Gigs a reviewer kept unrepaired, with a deliverable line, a real industry, no notes and 300-1200 characters
    once the engagement line is gone; then the first row per lower-cased title among those.

    gigs(source_file, row_no, hire_title, hire_description, hire_description_additional_notes, industry)."""
    desc = F.regexp_replace(F.regexp_replace(clean_cell(F.col("hire_description")), ENGAGEMENT_LINE, ""), r"^\s+|\s+$", "")
    rows = gigs.join(manifest.select(F.col("file").alias("source_file"), "decision", "repaired"), "source_file", "left")
    rows = rows.withColumn("hire_title", clean_cell(F.col("hire_title"))).withColumn("hire_description", desc)
    kept = rows.where((F.col("decision") == "keep") & ~F.coalesce("repaired", F.lit(False))
                      & F.contains(F.col("hire_description"), F.lit("Deliverable:"))
                      & ~F.coalesce("industry", F.lit("")).isin("", "OTHER")
                      & (clean_cell(F.col("hire_description_additional_notes")) == "")
                      & F.length("hire_description").between(300, 1200))
    keyed = kept.withColumn("title_key", F.lower("hire_title"))
    return first_per_key(keyed, "title_key", "row_no").drop("title_key", "decision", "repaired").withColumn(
        "hire_description_additional_notes", F.lit(""))


def quality_filter_providers(providers: DataFrame) -> DataFrame:
    return providers.where((F.col("classify_label") == "PROVIDER") & (clean_cell(F.col("about_title")) != "")
                           & (clean_cell(F.col("about_description")) != ""))


def stable_surrogate_ids(df: DataFrame, order_col: str, id_col: str) -> DataFrame:
    """Ids 1..n in the order of a unique string column: ranges, numbered inside and shifted by the rows before."""
    return global_rank(df, order_col, id_col)


def fill_rate_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, filled, total) of the structured columns the table has."""
    present = [c for c in cols if c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in present])
    return counts.unpivot(["total"], present, "column", "filled").select("column", "filled", "total")


def uniqueness_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The text tuples that occur more than once, with their counts. Empty = unique."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, cols: Sequence[str]) -> None:
    bad = uniqueness_check(df, cols).agg(F.count(F.lit(1))).first()[0]
    if bad:
        raise ValueError(f"{bad} duplicated values of {tuple(cols)}")
