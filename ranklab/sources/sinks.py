"""Sinks. Outputs are namespaced by dataset and variant, so a baseline is never overwritten by another run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ranked_as_lists(ranked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., query_id, ids): ordered document ids of each (bounded) list."""
    entry = F.struct("rank", "doc_id")
    return ranked.groupBy(*by, "query_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["doc_id"]).alias("ids"))


def sink_ranked_lists(ranked: DataFrame, path: str, system: str, fmt: str = "json") -> None:
    """One record per query, in the folder system=<name>."""
    ranked_as_lists(ranked).write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/system={system}")


def feature_rows(rows: DataFrame, dataset: str, variant: str = "base") -> DataFrame:
    """Candidate rows with the columns their folders are named by."""
    return rows.withColumn("dataset", F.lit(dataset)).withColumn("variant", F.lit(variant)).withColumn(
        "judged", F.col("label").isNotNull())


def sink_features(rows: DataFrame, path: str, dataset: str, variant: str = "base", fmt: str = "parquet") -> None:
    """All candidates and the judged subset; only this dataset's and variant's partitions are replaced."""
    (feature_rows(rows, dataset, variant).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset", "variant", "judged").format(fmt).save(path))


def read_features(spark, path: str, dataset: str, variant: str = "base", judged_only: bool = False) -> DataFrame:
    """The partition filters prune folders; the training subset never reads unjudged files."""
    rows = spark.read.parquet(path).where((F.col("dataset") == dataset) & (F.col("variant") == variant))
    return rows.where(F.col("judged").cast("string") == "true") if judged_only else rows


def sink_log(records: DataFrame, path: str) -> None:
    """Append judgment records as JSON lines."""
    records.write.mode("append").json(path)


def sink_by_system(rows: DataFrame, path: str) -> None:
    """Metric or list tables as parquet partitioned by system."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("system").parquet(path)
