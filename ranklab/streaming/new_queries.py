"""Ranking a stream of new query vectors against stored tag tables.

Tag vectors, their statistics and the documents' tags belong together: they are published as one version, after a check
that the statistics are those of these tags. Every micro-batch takes the newest version as a whole and says in its rows
which one it was, so tables may be renewed while the stream runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ranklab.operators.new_query import checked_stats, rank_new_queries
from ranklab.streaming import versions

PARTS = ("tags", "stats", "doc_tags", "docs")


def publish(path: str, tags: DataFrame, stats: DataFrame | None, doc_tags: DataFrame, docs: DataFrame) -> int:
    """Store tags(tag_id, vec), stats(tag_id, mean, sd; None: raw tags), doc_tags(doc_id, tag_id, score) and docs(doc_id) as
    the newest version; statistics for another tag list are an error. Returns the version."""
    spark = tags.sparkSession
    version = versions.next_version(spark, path)
    held = {"tags": tags, "doc_tags": doc_tags, "docs": docs.select("doc_id")} | ({"stats": checked_stats(stats, tags)} if stats is not None else {})
    for name, df in held.items():
        df.write.mode("overwrite").parquet(f"{versions.folder(path, version)}/{name}")
    versions.switch(spark, path, {"version": version, "parts": list(held)}, [version])
    return version


def published(spark: SparkSession, path: str) -> tuple[int, dict[str, DataFrame | None]]:
    """(version, tables) of the newest version."""
    content = versions.manifest(spark, path)
    if content is None:
        raise FileNotFoundError(f"no tag tables published at {path}")
    return content["version"], {n: spark.read.parquet(f"{versions.folder(path, content['version'])}/{n}") if n in content["parts"] else None for n in PARTS}


def new_query_stream(queries: DataFrame, tables: str, path: str, checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """Each micro-batch of queries(query_id, vec) is ranked as a batch against the tables published at `tables` and written
    to the folder of its batch id, so a replay overwrites its own output. `options` go to `rank_new_queries`."""
    def rank(batch: DataFrame, batch_id: int) -> None:
        version, held = published(batch.sparkSession, tables)
        out = rank_new_queries(batch, held["tags"], held["stats"], held["doc_tags"], held["docs"], **options)
        out.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = queries.writeStream.foreachBatch(rank).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
