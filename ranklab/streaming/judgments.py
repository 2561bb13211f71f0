"""The grade log as a stream.

Labels stand in buckets by pair. A micro-batch reduces its records to one row per pair, merges them with the buckets they
fall into, writes these buckets anew and switches the manifest, so a reader sees a batch wholly or not at all, and the
number of files does not grow with the number of batches. A batch that is played again after its switch changes nothing;
one that died before it writes its folder anew. Merging goes by sequence number, first or last wins, so batch borders and
late records make no difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ranklab.operators.labels import ok_records
from ranklab.session import checkpoint as table_checkpoint, union_all
from ranklab.streaming import versions

PAIR = ["query_id", "doc_id"]
RULES = {"first": F.min_by, "last": F.max_by}
STATE = "query_id BIGINT, doc_id BIGINT, seq BIGINT, grade INT"


def merge_records(rows: DataFrame, rule: str) -> DataFrame:
    """(query_id, doc_id, seq, grade): the winning record of every pair."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {sorted(RULES)}, got {rule!r}")
    return rows.groupBy(*PAIR).agg(RULES[rule](F.struct("seq", "grade"), "seq").alias("r")).select(*PAIR, "r.*")


def _bucket(n: int):
    return F.pmod(F.xxhash64(*PAIR), F.lit(n)).cast("int")


def _rows(spark: SparkSession, path: str, content: dict | None, buckets: list[int] | None = None) -> DataFrame:
    """Winning records of the given buckets (all by default) under a manifest."""
    held = {int(k): v for k, v in content["buckets"].items()} if content else {}
    paths = [f"{versions.folder(path, v)}/bucket={k}" for k, v in held.items() if buckets is None or k in buckets]
    return spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)


def _store(rows: DataFrame, path: str, content: dict | None, rule: str, n: int, batch: int, whole: bool) -> None:
    """Write `rows` as the new state of the buckets they fall into (of all buckets if `whole`), and switch."""
    spark = rows.sparkSession
    version = versions.next_version(spark, path)
    target = versions.folder(path, version)
    # One file per bucket, however many tasks there are.
    rows.withColumn("bucket", _bucket(n)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    written = [r.bucket for r in spark.read.schema(STATE + ", bucket INT").parquet(target).select("bucket").distinct().collect()]
    held = {} if whole or not content else dict(content["buckets"])
    held |= {str(k): version for k in written}
    versions.switch(spark, path, {"version": version, "batch": batch, "rule": rule, "n": n, "buckets": held}, list(held.values()))


def upsert(batch: DataFrame, batch_id: int, path: str, rule: str = "last", buckets: int = 64) -> None:
    """Merge a micro-batch of log(seq, query_id, doc_id, status, grade) into the labels at `path`."""
    spark = batch.sparkSession
    content = versions.manifest(spark, path)
    if content and (content["rule"] != rule):
        raise ValueError(f"labels at {path} are kept by rule {content['rule']!r}, not {rule!r}")
    if content and batch_id <= content["batch"]:
        return
    n = content["n"] if content else buckets
    new = table_checkpoint(merge_records(ok_records(batch), rule))
    touched = [r.b for r in new.select(_bucket(n).alias("b")).distinct().collect()]  # at most n numbers
    old = _rows(spark, path, content, touched)
    both = merge_records(union_all([old.select(*PAIR, "seq", "grade"), new.select(*PAIR, F.col("seq").cast("bigint"), F.col("grade").cast("int"))]), rule)
    _store(both, path, content, rule, n, batch_id, whole=False)


def judgment_stream(log: DataFrame, path: str, checkpoint: str, rule: str = "last", available_now: bool = False, buckets: int = 64) -> StreamingQuery:
    """Start the label stream over log(seq, query_id, doc_id, status, grade)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {sorted(RULES)}, got {rule!r}")
    writer = log.writeStream.foreachBatch(lambda batch, batch_id: upsert(batch, batch_id, path, rule, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def read_labels(spark: SparkSession, path: str, rule: str = "last", base: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, grade) of the streamed labels. With `base` and rule 'first' a base label is never
    overwritten; with 'last' the stream overrides it."""
    content = versions.manifest(spark, path)
    if content and content["rule"] != rule:
        raise ValueError(f"labels at {path} are kept by rule {content['rule']!r}, not {rule!r}")
    labels = _rows(spark, path, content).select(*PAIR, "grade")
    if base is None:
        return labels
    both = base.select(*PAIR, F.col("grade").alias("old")).join(labels, PAIR, "full")
    keep = ("old", "grade") if rule == "first" else ("grade", "old")
    return both.select(*PAIR, F.coalesce(*keep).alias("grade"))


def compact(spark: SparkSession, path: str, buckets: int | None = None) -> None:
    """Write all labels anew in one version, in another number of buckets if asked. Readers and later batches see it at
    once, and folders no longer named go."""
    content = versions.manifest(spark, path)
    if content:
        _store(_rows(spark, path, content), path, content, content["rule"], buckets or content["n"], content["batch"], whole=True)


def progress_counts(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window_start, window_end, n_ok, n_error, error_share): works on a batch and, after a watermark, on a stream."""
    ok = F.col("status") == "ok"
    counts = log.groupBy(F.window("ts", width).alias("w")).agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_error"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_ok", "n_error",
                         F.round(F.col("n_error") / (F.col("n_ok") + F.col("n_error")), 6).alias("error_share"))


def grading_progress_stream(log: DataFrame, path: str, checkpoint: str, width: str = "1 hour", lateness: str = "1 hour",
                            available_now: bool = False) -> StreamingQuery:
    """Counts per tumbling window, appended once the watermark has passed its end. Records within the lateness are
    counted; later ones are dropped. State holds only the open windows."""
    counted = progress_counts(log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness), width)
    writer = counted.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
