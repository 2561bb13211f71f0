"""Session settings and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ranklab", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution on. On a cluster leave `master` and `shuffle_partitions` unset: the
    submit command names the master, and AQE coalesces from the configured maximum."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return settle(builder.getOrCreate())


def settle(spark: SparkSession) -> SparkSession:
    """Turn off one planner shortcut: with adaptive execution, Spark 4.1.2 can treat a union of hash-partitioned
    inputs as already partitioned after their partitions have been coalesced differently, and an aggregation above
    it then returns unmerged groups. Without the shortcut the aggregation shuffles, as it did before 4.1."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; every union of the library goes through here (see `settle`)."""
    settle(frames[0].sparkSession)
    return reduce(DataFrame.unionByName, frames)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's `spark.checkpoint.dir`. Only a local session without one
    gets a temporary folder; on a cluster a machine-local folder would not survive the loss of an executor."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="ranklab-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for written tables and stream checkpoints."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def tasks_for(df: DataFrame, task_bytes: int, least: int) -> int:
    """Tasks that share the rows of `df`, a scan: one for each `task_bytes` of the optimizer's estimate, so that the share of
    a task stays the same as tables grow. What has no estimate counts as small."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, -(-size // task_bytes))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it from there: lineage ends, and later reads prune columns
    and skip row groups."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
