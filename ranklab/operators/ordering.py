"""Ranks and running sums that never put an unbounded group into one task.

A plain `row_number() OVER (ORDER BY x)` sends every row to a single task. Here rows are range-partitioned by the sort
key, so each partition holds its share of the rows whatever the values are spread like; a window runs inside each
partition, and the partition totals (one small row each) supply the offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ranklab.session import checkpoint


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Inclusive running sum of `value` within `keys`, ordered by `order` (which tells all rows of a key apart).

    Spark samples the keys for the range borders, so there are as many ranges as shuffle partitions and a long list of
    one key is cut like the rest. The ranges are written once, since a second sampling could draw other borders."""
    keys = list(keys)
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_bin", F.spark_partition_id()).withColumn("_value", value)
    ranged = checkpoint(ranged)
    totals = ranged.groupBy(*keys, "_bin").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bin", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumn("_inside", F.sum("_value").over(inside))
            .join(offsets, keys + ["_bin"])
            .withColumn(out, F.col("_inside") + F.col("_offset"))
            .drop("_inside", "_offset", "_bin", "_value"))


def global_rank(df: DataFrame, order_col: str, out: str) -> DataFrame:
    """Unique 1-based position of every row by `order_col` (unique, ascending)."""
    return prefix_sum(df, [], [F.col(order_col)], F.lit(1), out)


def rank_list(df: DataFrame, k: int | None = None, keys: Sequence[str] = ("query_id",), score: str = "score",
              tie: Sequence[str] = ("doc_id",), out: str = "rank") -> DataFrame:
    """Rank by score descending, ties by `tie` ascending. With `k` the plan gets a WindowGroupLimit, so each
    task keeps at most k rows per list before the shuffle. Without `k` the lists must be bounded (channel
    top-k, pools); for whole-corpus lists use `rank_deep`."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *[F.col(t).asc() for t in tie])
    ranked = df.withColumn(out, F.row_number().over(w))
    return ranked.where(F.col(out) <= k) if k else ranked


def rank_deep(df: DataFrame, keys: Sequence[str] = ("query_id",), score: str = "score",
              tie: Sequence[str] = ("doc_id",), out: str = "rank") -> DataFrame:
    """The same ranks for lists as long as the corpus."""
    return prefix_sum(df, keys, [F.col(score).desc(), *[F.col(t).asc() for t in tie]], F.lit(1), out)


def mid_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "mid_rank") -> DataFrame:
    """Average rank (ties share it) of every row within `keys`.

    Rows are first counted per distinct value, so a value held by a third of all rows is one row of the
    running sum instead of one overloaded task."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    running = prefix_sum(counts, keys, [F.col(value)], F.col("_n"), "_upto")
    ranks = running.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, keys + [value])


def upper_median(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "median") -> DataFrame:
    """(by..., median): element n div 2 (from 0) of the sorted values, never interpolated. Found on the running
    count of distinct values, so no task holds a whole group's values."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    running = prefix_sum(counts, by, [F.col(value)], F.col("_n"), "_upto")
    if by:
        running = running.join(counts.groupBy(*by).agg(F.sum("_n").alias("_all")), by)
    else:
        running = running.withColumn("_all", counts.agg(F.sum("_n")).scalar())
    middle = F.min(F.when(F.col("_upto") >= F.floor(F.col("_all") / 2) + 1, F.col(value))).alias(out)
    return running.groupBy(*by).agg(middle) if by else running.agg(middle)
