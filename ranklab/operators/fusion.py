"""Reciprocal-rank fusion and list algebra over ranked(query_id, doc_id, score, rank)."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from ranklab.functions.text import text_tasks
from ranklab.operators.ordering import rank_list
from ranklab.session import union_all

RRF_K = 60


def stack_lists(lists: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """Ranked lists as one long table (list_no, weight, query_id, doc_id, rank)."""
    weights = [1.0] * len(lists) if weights is None else list(weights)
    if len(weights) != len(lists):
        raise ValueError(f"weights: {len(weights)} given, {len(lists)} needed")
    parts = [df.select(F.lit(i).alias("list_no"), F.lit(float(w)).alias("weight"), "query_id", "doc_id",
                       F.col("rank").cast("bigint").alias("rank"))
             for i, (df, w) in enumerate(zip(lists, weights), start=1)]
    return union_all(parts)


def rrf_fuse_n(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, k: int = RRF_K,
               top: int | None = None) -> DataFrame:
    """score = sum of weight / (k + rank) over the lists a document is in; equal scores keep the order of first
    appearance (list by list). A list with weight 0 still contributes its documents, at score 0."""
    stacked = stack_lists(lists, weights)
    fused = stacked.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), 12).alias("score"),
        F.min(F.struct("list_no", "rank")).alias("first_seen"))
    return rank_list(fused, top, tie=("first_seen",)).drop("first_seen")


def rrf_fuse2(a: DataFrame, b: DataFrame, k: int = RRF_K, weight_a: float = 1.0, weight_b: float = 1.0,
              top: int | None = None) -> DataFrame:
    """Two-list fusion; equal scores go to the smaller document id."""
    fused = stack_lists([a, b], [weight_a, weight_b]).groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), 12).alias("score"))
    return rank_list(fused, top)


def rrf_sweep(a: DataFrame, b: DataFrame, grid: Sequence[tuple[int, float, float]], top: int | None = None) -> DataFrame:
    """Every (k, weight_a, weight_b) of the grid in one pass: each ranked row is expanded to the grid, then one
    aggregation fuses all configurations. Returns rows keyed by config (its position in the grid, from 1)."""
    grid_col = F.array(*[F.struct(F.lit(i).alias("config"), F.lit(float(k)).alias("k"), F.lit(float(wa)).alias("wa"),
                                  F.lit(float(wb)).alias("wb")) for i, (k, wa, wb) in enumerate(grid, start=1)])
    rows = stack_lists([a, b]).withColumn("g", F.explode(grid_col))
    weight = F.when(F.col("list_no") == 1, F.col("g.wa")).otherwise(F.col("g.wb"))
    fused = rows.groupBy(F.col("g.config").alias("config"), "query_id", "doc_id").agg(
        F.round(F.sum(weight / (F.col("g.k") + F.col("rank"))), 12).alias("score"))
    return rank_list(fused, top, keys=("config", "query_id"))


def fuse_systems(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, k: int = RRF_K,
                 top: int | None = None) -> DataFrame:
    """Weighted fusion of persisted system lists: weights are normalised to sum 1, and only queries of the first
    list are kept."""
    weights = [1.0] * len(lists) if weights is None else list(weights)
    total = sum(weights)
    wanted = lists[0].select("query_id").distinct()
    kept = [lists[0]] + [df.join(wanted, "query_id", "left_semi") for df in lists[1:]]
    return rrf_fuse_n(kept, [w / total for w in weights], k, top)


def rrf_tied_rank(tables: Sequence[DataFrame], drop_nonpositive: Sequence[bool], k: int = RRF_K) -> DataFrame:
    """Fusion of score tables where ties share the best rank; a table flagged in `drop_nonpositive` contributes
    nothing for scores <= 0."""
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    parts = []
    for table, drop in zip(tables, drop_nonpositive):
        ranked = table.select("query_id", "doc_id", "score", F.rank().over(by_score).alias("r"))
        share = F.lit(1.0) / (F.lit(k) + F.col("r"))
        if drop:
            share = F.when(F.col("score") > 0, share).otherwise(F.lit(0.0))
        parts.append(ranked.select("query_id", "doc_id", share.alias("share")))
    return union_all(parts).groupBy("query_id", "doc_id").agg(
        F.round(F.sum("share"), 12).alias("score"))


def pool_depth(top: int, k: int = RRF_K, weights: Sequence[float] = (1.0, 1.0)) -> int:
    """How deep each list must be read so that no document outside all of them can be in the fused top `top`:
    `top` documents score at least max(w) / (k + top); an unseen one at most sum(w) / (k + depth + 1)."""
    return max(top, ceil(sum(weights) / max(weights) * (k + top)) - k)


def order_by_feature(rows: DataFrame, feature: str, descending: bool = True) -> DataFrame:
    """Rank a query's candidates by any column; equal values keep the fused order."""
    key = F.col(feature).desc_nulls_last() if descending else F.col(feature).asc_nulls_last()
    w = Window.partitionBy("query_id").orderBy(key, F.col("rrf_rank"))
    return rows.select("query_id", "doc_id", F.col(feature).alias("score"), F.row_number().over(w).alias("rank"))


def head_plus_tail(head: DataFrame, full: DataFrame) -> DataFrame:
    """The re-ranked head followed by the rest of the full list in its own order."""
    size = head.groupBy("query_id").agg(F.count(F.lit(1)).alias("head_n"))
    rest = full.join(size.select("query_id"), "query_id", "left_semi").join(
        head.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank")
    tail = rest.withColumn("pos", F.row_number().over(w)).join(size, "query_id").select(
        "query_id", "doc_id", (F.col("head_n") + F.col("pos")).cast("bigint").alias("rank"))
    return union_all([head.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank")), tail])


def rerank_by_external_score(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates re-ranked by a pair score computed elsewhere; a missing score is NULL and goes last."""
    joined = candidates.select("query_id", "doc_id", "rrf_rank").join(
        scores.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col("rrf_rank"))
    return joined.select("query_id", "doc_id", "score", F.row_number().over(w).alias("rank"))


def missing_score_counts(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """(n_candidates, n_missing) of an external score table."""
    joined = candidates.select("query_id", "doc_id").join(
        scores.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left")
    return joined.agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("score").isNull()).alias("n_missing"))


def stripped(col: str) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(F.col(col), r"(?U)^\s+|\s+$", "")


def pair_texts(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidate pairs with both texts: the input of any external pair scorer. Documents meet their pairs over tasks that
    grow with the texts."""
    docs, tasks = docs.select("doc_id", "text"), text_tasks(docs)
    if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        docs = docs.repartition(tasks, "doc_id")
    return (candidates.select("query_id", "doc_id")
            .join(queries.select("query_id", stripped("text").alias("query_text")), "query_id")
            .join(docs.select("doc_id", stripped("text").alias("doc_text")), "doc_id")
            .select("query_id", "doc_id", "query_text", "doc_text"))


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def restrict_to_pool(ranked: DataFrame, pool: DataFrame) -> DataFrame:
    """Only pooled documents, in the same relative order, with closed ranks."""
    kept = ranked.join(pool.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("new_rank", F.row_number().over(w)).select(
        "query_id", "doc_id", F.col("new_rank").alias("rank"))


def list_diff(with_: DataFrame, without: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, side): pairs entering (only in the first top-k) and leaving (only in the second)."""
    a = top_k(with_, k).select("query_id", "doc_id")
    b = top_k(without, k).select("query_id", "doc_id")
    both = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), ["query_id", "doc_id"], "full")
    return both.where(F.col("in_a").isNull() | F.col("in_b").isNull()).select(
        "query_id", "doc_id", F.when(F.col("in_a").isNull(), "leaving").otherwise("entering").alias("side"))


def list_diff_summary(with_: DataFrame, without: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries, changed queries, entering and leaving pairs, entering pairs per query."""
    diff = list_diff(with_, without, k).groupBy("query_id").agg(
        F.count_if(F.col("side") == "entering").alias("entering"),
        F.count_if(F.col("side") == "leaving").alias("leaving"))
    per_query = queries.select("query_id").distinct().join(diff, "query_id", "left")
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count("entering").alias("n_changed"),
        F.coalesce(F.sum("entering"), F.lit(0)).alias("n_entering"),
        F.coalesce(F.sum("leaving"), F.lit(0)).alias("n_leaving"),
        F.round(F.coalesce(F.sum("entering"), F.lit(0)) / F.count(F.lit(1)), 6).alias("entering_per_query"))


def list_overlap(ranked: DataFrame, committed: DataFrame, k: int = 50) -> DataFrame:
    """Mean and worst share of the committed list found again in the top-k, and the share of identical queries."""
    mine = top_k(ranked, k).select("query_id", "doc_id")
    theirs = committed.select("query_id", "doc_id").distinct()
    common = mine.join(theirs, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    share = mine.select("query_id").distinct().join(common, "query_id", "left").select(
        (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("overlap"))
    return share.agg(F.round(F.avg("overlap"), 6).alias("mean_overlap"),
                     F.round(F.min("overlap"), 6).alias("worst_overlap"),
                     F.round(F.avg((F.col("overlap") == 1).cast("double")), 6).alias("identical_share"))
