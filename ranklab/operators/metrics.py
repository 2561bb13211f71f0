"""Ranking metrics as conditional aggregates over (system, query_id, doc_id, rank).

Three conventions differ on purpose: precision divides by the length of the returned list, recall of a query
without relevant documents is NULL (and leaves the mean), NDCG with an empty ideal list is 0 (and stays in)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ranklab.functions.lexicon import RELEVANCE_THRESHOLD
from ranklab.operators.ordering import mid_ranks, prefix_sum


def _log2_discount(rank: Column) -> Column:
    return F.log2(rank + F.lit(1))


def truth_stats(gains: DataFrame, ks: Sequence[int], threshold: float = RELEVANCE_THRESHOLD,
                keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """(keys, n_rel, idcg_k...): the ideal list needs only the max(ks) best gains of a query."""
    keys = list(keys)
    best = Window.partitionBy(*keys).orderBy(F.col("gain").desc(), F.col("doc_id"))
    ideal = (gains.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= max(ks))
             .groupBy(*keys).agg(*[
                 F.sum(F.when(F.col("pos") <= k, F.col("gain") / _log2_discount(F.col("pos")))).alias(f"idcg_{k}")
                 for k in ks]))
    relevant = gains.groupBy(*keys).agg(F.count_if(F.col("gain") >= threshold).alias("n_rel"))
    return relevant.join(ideal, keys, "left")


def metrics_per_query(ranked: DataFrame, gains: DataFrame, ks: Sequence[int] = (5, 10),
                      recall_ks: Sequence[int] | None = None, queries: DataFrame | None = None,
                      by: Sequence[str] = (), cap: int | None = None, ndcg_gains: DataFrame | None = None,
                      threshold: float = RELEVANCE_THRESHOLD) -> DataFrame:
    """One row per (by..., query): p_k, r_k, ndcg_k, mrr.

    `gains(query_id, doc_id, gain)` holds gain > 0 only. `queries` (columns by... and query_id) fixes the
    denominator; queries without a list score 0. `cap` cuts every list first. `ndcg_gains` replaces the gains in
    NDCG only. Columns of `by` that `gains` also has (a label set, a relevance definition) join with it."""
    by = list(by)
    shared = [c for c in by if c in gains.columns]
    recall_ks = list(recall_ks if recall_ks is not None else ks)
    if cap is not None:
        ranked = ranked.where(F.col("rank") <= cap)
    joined = ranked.select(*by, "query_id", "doc_id", "rank").join(
        gains.select(*shared, "query_id", "doc_id", "gain"), shared + ["query_id", "doc_id"], "left")
    if ndcg_gains is None:
        joined = joined.withColumn("g", F.col("gain"))
    else:
        joined = joined.join(ndcg_gains.select(*shared, "query_id", "doc_id", F.col("gain").alias("g")),
                             shared + ["query_id", "doc_id"], "left")
    rank, hit = F.col("rank"), F.col("gain") >= threshold
    aggs = [F.count(F.lit(1)).alias("n_list"), F.min(F.when(hit, rank)).alias("first_hit")]
    aggs += [F.count_if((rank <= k) & hit).alias(f"hits_{k}") for k in sorted(set(list(ks) + recall_ks))]
    aggs += [F.sum(F.when((rank <= k) & (F.col("g") > 0), F.col("g") / _log2_discount(rank))).alias(f"dcg_{k}")
             for k in ks]
    found = joined.groupBy(*by, "query_id").agg(*aggs)
    if queries is not None:
        found = queries.select(*by, "query_id").distinct().join(found, by + ["query_id"], "left")
    keys = shared + ["query_id"]
    stats = truth_stats(gains, ks, threshold, keys)
    if ndcg_gains is not None:
        ideal = truth_stats(ndcg_gains, ks, threshold, keys).drop("n_rel")
        stats = stats.select(*keys, "n_rel").join(ideal, keys, "full")
    full = found.join(stats, keys, "left")
    zero = F.lit(0.0)
    out = [F.col(c) for c in by] + [F.col("query_id")]
    for k in ks:
        out.append(F.coalesce(F.col(f"hits_{k}") / F.nullif(F.least(F.col("n_list"), F.lit(k)), F.lit(0)), zero)
                   .alias(f"p_{k}"))
    for k in recall_ks:
        out.append((F.coalesce(F.col(f"hits_{k}"), F.lit(0)) / F.nullif("n_rel", F.lit(0))).alias(f"r_{k}"))
    for k in ks:
        out.append(F.coalesce(F.col(f"dcg_{k}") / F.nullif(F.col(f"idcg_{k}"), zero), zero).alias(f"ndcg_{k}"))
    out.append(F.coalesce(F.lit(1.0) / F.col("first_hit"), zero).alias("mrr"))
    return full.select(*out)


def metric_columns(df: DataFrame, by: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c not in by and c != "query_id"]


def to_long(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., query_id, metric, value)."""
    names = metric_columns(per_query, by)
    return per_query.unpivot([*by, "query_id"], names, "metric", "value")


def mean_metrics(per_query: DataFrame, by: Sequence[str] = (), decimals: int = 6) -> DataFrame:
    """Mean of every metric over queries (NULL is skipped)."""
    names = metric_columns(per_query, by)
    aggs = [F.round(F.avg(c), decimals).alias(c) for c in names]
    return per_query.groupBy(*by).agg(*aggs) if by else per_query.agg(*aggs)


def evaluate_all(ranked: DataFrame, gains: DataFrame, ks: Sequence[int] = (5, 10), by: Sequence[str] = ()) -> DataFrame:
    """Means over every query in the results; a query without labels scores 0 and leaves recall out."""
    return mean_metrics(metrics_per_query(ranked, gains, ks, by=by), by)


def evaluate_labelled_only(ranked: DataFrame, gains: DataFrame, labelled_queries: DataFrame,
                           ks: Sequence[int] = (5, 10), by: Sequence[str] = ()) -> DataFrame:
    """The same means over queries present in the label set only."""
    kept = ranked.join(labelled_queries.select("query_id").distinct(), "query_id", "left_semi")
    return mean_metrics(metrics_per_query(kept, gains, ks, by=by), by)


def condensed_lists(ranked: DataFrame, judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Drop unjudged documents and close the ranks."""
    shared = [c for c in by if c in judged.columns] + ["query_id", "doc_id"]
    kept = ranked.join(judged.select(*shared).distinct(), shared, "left_semi")
    w = Window.partitionBy(*by, "query_id").orderBy("rank")
    return kept.withColumn("new_rank", F.row_number().over(w)).select(
        *by, "query_id", "doc_id", F.col("new_rank").alias("rank"))


def judged_share(ranked: DataFrame, judged: DataFrame, ks: Sequence[int], queries: DataFrame,
                 by: Sequence[str] = ()) -> DataFrame:
    """Mean over queries of the share of the top-k with a grade; an empty list counts as 1. A key of `by` that `judged`
    has, too, such as a label set, is part of the pair."""
    pair = [*(c for c in by if c in judged.columns), "query_id", "doc_id"]
    flags = judged.select(*pair).distinct().withColumn("judged", F.lit(1))
    joined = ranked.where(F.col("rank") <= max(ks)).join(flags, pair, "left")
    per = joined.groupBy(*by, "query_id").agg(*[
        F.avg(F.when(F.col("rank") <= k, F.coalesce("judged", F.lit(0)).cast("double"))).alias(f"k{k}") for k in ks])
    full = queries.select(*by, "query_id").distinct().join(per, [*by, "query_id"], "left")
    aggs = [F.round(F.avg(F.coalesce(f"k{k}", F.lit(1.0))), 6).alias(f"judged_share_{k}") for k in ks]
    return full.groupBy(*by).agg(*aggs) if by else full.agg(*aggs)


def unique_positives(lists: DataFrame, positives: DataFrame, ks: Sequence[int] = (10, 20, 50)) -> DataFrame:
    """Per channel and k: relevant documents in its top-k and in no other channel's top-k.

    `lists(channel, query_id, doc_id, rank)`. A pair is unique to a channel at k when exactly one channel holds
    it there, so one aggregation per pair replaces the anti joins."""
    grid = F.array(*[F.lit(k) for k in ks])
    seen = (lists.join(positives.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
            .withColumn("k", F.explode(grid)).where(F.col("rank") <= F.col("k"))
            .groupBy("k", "query_id", "doc_id")
            .agg(F.count(F.lit(1)).alias("holders"), F.min("channel").alias("channel")))
    return seen.where(F.col("holders") == 1).select("k", "channel", "query_id", "doc_id")


def unique_positive_summary(lists: DataFrame, positives: DataFrame, queries: DataFrame,
                            ks: Sequence[int] = (10, 20, 50)) -> DataFrame:
    """Share of queries with a unique hit, number of hits, share of all positives."""
    unique = unique_positives(lists, positives, ks)
    pos = positives.select("query_id", "doc_id").distinct()
    n_pos = pos.agg(F.count(F.lit(1))).scalar()
    n_queries = queries.select("query_id").distinct().agg(F.count(F.lit(1))).scalar()
    hits = unique.groupBy("k", "channel").agg(F.count(F.lit(1)).alias("n_unique_hits"),
                                              F.count_distinct("query_id").alias("n_queries_hit"))
    frame = lists.select("channel").distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return (frame.join(hits, ["k", "channel"], "left").withColumn("n_pos", n_pos).withColumn("n_queries", n_queries)
            .select("k", "channel", F.coalesce("n_unique_hits", F.lit(0)).cast("bigint").alias("n_unique_hits"),
                    F.round(F.coalesce("n_queries_hit", F.lit(0)) / F.col("n_queries"), 6).alias("query_share"),
                    F.round(F.coalesce("n_unique_hits", F.lit(0)) / F.col("n_pos"), 6).alias("positive_share")))


def outside_pool_found(positives: DataFrame, fused: DataFrame, channel: DataFrame, k: int = 50) -> DataFrame:
    """Positives outside the fused top-k, their queries, and how many the channel has in its own top-k."""
    pair = ["query_id", "doc_id"]
    outside = positives.select(*pair).distinct().join(fused.where(F.col("rank") <= k).select(*pair), pair, "left_anti")
    found = channel.where(F.col("rank") <= k).select(*pair).withColumn("found", F.lit(1))
    return outside.join(found, pair, "left").agg(
        F.count(F.lit(1)).alias("n_outside"), F.count_distinct("query_id").alias("n_queries"),
        F.count("found").alias("n_found"))


def ungraded_counts(target: DataFrame, others: DataFrame, judged: DataFrame, ks: Sequence[int] = (10, 20, 50)) -> DataFrame:
    """Per k: pairs only the target channel has, unjudged ones among them, and unjudged pairs in its whole top-k.
    `others(query_id, doc_id, rank)` stacks the other channels."""
    pair = ["query_id", "doc_id"]
    best_other = others.groupBy(*pair).agg(F.min("rank").alias("other_rank"))
    graded = judged.select(*pair).distinct().withColumn("judged", F.lit(1))
    rows = (target.where(F.col("rank") <= max(ks)).join(best_other, pair, "left").join(graded, pair, "left")
            .withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k")))
    only = F.col("other_rank").isNull() | (F.col("other_rank") > F.col("k"))
    return rows.groupBy("k").agg(
        F.count_if(only).alias("only_pairs"), F.count_if(only & F.col("judged").isNull()).alias("only_unjudged"),
        F.count_if(F.col("judged").isNull()).alias("top_k_unjudged"))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUC with ties counted half; NULL when a class is empty. Rows are reduced to one per distinct
    score before the running sum."""
    by = list(by)
    counts = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    upto = prefix_sum(counts, by, [F.col(score)], F.col("neg"), "neg_upto")
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") * 0.5))
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    aggs = [n_pos.alias("n_pos"), n_neg.alias("n_neg"), wins.alias("wins")]
    out = upto.groupBy(*by).agg(*aggs) if by else upto.agg(*aggs)
    return out.select(*by, "n_pos", "n_neg", (F.col("wins") / F.nullif(
        F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))).alias("auc"))


def pool_metrics(scores: DataFrame, pool: DataFrame, gains: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Per query NDCG@k and AUC inside a fixed graded pool(query_id, doc_id, grade, tie). Ties follow the pool's
    seeded key; a query without both classes is NULL. A missing score is 0."""
    rows = pool.join(scores.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", "tie", F.coalesce("score", F.lit(0.0)).alias("score"),
        (F.col("grade") >= 2).cast("int").alias("positive"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("tie"))
    ranked = rows.withColumn("rank", F.row_number().over(w))
    base = metrics_per_query(ranked, gains, ks)
    area = auc(rows, "score", "positive", ["query_id"])
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return area.join(base, "query_id", "left").select(
        "query_id", *[F.when(both, F.col(f"ndcg_{k}")).alias(f"ndcg_{k}") for k in ks], "auc")


def spearman_by(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks; 0 when a side has no variance."""
    ranked = mid_ranks(mid_ranks(df.select(*by, a, b), a, by, "ra"), b, by, "rb")
    spread = F.stddev_pop("ra") * F.stddev_pop("rb")
    value = F.coalesce(F.covar_pop("ra", "rb") / F.nullif(spread, F.lit(0.0)), F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("n"), value.alias("spearman")]
    return ranked.groupBy(*by).agg(*aggs) if by else ranked.agg(*aggs)


def complementarity(scores: DataFrame, dense: DataFrame, fused: DataFrame, k: int = 50) -> DataFrame:
    """Per query: Spearman of a candidate's scores with the dense scores over all documents (a missing candidate
    score is 0), and the share of the candidate's top-k that is not in the fused top-k. `scores` carries `tie`."""
    both = dense.select("query_id", "doc_id", F.col("score").alias("dense")).join(
        scores.select("query_id", "doc_id", F.col("score").alias("cand")), ["query_id", "doc_id"], "left").select(
        "query_id", "dense", F.coalesce("cand", F.lit(0.0)).alias("cand"))
    rho = spearman_by(both, "cand", "dense", ["query_id"])
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("tie"))
    top = scores.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    novel = top.join(fused.where(F.col("rank") <= k).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    fresh = novel.groupBy("query_id").agg((F.count(F.lit(1)) / F.lit(k)).alias("novelty"))
    return rho.join(fresh, "query_id", "left").select(
        "query_id", "spearman", F.coalesce("novelty", F.lit(0.0)).alias("novelty"))


def embedding_spread(vectors: DataFrame, vec: str = "vec", collapse_at: float = 0.95) -> DataFrame:
    """Mean pairwise cosine of all vectors in one pass: (|sum u|^2 - sum |u|^2) / (n (n - 1)) over unit vectors u, so no
    pair is ever formed. A vector is divided by its norm inside the row; sums per dimension are combined map-side; NaN
    components are counted, and a vector that has one, or no direction, is left out."""
    squares = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    rows = vectors.select(F.col(vec).alias("_v"), F.sqrt(squares).alias("_norm"), F.size(F.filter(vec, F.isnan)).alias("_nan"))
    bad = rows.agg(F.sum("_nan").alias("n_nan")).scalar()
    dims = rows.where((F.col("_nan") == 0) & (F.col("_norm") > 0)).select("_norm", F.posexplode("_v").alias("dim", "x"))
    unit = F.col("x") / F.col("_norm")
    sums = dims.groupBy("dim").agg(F.sum(unit).alias("s"), F.count(F.lit(1)).alias("n"), F.sum(unit * unit).alias("sq"))
    total = sums.agg(F.sum(F.col("s") * F.col("s")).alias("norm2"), F.max("n").alias("n"), F.sum("sq").alias("sq"))
    n = F.col("n").cast("double")
    spread = (F.col("norm2") - F.col("sq")) / (n * (n - 1))
    return total.select("n", F.coalesce(bad, F.lit(0)).cast("bigint").alias("n_nan"), F.round(spread, 6).alias("mean_pairwise_cosine"),
                        (spread > collapse_at).alias("collapsed"))


def positive_cosine(pairs: DataFrame, vectors: DataFrame, dims: Sequence[int], id_col: str = "doc_id", vec: str = "vec") -> DataFrame:
    """(dim, n_pairs, mean_cosine) of pairs(anchor, positive), with the vectors cut to each of `dims` first."""
    left = vectors.select(F.col(id_col).alias("anchor"), F.col(vec).alias("_a"))
    right = vectors.select(F.col(id_col).alias("positive"), F.col(vec).alias("_p"))
    both = pairs.select("anchor", "positive").join(left, "anchor").join(right, "positive").withColumn("dim", F.explode(F.array(*[F.lit(int(d)) for d in dims])))
    dot = lambda x, y: F.aggregate(F.zip_with(F.slice(x, F.lit(1), F.col("dim")), F.slice(y, F.lit(1), F.col("dim")), lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, x: acc + x)
    cosine = dot("_a", "_p") / F.sqrt(dot("_a", "_a") * dot("_p", "_p"))
    return both.groupBy("dim").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(cosine), 6).alias("mean_cosine"))
