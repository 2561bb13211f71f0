"""Recall channels over taxonomy tag ids.

doc_tags(doc_id, tag_id[, level]) is the bridge; docs(doc_id) lists every document, so documents without tags
still count in N and in the average length. Scores come from one join on tag_id and one map-side-combined sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ranklab.operators.ordering import rank_list

TAG_METHODS = ("bm25", "idf_overlap", "coverage", "sum_levels")
# Per hubness correction the weight a tag must exceed in the weighted scorer. Raw weights have no such
# threshold.
CORRECTIONS = {"centred": 0.05, "z-scored": 1.0, "centred and scaled": 1.0}


def correction_of(variant: str) -> str | None:
    """What a variant name says was done to the weights: '' nothing, 'hc', 'hz', or 'hc-<encoder>'."""
    stem, dash, _ = variant.partition("-")
    return {("hc", ""): "centred", ("hz", ""): "z-scored", ("hc", "-"): "centred and scaled"}.get((stem, dash))


def tag_from_pairs(pairs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tags, tags): one row per document; an explicit document list keeps documents without tags.
    The tags of one document come from a fixed vocabulary, so the array is bounded."""
    grouped = pairs.select("doc_id", "tag_id").distinct().groupBy("doc_id").agg(
        F.sort_array(F.collect_set("tag_id")).alias("tags"))
    if docs is not None:
        grouped = docs.select("doc_id").distinct().join(grouped, "doc_id", "left")
    tags = F.coalesce("tags", F.array().cast("array<bigint>"))
    return grouped.select("doc_id", F.size(tags).cast("bigint").alias("n_tags"), tags.alias("tags"))


def tag_idf(doc_tags: DataFrame, docs: DataFrame) -> DataFrame:
    """(tag_id, df, idf), idf = ln(1 + (N - df + .5) / (df + .5))."""
    n_docs = docs.select("doc_id").distinct().agg(F.count(F.lit(1))).scalar()
    df = doc_tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("df")).withColumn("n_docs", n_docs)
    return df.select("tag_id", "df", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def tag_scores(doc_tags: DataFrame, docs: DataFrame, query_tags: DataFrame, method: str = "bm25", k1: float = 1.2,
               b: float = 0.75, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., query_id, doc_id, score) with zero scores dropped.

    Repeated tags collapse; query tags outside the vocabulary are ignored. `query_tags` may carry extra key
    columns `by` (a condition, a sample draw), scored in the same pass."""
    if method not in TAG_METHODS:
        raise ValueError(f"unknown tag method {method!r}: one of {', '.join(TAG_METHODS)}")
    if k1 < 0 or not 0.0 <= b <= 1.0:
        raise ValueError(f"out of range: k1={k1} (0 or more), b={b} (0 to 1)")
    keys = [*by, "query_id"]
    wanted = query_tags.select(*keys, "tag_id").distinct()
    if method == "sum_levels":
        bridge = doc_tags.groupBy("doc_id", "tag_id").agg(F.max("level").alias("level"))
        level = F.when(F.col("level").isNull(), F.raise_error(F.lit("sum_levels needs a level for every pair")))
        total = F.sum(level.otherwise(F.col("level")).cast("double"))
        return _positive(bridge.join(wanted, "tag_id").groupBy(*keys, "doc_id").agg(F.round(total, 9).alias("score")))
    bridge = doc_tags.select("doc_id", "tag_id").distinct()
    idf = tag_idf(bridge, docs)
    if method == "coverage":
        known = wanted.join(idf.select("tag_id"), "tag_id", "left_semi")
        size = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_known"))
        hits = bridge.join(known, "tag_id").groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("hits"))
        return hits.join(size, keys).select(*keys, "doc_id", F.round(F.col("hits") / F.col("n_known"), 9).alias("score"))
    weighted = wanted.join(idf.select("tag_id", "idf"), "tag_id")
    if method == "idf_overlap":
        out = bridge.join(weighted, "tag_id").groupBy(*keys, "doc_id").agg(F.sum("idf").alias("s"))
        return _positive(out.select(*keys, "doc_id", F.round("s", 9).alias("score")))
    lengths = bridge.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dl"))
    n_docs = docs.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    stats = bridge.agg(F.count(F.lit(1)).alias("n_pairs"))
    sums = bridge.join(weighted, "tag_id").groupBy(*keys, "doc_id").agg(F.sum("idf").alias("s"))
    scored = (sums.join(lengths, "doc_id").withColumn("n_docs", n_docs.scalar()).withColumn("n_pairs", stats.scalar()))
    average = F.when(F.col("n_pairs") > 0, F.col("n_pairs") / F.col("n_docs")).otherwise(F.lit(1.0))
    c = F.lit(k1 + 1.0) / (F.lit(1.0) + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / average))
    return _positive(scored.select(*keys, "doc_id", F.round(c * F.col("s"), 9).alias("score")))


def _positive(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("score") > 0)


def tag_rank(doc_tags: DataFrame, docs: DataFrame, query_tags: DataFrame, k: int | None = None, method: str = "bm25",
             k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """ranked(query_id, doc_id, score, rank); ties go to the smaller document id."""
    return rank_list(tag_scores(doc_tags, docs, query_tags, method, k1, b), k)


def tag_weighted_cosine(doc_weights: DataFrame, query_weights: DataFrame, tau: float = 1.0) -> DataFrame:
    """(query_id, doc_id, score): cosine of relu(weight - tau) vectors; zero scores dropped.

    The vocabulary is every tag some document lists, whatever its weight; query tags outside it are removed
    before the query is normalised."""
    vocab = doc_weights.select("tag_id").distinct()
    relu = lambda df, owner: df.select(owner, "tag_id", (F.col("weight") - F.lit(tau)).alias("w")).where(F.col("w") > 0)
    docs = relu(doc_weights, "doc_id")
    queries = relu(query_weights.join(vocab, "tag_id", "left_semi"), "query_id")
    length = lambda df, owner, out: df.groupBy(owner).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(out))
    dots = (docs.join(queries.select("query_id", "tag_id", F.col("w").alias("qw")), "tag_id")
            .groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot")))
    scored = dots.join(length(docs, "doc_id", "dn"), "doc_id").join(length(queries, "query_id", "qn"), "query_id")
    return scored.select("query_id", "doc_id", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 9).alias("score"))


def keep_best_tags(tags: DataFrame, owner: str, m: int) -> DataFrame:
    """A text's m best tags, from a table that stores their rank."""
    return tags.where(F.col("rank") <= m).select(owner, "tag_id", F.col("score").alias("weight"))


def tag_channel_rank(doc_tags: DataFrame, query_tags: DataFrame, docs: DataFrame, variant: str = "",
                     scorer: str = "bm25", m: int = 30, tau: float | None = None, k: int | None = None,
                     k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The tag channel: keep each side's best m predicted tags, score, rank. doc_tags(doc_id, tag_id, score, rank),
    query_tags(query_id, ...). Variants: '' raw, 'hc' centred, 'hz' z-scored, 'hc-<encoder>' centred and scaled."""
    correction = correction_of(variant)
    if scorer not in ("bm25", "wcos"):
        raise ValueError(f"unknown scorer {scorer!r}: one of bm25, wcos")
    if scorer == "wcos" and correction is None:
        raise ValueError(f"scorer wcos: variant {variant!r} has raw weights")
    d, q = keep_best_tags(doc_tags, "doc_id", m), keep_best_tags(query_tags, "query_id", m)
    if scorer == "wcos":
        return rank_list(tag_weighted_cosine(d, q, CORRECTIONS[correction] if tau is None else tau), k)
    return tag_rank(d, docs, q, k, "bm25", k1, b)


def weighted_tag_vectors(scores: DataFrame, owner: str, m: int = 30, tau: float = 1.0) -> DataFrame:
    """(owner, tag_id, weight): relu(score - tau) over the top-m tags; zero weights are not stored. `scores` may already
    be cut to the m best."""
    top = rank_list(scores.drop("rank"), m, keys=(owner,), tie=("tag_id",))
    return top.select(owner, "tag_id", (F.col("score") - F.lit(tau)).alias("weight")).where(F.col("weight") > 0)


def tag_slot_stats(doc_tags: DataFrame, vocab: DataFrame, m: int = 30, top: int = 50) -> DataFrame:
    """One row: share of the top-m slots held by the `top` most frequent tags, tags used, never picked, and the
    largest tag frequency. The vocabulary (one row per tag) is what gets ordered, never the slots."""
    counts = vocab.select("tag_id").distinct().join(
        doc_tags.where(F.col("rank") <= m).groupBy("tag_id").agg(F.count(F.lit(1)).alias("n")), "tag_id", "left"
    ).select("tag_id", F.coalesce("n", F.lit(0)).alias("n"))
    head = counts.orderBy(F.col("n").desc(), "tag_id").limit(top).agg(F.sum("n"))
    total = counts.agg(F.sum("n").alias("slots"), F.count_if(F.col("n") > 0).alias("tags_used"),
                       F.count_if(F.col("n") == 0).alias("tags_never_picked"), F.max("n").alias("max_tag_freq"))
    return total.withColumn("head", head.scalar()).select(
        F.round(F.col("head") / F.nullif("slots", F.lit(0)), 6).alias("slot_share"), "tags_used",
        "tags_never_picked", "max_tag_freq")
