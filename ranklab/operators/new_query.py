"""Ranking queries that are in no stored tag table, and recipes fitted on one half and used on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ranklab.operators.hubness import centred_unit, corrected_top, role_knn_tags, score_ensemble, tag_prototypes, tag_text_corpus
from ranklab.operators.ordering import rank_list
from ranklab.operators.pools import halves
from ranklab.operators.similarity import all_cosines
from ranklab.operators.tags import tag_rank, tag_weighted_cosine
from ranklab.session import checkpoint, union_all


def checked_stats(stats: DataFrame, tags: DataFrame) -> DataFrame:
    """The stored statistics, or an error when their tag list is not the vocabulary's."""
    both = tags.select("tag_id").withColumn("a", F.lit(1)).join(stats.select("tag_id").withColumn("b", F.lit(1)), "tag_id", "full")
    off = both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull())).scalar()
    rows = stats.withColumn("_off", off)
    bad = F.raise_error(F.lit("stored statistics were built for another tag list")).cast("boolean")
    return rows.where(F.when(F.col("_off") > 0, bad).otherwise(F.lit(True))).drop("_off")


def rank_new_queries(queries: DataFrame, tags: DataFrame, stats: DataFrame | None, doc_tags: DataFrame, docs: DataFrame,
                     m: int = 30, scorer: str = "bm25", tau: float = 0.05, k: int | None = None, k1: float = 1.2,
                     b: float = 0.75) -> DataFrame:
    """ranked(query_id, doc_id, score, rank) for query vectors: cosine to the tag vectors, the stored per-tag
    correction (None for raw tags), the best m tags, then the tag scorer."""
    texts = queries.select(F.col("query_id").alias("text_id"), "vec")
    if stats is None:
        ranked = tag_text_corpus(texts, tags, m)
    else:
        ranked = corrected_top(texts, tags, checked_stats(stats, tags).select("tag_id", F.array("mean", "sd").alias("p")), "z", m)
    best = ranked.select(F.col("text_id").alias("query_id"), "tag_id", F.col("score").alias("weight"))
    if scorer == "wcos":
        weights = doc_tags.select("doc_id", "tag_id", F.col("score").alias("weight"))
        return rank_list(tag_weighted_cosine(weights, best, tau), k)
    return tag_rank(doc_tags.select("doc_id", "tag_id"), docs, best, k, "bm25", k1, b)


def cross_half_prototypes(titles: DataFrame, roles: DataFrame, bridge: DataFrame, a: float, m: int = 30, seed: int = 7) -> DataFrame:
    """(role_id, half, tag_id, score, rank): each role is tagged with prototypes learnt from the other half's roles,
    so no role informs its own tags. Both halves are fitted and applied in one job: the training half is a key of
    the prototypes and of the packed role vectors."""
    split = halves(roles, "role_id", seed, "halves").withColumnRenamed("split", "half")
    trained = tag_prototypes(titles, roles, bridge.join(split.withColumnRenamed("half", "trained"), "role_id"), a, keys=("trained",))
    parts = []
    for half, other in (("dev", "test"), ("test", "dev")):
        mine = roles.join(split.where(F.col("half") == half), "role_id")
        proto = trained.where(F.col("trained") == other).select("tag_id", "vec")
        parts.append(all_cosines(mine, proto, "role_id", "tag_id").withColumn("half", F.lit(half)))
    return rank_list(union_all(parts), m, keys=("role_id", "half"), tie=("tag_id",))


def cross_half_recipes(titles: DataFrame, roles: DataFrame, bridge: DataFrame, tau: float, lam: float, m: int = 30, seed: int = 7) -> DataFrame:
    """(recipe, role_id, half, tag_id, score, rank): roles tagged by neighbouring roles of the other half (`knn`: softmax at
    `tau`, centred per tag), and by the mean of that and of the centred cosines to the titles at weights lam and 1 (`mix`).
    Centring is over all roles, whatever half has trained; the result holds each role's m best tags."""
    split = checkpoint(halves(roles, "role_id", seed, "halves").withColumnRenamed("split", "half"))
    titled = checkpoint(all_cosines(roles, titles, "role_id", "tag_id").withColumnRenamed("role_id", "text_id"))
    plain = checkpoint(centred_unit(titled))
    texts = roles.select(F.col("role_id").alias("text_id"), "vec")
    parts = []
    for trained, half in (("dev", "test"), ("test", "dev")):
        teachers = split.where(F.col("half") == trained).select("role_id")
        found = role_knn_tags(texts, roles.join(teachers, "role_id"), bridge.join(teachers, "role_id"), tau)
        full = titled.select("text_id", "tag_id").join(found, ["text_id", "tag_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        knn = checkpoint(centred_unit(full))
        mine = split.where(F.col("half") == half).select(F.col("role_id").alias("text_id"), "half")
        parts += [df.join(mine, "text_id").withColumn("recipe", F.lit(n)) for n, df in (("knn", knn), ("mix", score_ensemble([plain, knn], [1.0, lam])))]
    both = union_all([p.select("recipe", F.col("text_id").alias("role_id"), "half", "tag_id", "score") for p in parts])
    return rank_list(both, m, keys=("recipe", "role_id", "half"), tie=("tag_id",))
