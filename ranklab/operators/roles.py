"""Role retrieval: scores of roles judged at the level of equivalence classes, with ties in expectation.

A query is (by..., query_id); `truth(query_id, class_id)` names the class it was drawn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ranklab.operators.ordering import rank_list
from ranklab.operators.tags import tag_scores
from ranklab.operators.taxonomy import track_distribution, track_union_docs

TIE_TOLERANCE = 1e-9


def class_scores(scores: DataFrame, classes: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """(keys..., class_id, score): the best member's score, so identical roles collapse."""
    members = classes.select(F.col("role_id").alias("doc_id"), "class_id")
    return scores.join(members, "doc_id").groupBy(*keys, "class_id").agg(F.max("score").alias("score"))


def tie_aware_hits(by_class: DataFrame, truth: DataFrame, n_classes: DataFrame, ks: Sequence[int] = (1, 5, 10),
                   keys: Sequence[str] = ("query_id",), drop_nonpositive: bool = True) -> DataFrame:
    """(keys..., class_id, role_k...): chance that the truth class is among the k best when ties with it are broken
    at random: clip((k - greater) / ties, 0, 1). `truth(keys..., class_id)` lists every query; a class without a
    score counts as 0; a truth scoring <= 0 is not retrieved when `drop_nonpositive`. `n_classes` is one row."""
    keys = list(keys)
    own = truth.join(by_class, keys + ["class_id"], "left").select(*keys, F.col("class_id").alias("truth_class"), F.coalesce("score", F.lit(0.0)).alias("s_true"))
    near = lambda a, b: F.abs(a - b) <= TIE_TOLERANCE
    seen = own.join(by_class, keys, "left").groupBy(*keys, "truth_class", "s_true").agg(
        F.count("score").alias("present"),
        F.count_if(F.col("score") > F.col("s_true") + TIE_TOLERANCE).alias("greater"),
        F.count_if(near(F.col("score"), F.col("s_true"))).alias("ties")).withColumn("n_classes", n_classes.scalar())
    absent = F.col("n_classes") - F.col("present")
    greater = F.col("greater") + F.when(F.col("s_true") < -TIE_TOLERANCE, absent).otherwise(F.lit(0))
    ties = F.greatest(F.col("ties") + F.when(near(F.lit(0.0), F.col("s_true")), absent).otherwise(F.lit(0)), F.lit(1))
    valid = (F.col("s_true") > TIE_TOLERANCE) if drop_nonpositive else F.lit(True)
    hit = lambda k: F.when(valid, F.least(F.greatest((F.lit(k) - greater) / ties, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return seen.select(*keys, F.col("truth_class").alias("class_id"), *[hit(k).alias(f"role_{k}") for k in ks])


def track_hits(scores: DataFrame, truth: DataFrame, roles: DataFrame, classes: DataFrame, tracks: DataFrame,
               keys: Sequence[str] = ("query_id",), ks: Sequence[int] = (1, 3), top_r: int = 10) -> DataFrame:
    """(keys..., class_id, track_k..., track_1_lenient, track_1_samename): is the truth track among the k heaviest
    tracks of the top roles. Strict: the class's own track (its smallest role's); lenient: any track of the class;
    same name: any track sharing the truth track's name."""
    keys = list(keys)
    best = rank_list(scores, top_r, keys=keys)
    dist = track_distribution(best, roles, top_r, tuple(keys)).where(F.col("track_rank") <= max(ks)).select(*keys, "track_id", "track_rank")
    member_tracks = classes.join(roles.select("role_id", "track_id"), "role_id")
    own = member_tracks.groupBy("class_id").agg(F.min_by("track_id", "role_id").alias("own_track"))
    names = tracks.select("track_id", "name")
    own = own.join(names.withColumnRenamed("track_id", "own_track").withColumnRenamed("name", "own_name"), "own_track", "left")
    any_track = member_tracks.select("class_id", "track_id").distinct().withColumn("member", F.lit(True))
    rows = (truth.join(own, "class_id").join(dist.join(names, "track_id", "left"), keys, "left")
            .join(any_track, ["class_id", "track_id"], "left"))
    first = F.col("track_rank") == 1
    flag = lambda c: F.max(F.when(c, 1.0).otherwise(0.0))
    return rows.groupBy(*keys, "class_id").agg(
        *[flag((F.col("track_id") == F.col("own_track")) & (F.col("track_rank") <= k)).alias(f"track_{k}") for k in ks],
        flag(first & F.coalesce("member", F.lit(False))).alias("track_1_lenient"),
        flag(first & (F.col("name") == F.col("own_name"))).alias("track_1_samename"))


def class_means(metrics: DataFrame, by: Sequence[str] = (), class_col: str = "class_id", drop: Sequence[str] = ("query_id", "draw")) -> DataFrame:
    """(by..., class, metrics...): queries of a class averaged first, so classes weigh the same."""
    cols = [c for c in metrics.columns if c not in (*by, class_col, *drop)]
    return metrics.groupBy(*by, class_col).agg(*[F.avg(c).alias(c) for c in cols])


def condition_effect(means: DataFrame, twins: Sequence[tuple[str, str]], metrics: Sequence[str]) -> DataFrame:
    """(label, class_id, metric, value): noisy minus its clean twin, per class."""
    noisy = F.create_map(*[F.lit(x) for pair in twins for x in pair])
    left = means.withColumn("clean", F.element_at(noisy, F.col("condition"))).where(F.col("clean").isNotNull())
    right = means.select(F.col("condition").alias("clean"), "class_id", *[F.col(m).alias(f"{m}_clean") for m in metrics])
    rows = left.join(right, ["clean", "class_id"]).select(
        F.concat("condition", F.lit(" - "), "clean").alias("label"), "class_id", *[(F.col(m) - F.col(f"{m}_clean")).alias(m) for m in metrics])
    return rows.unpivot(["label", "class_id"], list(metrics), "metric", "value")


def grid_select(grid: DataFrame, value: str, ties: Sequence[Column], by: Sequence[str] = (), decimals: int = 9) -> DataFrame:
    """The best configuration per group: the largest value (rounded, so noise is no reason), then the tie rules in
    order. A grid is a parameter table, so it is small by nature."""
    w = Window.partitionBy(*by).orderBy(F.round(value, decimals).desc(), *ties)
    return grid.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") == 1).drop("_pos")


def track_first_funnel(bridge: DataFrame, roles: DataFrame, classes: DataFrame, query_tags: DataFrame, truth: DataFrame, keys: Sequence[str],
                       b: float = 0.75, k1: float = 1.2, seed: int = 7) -> dict[str, DataFrame]:
    """Flat retrieval, the funnel (predict one track, rank its roles only) and the oracle funnel (told the track).

    Returns {name: tie-aware hits} and 'accuracy': (keys..., hit). Tracks tied at the top are told apart by hash."""
    from ranklab.functions.keys import seeded_key
    by = tuple(k for k in keys if k != "query_id")
    docs = roles.select(F.col("role_id").alias("doc_id"))
    flat = tag_scores(bridge.withColumnRenamed("role_id", "doc_id"), docs, query_tags, "bm25", k1, b, by)
    union = track_union_docs(bridge, roles).withColumnRenamed("track_id", "doc_id")
    track_docs = roles.select(F.col("track_id").alias("doc_id")).distinct()
    track_scores = tag_scores(union, track_docs, query_tags, "bm25", k1, b, by)
    tie = seeded_key(seed, "funnel", *keys, "doc_id")
    predicted = track_scores.groupBy(*keys).agg(F.max_by("doc_id", F.struct("score", tie)).alias("pred"))
    own = classes.join(roles, "role_id").groupBy("class_id").agg(F.min_by("track_id", "role_id").alias("own"))
    asked = truth.join(own, "class_id").join(predicted, list(keys), "left")
    routed = flat.join(roles.select(F.col("role_id").alias("doc_id"), "track_id"), "doc_id").join(asked.select(*keys, "own", "pred"), list(keys))
    n = classes.select("class_id").distinct().agg(F.count(F.lit(1)))
    hits = lambda scores: tie_aware_hits(class_scores(scores, classes, keys), truth, n, keys=keys)
    return {"flat": hits(flat), "funnel": hits(routed.where(F.col("track_id") == F.col("pred"))),
            "oracle": hits(routed.where(F.col("track_id") == F.col("own"))),
            "accuracy": asked.select(*keys, F.coalesce((F.col("pred") == F.col("own")).cast("double"), F.lit(0.0)).alias("hit"))}
