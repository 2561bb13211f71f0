"""Composed evaluations. Each is one long table keyed by method, condition and parameters, so a whole sweep is a
few jobs instead of a loop of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ranklab.operators.bootstrap import boot_draws, bootstrap_ci, paired_diff_ci
from ranklab.operators.fusion import rrf_fuse_n
from ranklab.operators.metrics import (condensed_lists, mean_metrics, metrics_per_query, pool_metrics, to_long, unique_positive_summary)
from ranklab.operators.lsa import lsa_sweep
from ranklab.operators.ordering import global_rank
from ranklab.operators.roles import class_means, class_scores, grid_select, tie_aware_hits, track_hits
from ranklab.operators.tags import TAG_METHODS, tag_idf
from ranklab.session import checkpoint, union_all

ROLE_KEYS = ("condition", "draw", "query_id")


def role_sums(bridge: DataFrame, roles: DataFrame, query_tags: DataFrame) -> DataFrame:
    """(condition, draw, query_id, doc_id, s, hits, levels, n_known, dl, avgdl): all that any scorer of binary tags needs
    of a query and a role it shares tags with. Neither the idf sum nor the number of shared tags depends on k1 or b, so
    one join serves every parameter."""
    pairs = bridge.groupBy("role_id", "tag_id").agg(F.max("level").cast("double").alias("level")).withColumnRenamed("role_id", "doc_id")
    docs = roles.select(F.col("role_id").alias("doc_id")).distinct()
    idf = tag_idf(pairs, docs).select("tag_id", "idf")
    wanted = query_tags.select(*ROLE_KEYS, "tag_id").distinct().join(idf, "tag_id")
    known = wanted.groupBy(*ROLE_KEYS).agg(F.count(F.lit(1)).alias("n_known"))
    lengths = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dl"))
    average = pairs.agg(F.count(F.lit(1))).scalar() / docs.agg(F.count(F.lit(1))).scalar()
    sums = pairs.join(wanted, "tag_id").groupBy(*ROLE_KEYS, "doc_id").agg(F.sum("idf").alias("s"), F.count(F.lit(1)).alias("hits"), F.sum("level").alias("levels"))
    return sums.join(lengths, "doc_id").join(known, list(ROLE_KEYS)).withColumn("avgdl", average)


def scored(sums: DataFrame, methods: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """(method, condition, draw, query_id, doc_id, score) of every (name, scorer, k1, b): parameters are factors of the
    sums. Scores that are not positive go."""
    for name, scorer, k1, b in methods:
        if scorer not in TAG_METHODS or k1 < 0 or not 0.0 <= b <= 1.0:
            raise ValueError(f"{name}: unknown scorer {scorer!r} or parameters out of range (k1={k1}, b={b})")
    every = F.array(*[F.struct(F.lit(n).alias("method"), F.lit(m).alias("scorer"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")) for n, m, k1, b in methods])
    k1, b = F.col("m.k1"), F.col("m.b")
    bm25 = (k1 + 1.0) / (1.0 + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl"))) * F.col("s")
    score = (F.when(F.col("m.scorer") == "bm25", bm25).when(F.col("m.scorer") == "idf_overlap", F.col("s"))
             .when(F.col("m.scorer") == "coverage", F.col("hits") / F.col("n_known")).otherwise(F.col("levels")))
    return sums.withColumn("m", F.explode(every)).select("m.method", *ROLE_KEYS, "doc_id", F.round(score, 9).alias("score")).where(F.col("score") > 0)


def role_scores(bridge: DataFrame, roles: DataFrame, query_tags: DataFrame, methods: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """(method, condition, draw, query_id, doc_id, score) of every (name, scorer, k1, b), from one join."""
    return scored(role_sums(bridge, roles, query_tags), methods)


def latent_role_scores(bridge: DataFrame, roles: DataFrame, query_tags: DataFrame, dims: Sequence[int]) -> DataFrame:
    """The same rows for latent ranking, method `lsa_<rank>`, every role scored: all ranks from one basis."""
    docs = roles.select(F.col("role_id").alias("doc_id")).distinct()
    numbered = checkpoint(global_rank(query_tags.select(F.concat_ws("|", *ROLE_KEYS).alias("_k"), *ROLE_KEYS).distinct(), "_k", "number"))
    tags = query_tags.join(numbered, list(ROLE_KEYS)).select(F.col("number").alias("query_id"), "tag_id")
    ranked = lsa_sweep(bridge.select(F.col("role_id").alias("doc_id"), "tag_id"), docs, tags, dims, docs.count())
    return ranked.select(F.concat(F.lit("lsa_"), F.col("dim").cast("string")).alias("method"), F.col("query_id").alias("number"), "doc_id", "score").join(
        numbered.select("number", *ROLE_KEYS), "number").select("method", *ROLE_KEYS, "doc_id", "score")


def bench_scores(scores: DataFrame, query_tags: DataFrame, roles: DataFrame, classes: DataFrame, tracks: DataFrame, split: DataFrame,
                 methods: Sequence[str], drop_nonpositive: bool = True) -> DataFrame:
    """Class means (see `role_bench`) of given scores(method, condition, draw, query_id, doc_id, score)."""
    keys = ("method", *ROLE_KEYS)
    truth = query_tags.select(*ROLE_KEYS).distinct().withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods]))).withColumn("class_id", F.col("query_id"))
    n = classes.select("class_id").distinct().agg(F.count(F.lit(1)))
    hits = tie_aware_hits(class_scores(scores, classes, keys), truth, n, keys=keys, drop_nonpositive=drop_nonpositive)
    per_query = hits.join(track_hits(scores, truth, roles, classes, tracks, keys), [*keys, "class_id"])
    return class_means(per_query, ["method", "condition"]).join(split, "class_id")


def role_bench(bridge: DataFrame, roles: DataFrame, classes: DataFrame, tracks: DataFrame, query_tags: DataFrame, split: DataFrame,
               methods: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """(method, condition, split, class_id, role_k..., track_k...): class means of every method under every query
    condition. query_tags(condition, draw, query_id = class, tag_id); split(class_id, split). Sweeps over b or k1
    are further methods; selection on dev and intervals on test read this table."""
    query_tags = checkpoint(query_tags)
    scores = checkpoint(role_scores(bridge, roles, query_tags, methods))
    return checkpoint(bench_scores(scores, query_tags, roles, classes, tracks, split, [m[0] for m in methods]))


def selection_values(means: DataFrame) -> DataFrame:
    """(method, value): the tuning target of the dev half, the mean of role@1, @5 and @10 over its classes."""
    return means.where(F.col("split") == "dev").groupBy("method").agg(F.avg((F.col("role_1") + F.col("role_5") + F.col("role_10")) / 3).alias("value"))


def _method_number() -> Column:
    """The parameter at the end of a method's name."""
    return F.regexp_extract("method", "[0-9.]+$", 0).cast("double")


def tuned_b(bridge: DataFrame, roles: DataFrame, classes: DataFrame, tracks: DataFrame, query_tags: DataFrame, split: DataFrame,
            bs: Sequence[float], k1: float = 1.2, sums: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(class means of every b, the best of them as number and value): the largest dev mean of role@1/5/10, ties to the b
    nearest 0.75. `sums` are the written `role_sums`, when more is scored from them."""
    sums = checkpoint(role_sums(bridge, roles, query_tags)) if sums is None else sums
    named = {f"b={b}": (f"b={b}", "bm25", k1, b) for b in bs}
    swept = checkpoint(bench_scores(checkpoint(scored(sums, list(named.values()))), query_tags, roles, classes, tracks, split, list(named)))
    best = grid_select(selection_values(swept).withColumn("number", _method_number()), "value", [F.abs(F.col("number") - 0.75), F.col("number")], decimals=12)
    return swept, best


def tuned_role_bench(bridge: DataFrame, roles: DataFrame, classes: DataFrame, tracks: DataFrame, query_tags: DataFrame, split: DataFrame,
                     bs: Sequence[float], k1s: Sequence[float], dims: Sequence[int], k1: float = 1.2) -> tuple[DataFrame, DataFrame]:
    """(selection, means) of one query condition. b (at `k1`) and the latent rank are chosen on dev: the largest mean of
    role@1/5/10, ties to the b nearest 0.75 and to the smaller rank. Means hold the test half under the chosen b and
    rank: bm25, the other scorers, latent ranking, its fusion with bm25, the whole sweep over b, and k1 at the chosen b.

    Tag scores come from one join, latent scores from one basis; the driver sees the two chosen values only."""
    query_tags = checkpoint(query_tags)
    sums = checkpoint(role_sums(bridge, roles, query_tags))
    args = (query_tags, roles, classes, tracks, split)
    swept, best_b = tuned_b(bridge, roles, classes, tracks, query_tags, split, bs, k1, sums)
    latent = checkpoint(latent_role_scores(bridge, roles, query_tags, dims))
    latent_means = checkpoint(bench_scores(latent, *args, [f"lsa_{x}" for x in dims], False))
    best_dim = grid_select(selection_values(latent_means).withColumn("number", _method_number()), "value", [F.col("number")], decimals=12)
    selection = checkpoint(union_all([best_b.withColumn("parameter", F.lit("b")), best_dim.withColumn("parameter", F.lit("lsa_rank"))]).select("parameter", "number", "value"))
    chosen = {r.parameter: r.number for r in selection.collect()}

    others = [("bm25", "bm25", k1, chosen["b"]), *((m, m, k1, chosen["b"]) for m in TAG_METHODS if m != "bm25"), *((f"k1={x}", "bm25", x, chosen["b"]) for x in k1s)]
    tag = checkpoint(scored(sums, others))
    own = latent.where(F.col("method") == f"lsa_{int(chosen['lsa_rank'])}")
    # Ties share the best rank in a fusion of scores, and only positive tag scores give a vote.
    ranks = lambda df: df.withColumn("r", F.rank().over(Window.partitionBy(*ROLE_KEYS).orderBy(F.col("score").desc()))).select(*ROLE_KEYS, "doc_id", (1.0 / (60 + F.col("r"))).alias("score"))
    both = union_all([ranks(tag.where(F.col("method") == "bm25")), ranks(own)]).groupBy(*ROLE_KEYS, "doc_id").agg(F.round(F.sum("score"), 12).alias("score")).withColumn("method", F.lit("bm25+lsa"))
    rest = bench_scores(union_all([tag, both.select(*tag.columns)]), *args, [*(m[0] for m in others), "bm25+lsa"])
    shown = latent_means.where(F.col("method") == f"lsa_{int(chosen['lsa_rank'])}").withColumn("method", F.lit("lsa"))
    return selection, checkpoint(union_all([swept, rest, shown]).where(F.col("split") == "test"))


def role_bench_summary(means: DataFrame, n_boot: int = 2000, seed: int = 7, splits: Sequence[str] = ("dev", "test")) -> DataFrame:
    """(method, condition, metric, n, mean, lo, hi) over the classes of each split; one set of draws per split."""
    metrics = [c for c in means.columns if c.startswith(("role_", "track_"))]
    long = means.unpivot(["method", "condition", "split", "class_id"], metrics, "metric", "value")
    parts = []
    for name in splits:
        rows = long.where(F.col("split") == name)
        draws = boot_draws(means.where(F.col("split") == name).select("class_id"), "class_id", n_boot, seed, f"boot/{name}")
        parts.append(bootstrap_ci(rows, draws, ["split", "method", "condition", "metric"], "class_id"))
    return union_all(parts)


def role_differences(means: DataFrame, pairs: Sequence[tuple[str, str]], n_boot: int = 2000, seed: int = 7) -> DataFrame:
    """(label, metric, n, mean, lo, hi, significant): paired differences of methods over the test classes, with the draws
    of `role_bench_summary`."""
    metrics = [c for c in means.columns if c.startswith(("role_", "track_"))]
    long = means.unpivot(["method", "class_id"], metrics, "metric", "value")
    draws = boot_draws(means.select("class_id"), "class_id", n_boot, seed, "boot/test")
    wanted = means.sparkSession.createDataFrame([(f"{a} - {b}", a, b) for a, b in pairs], "label string, a string, b string")
    return paired_diff_ci(long, draws, wanted, "method", ("metric",), "class_id")


def provider_bench(channels: dict[str, DataFrame], label_sets: dict[str, tuple[DataFrame, DataFrame]], queries: DataFrame,
                   tag: str = "tag", others: tuple[str, str] = ("bm25", "dense"), weights: Sequence[float] = (1.0, 0.5)) -> DataFrame:
    """(labels, treatment, system, query_id, metrics...) of every channel, the two-list fusion 'rrf2' and the
    three-list fusions 'rrf3_w<weight>', under every label set {name: (judged, gains)}, standard and condensed.
    Means, intervals and differences are aggregations of this table."""
    fused = {f"rrf3_w{w}": rrf_fuse_n([channels[others[0]], channels[others[1]], channels[tag]], [1.0, 1.0, w]) for w in weights}
    systems = union_all([df.select(F.lit(n).alias("system"), "query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))
                         for n, df in {**channels, **fused}.items()]).join(queries.select("query_id"), "query_id", "left_semi")
    names = F.array(*[F.lit(n) for n in label_sets])
    judged = union_all([j.select(F.lit(n).alias("labels"), "query_id", "doc_id") for n, (j, _) in label_sets.items()])
    gains = union_all([g.select(F.lit(n).alias("labels"), "query_id", "doc_id", "gain") for n, (_, g) in label_sets.items()])
    spread = systems.withColumn("labels", F.explode(names))
    by = ["labels", "treatment", "system"]
    standard = spread.withColumn("treatment", F.lit("standard")).select(*by, "query_id", "doc_id", "rank")
    condensed = condensed_lists(spread, judged, ["labels", "system"]).withColumn("treatment", F.lit("condensed")).select(*by, "query_id", "doc_id", "rank")
    every = F.array(*[F.struct(F.lit(l).alias("labels"), F.lit(t).alias("treatment"), F.lit(s).alias("system"))
                      for l in label_sets for t in ("standard", "condensed") for s in [*channels, *fused]])
    frame = queries.select("query_id").distinct().withColumn("f", F.explode(every)).select("f.*", "query_id")
    return metrics_per_query(union_all([standard, condensed]), gains, (5, 10, 20), (10, 20, 50, 100), frame, by)


def marginal_recall(channels: dict[str, DataFrame], positives: DataFrame, queries: DataFrame, ks: Sequence[int] = (10, 20, 50)) -> DataFrame:
    """What each channel alone finds."""
    lists = union_all([df.select(F.lit(n).alias("channel"), "query_id", "doc_id", "rank") for n, df in channels.items()])
    return unique_positive_summary(lists, positives, queries, ks)


def compared_lists_report(lists: DataFrame, gains: DataFrame, queries: DataFrame, comparisons: DataFrame, n_boot: int = 2000,
                          top: int = 10, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(means, paired differences) of every list under every relevance definition.

    `lists(system, query_id, doc_id, rank)`, `gains(relevance, query_id, doc_id, gain)`, comparisons(label, a, b).
    Definitions share one draw table, so differences are paired across them too."""
    names = gains.select("relevance").distinct()
    cut = lists.where(F.col("rank") <= top).join(queries.select("query_id"), "query_id", "left_semi")
    options = names.agg(F.sort_array(F.collect_set("relevance"))).scalar()
    spread = cut.withColumn("relevance", F.explode(options))
    systems = lists.select("system").distinct().agg(F.sort_array(F.collect_set("system"))).scalar()
    frame = queries.select("query_id").distinct().withColumn("relevance", F.explode(options)).withColumn("system", F.explode(systems))
    by = ["relevance", "system"]
    per = checkpoint(metrics_per_query(spread, gains, (5, 10), queries=frame, by=by))
    draws = boot_draws(queries, "query_id", n_boot, seed, "variants/boot")
    diffs = paired_diff_ci(to_long(per, by), draws, comparisons, by=("relevance", "metric"))
    return mean_metrics(per, by), diffs


def samegrader_report(lists: DataFrame, grades: DataFrame, gains: DataFrame, queries: DataFrame, comparisons: DataFrame,
                      n_boot: int = 2000, top: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(completeness, means, paired differences) of the compared top lists under one grader. Completeness is one
    row: pooled pairs and how many of them lack a grade; a comparison is only valid when none do."""
    pair = ["query_id", "doc_id"]
    pooled = lists.where(F.col("rank") <= top).join(queries.select("query_id"), "query_id", "left_semi").select(*pair).distinct()
    known = grades.select(*pair).distinct().withColumn("graded", F.lit(1))
    complete = pooled.join(known, pair, "left").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("graded").isNull()).alias("n_missing"))
    means, diffs = compared_lists_report(lists, gains.withColumn("relevance", F.lit("grader")), queries, comparisons, n_boot, top)
    return complete, means, diffs


def tag_quality(gold: dict[str, DataFrame]) -> DataFrame:
    """(candidate, m, precision, recall, hit): what the tags of several candidates recover, from their gold-tag rows."""
    return union_all([df.withColumn("candidate", F.lit(n)) for n, df in gold.items()]).groupBy("candidate", "m").agg(
        *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "hit")])


def pool_quality(pair_scores: dict[str, DataFrame], pool: DataFrame, gains: DataFrame) -> DataFrame:
    """(candidate, query_id, metrics...): how well the pair scores of several candidates order a graded pool."""
    return union_all([pool_metrics(s, pool, gains).withColumn("candidate", F.lit(n)) for n, s in pair_scores.items()])


def encoder_bench(gold: dict[str, DataFrame], pair_scores: dict[str, DataFrame], pool: DataFrame, gains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables of an encoder comparison."""
    return tag_quality(gold), pool_quality(pair_scores, pool, gains)


def calibrated_gain(lists: DataFrame, records: DataFrame, audit: DataFrame, k: int = 10) -> DataFrame:
    """(system, precision, calibrated): precision at k where each positive counts by the audit's confirmation rate of
    its confidence bin. records(query_id, doc_id, grade, p_ge2); audit(p_ge2, confirmed)."""
    bin_ = lambda c: (F.when(c < 0.6, 0).when(c < 0.8, 1).when(c < 0.95, 2).otherwise(3))
    rates = audit.groupBy(bin_(F.col("p_ge2")).alias("bin")).agg(F.avg(F.col("confirmed").cast("double")).alias("rate"))
    positive = records.where(F.col("grade") >= 2).select("query_id", "doc_id", bin_(F.col("p_ge2")).alias("bin")).join(rates, "bin", "left").select(
        "query_id", "doc_id", F.coalesce("rate", F.lit(1.0)).alias("rate"))
    rows = lists.where(F.col("rank") <= k).join(positive, ["query_id", "doc_id"], "left")
    per = rows.groupBy("system", "query_id").agg((F.count("rate") / F.count(F.lit(1))).alias("p"),
                                                 (F.coalesce(F.sum("rate"), F.lit(0.0)) / F.count(F.lit(1))).alias("c"))
    return per.groupBy("system").agg(F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("c"), 6).alias("calibrated"))
