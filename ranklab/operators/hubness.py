"""Tagging texts by embedding similarity and correcting for hub tags.

Every correction changes a score by a few numbers of its tag. `correction` finds these numbers with sums over blocks of
the product, and `corrected_top` applies them inside the product and returns the best tags of every text, so texts x tags
is never a table. The functions over sims(text_id, tag_id, score[, side]) are the same corrections for a table that
already exists, such as scores from elsewhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from collections.abc import Sequence
from pyspark.sql import DataFrame, Window, functions as F

from ranklab.operators.ordering import rank_list
from ranklab.operators.similarity import all_cosines, block_products, carried_products, top_k_cosine, top_per_row
from ranklab.session import checkpoint, union_all

SIGMA_FLOOR = 1e-6


def tag_text_corpus(texts: DataFrame, tags: DataFrame, m: int = 30) -> DataFrame:
    """(text_id, tag_id, score, rank): the m most similar tags of every text; ties keep tag order."""
    return top_k_cosine(texts, tags, m, "text_id", "tag_id", best_of="right")


def tag_similarities(texts: DataFrame, tags: DataFrame) -> DataFrame:
    return all_cosines(texts, tags, "text_id", "tag_id")


def hubness_stats(sims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., tag_id, mean, sd): per-tag mean and population deviation over the texts, sd floored."""
    return sims.groupBy(*by, "tag_id").agg(F.avg("score").alias("mean"),
                                           F.greatest(F.stddev_pop("score"), F.lit(SIGMA_FLOOR)).alias("sd"))


def hubness_stats_blocked(texts: DataFrame, tags: DataFrame) -> DataFrame:
    """The same statistics straight from the blocked product: each block pair emits one row per tag (count, sum,
    sum of squares around 0), so the shuffle carries tags, not texts x tags."""
    def emit(l, r, s):
        return pd.DataFrame({"tag_id": r, "n": np.full(len(r), len(l)), "s": s.sum(axis=0), "sq": (s * s).sum(axis=0)})
    parts = block_products(texts, tags, emit, "tag_id long, n long, s double, sq double", "text_id", "tag_id")
    total = parts.groupBy("tag_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("sq").alias("sq"))
    mean = F.col("s") / F.col("n")
    return total.select("tag_id", mean.alias("mean"), F.greatest(
        F.sqrt(F.greatest(F.col("sq") / F.col("n") - mean * mean, F.lit(0.0))), F.lit(SIGMA_FLOOR)).alias("sd"))


def _moments(texts: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag_id, n, s, sq, peak, mean, sd) of the rounded scores, one row per tag and block before the shuffle."""
    def emit(l, r, s):
        s = np.round(s, 9) + 0.0
        return pd.DataFrame({"tag_id": r, "n": len(l), "s": s.sum(axis=0), "sq": (s * s).sum(axis=0), "peak": s.max(axis=0)})
    parts = block_products(texts, tags, emit, "tag_id long, n long, s double, sq double, peak double", "text_id", "tag_id")
    total = parts.groupBy("tag_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("sq").alias("sq"), F.max("peak").alias("peak"))
    mean = F.col("s") / F.col("n")
    return total.withColumn("mean", mean).withColumn("sd", F.greatest(F.sqrt(F.greatest(F.col("sq") / F.col("n") - mean * mean, F.lit(0.0))), F.lit(SIGMA_FLOOR)))


def _pooled(moments: DataFrame):
    """The deviation of all scores around the means of their tags, as a scalar."""
    return moments.agg(F.sqrt(F.greatest(F.sum(F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")) / F.sum("n"), F.lit(0.0)))).scalar()


def _apply(how: str, s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Corrected scores [text, tag] from cosines and the numbers [number, tag] of `correction`."""
    if how == "raw":
        return s
    if how == "center":
        return np.round(s - p[0], 9)
    if how in ("z", "pooled", "global"):
        return np.round((s - p[0]) / p[1], 9)
    if how == "csls":
        return np.round(s - p[0] * 0.5, 12)
    if how == "dsm":
        return np.round(np.where(p[1] > 0, s - p[0] - p[1] * p[2], s), 9)
    if how in ("mix", "mix-sum"):
        mixed = p[3] * np.round((s - p[0]) / p[1], 9) + p[4] * np.round((s - p[0]) / p[2], 9)
        return np.round(mixed / p[5], 9) if how == "mix" else mixed
    raise ValueError(f"unknown correction {how!r}")


def correction(texts: DataFrame, tags: DataFrame, how: str, k: int = 10, arg: float = 1.0, weights: Sequence[float] = (1.0, 1.0)) -> DataFrame:
    """(tag_id, p): the numbers of a correction for every tag. `center`, `z`: the tag's mean and deviation; `pooled`: its
    mean and one pooled deviation; `global`: one mean and deviation; `csls`: the mean of its `k` highest cosines; `dsm`:
    its log-mean-exp at `arg` pooled deviations; `mix`: the weighted mean of pooled and z, rescaled to unit deviation.
    The result is written: one row per tag."""
    one = lambda sd: F.when(sd > 0, sd).otherwise(F.lit(1.0))
    if how == "csls":
        k = max(int(k), 1)

        def emit(l, r, s):
            tag, text, score = top_per_row(r, l, s.T, k)
            return pd.DataFrame({"tag_id": tag, "text_id": text, "score": score})
        best = rank_list(block_products(texts, tags, emit, "tag_id long, text_id long, score double", "text_id", "tag_id"), k, keys=("tag_id",), tie=("text_id",))
        return checkpoint(best.groupBy("tag_id").agg(F.array(F.avg("score")).alias("p")))
    stats = checkpoint(_moments(texts, tags))
    if how == "raw":
        return stats.select("tag_id", F.array().cast("array<double>").alias("p"))
    if how == "center":
        return stats.select("tag_id", F.array("mean").alias("p"))
    if how == "z":
        return stats.select("tag_id", F.array("mean", "sd").alias("p"))
    if how == "global":
        total = stats.agg(F.struct((F.sum("s") / F.sum("n")).alias("m"), (F.sum("sq") / F.sum("n")).alias("q"))).scalar()
        rows = stats.withColumn("t", total)
        return rows.select("tag_id", F.array("t.m", one(F.sqrt(F.greatest(F.col("t.q") - F.col("t.m") * F.col("t.m"), F.lit(0.0))))).alias("p"))
    rows = stats.withColumn("pooled", _pooled(stats))
    if how == "pooled":
        return rows.select("tag_id", F.array("mean", one(F.col("pooled"))).alias("p"))
    if how == "dsm":
        scaled = rows.select("tag_id", F.array(F.col("peak"), F.col("pooled") * F.lit(float(arg))).alias("p"))

        def soft(l, r, s, p):
            t = np.where(p[:, 1] > 0, p[:, 1], np.inf)
            return pd.DataFrame({"tag_id": r, "n": len(l), "e": np.exp((s - p[:, 0]) / t).sum(axis=0)})
        parts = carried_products(texts, tags, scaled, soft, "tag_id long, n long, e double", "text_id", "tag_id")
        lme = parts.groupBy("tag_id").agg(F.log(F.sum("e") / F.sum("n")).alias("lme"))
        return checkpoint(scaled.join(lme, "tag_id").select("tag_id", F.array(F.col("p")[0], F.col("p")[1], F.col("lme")).alias("p")))
    if how == "mix":
        a, b = (float(w) / float(sum(weights)) for w in weights)
        parts = rows.select("tag_id", F.array(F.col("mean"), one(F.col("pooled")), F.col("sd"), F.lit(a), F.lit(b)).alias("p"))

        def sums(l, r, s, p):
            mixed = _apply("mix-sum", s, p.T)
            return pd.DataFrame({"n": [mixed.size], "s": [mixed.sum()], "sq": [(mixed * mixed).sum()]})
        total = carried_products(texts, tags, parts, sums, "n long, s double, sq double", "text_id", "tag_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("sq").alias("sq"))
        sd = total.select(F.sqrt(F.greatest(F.col("sq") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0)))).scalar()
        return checkpoint(parts.withColumn("sd", sd).select("tag_id", F.concat("p", F.array(one(F.col("sd")))).alias("p")))
    raise ValueError(f"unknown correction {how!r}")


def corrected_top(texts: DataFrame, tags: DataFrame, numbers: DataFrame, how: str, m: int) -> DataFrame:
    """(text_id, tag_id, score, rank): the m best tags of every text after a correction; ties keep tag order. Each block
    returns m rows per text at most."""
    def emit(l, r, s, p):
        text, tag, score = top_per_row(l, r, _apply(how, s, p.T), m, 12)
        return pd.DataFrame({"text_id": text, "tag_id": tag, "score": score})
    partial = carried_products(texts, tags, numbers, emit, "text_id long, tag_id long, score double", "text_id", "tag_id")
    return rank_list(partial, m, keys=("text_id",), tie=("tag_id",))


def tag_corrected(texts: DataFrame, tags: DataFrame, how: str, m: int, **settings) -> DataFrame:
    """`corrected_top` with the numbers of these very texts."""
    return corrected_top(texts, tags, correction(texts, tags, how, **settings), how, m)


def _with_stats(sims: DataFrame, stats: DataFrame) -> DataFrame:
    keys = [c for c in ("side", "tag_id") if c in sims.columns and c in stats.columns]
    return sims.join(stats, keys)


def hubness_center(sims: DataFrame, stats: DataFrame) -> DataFrame:
    """score - the tag's mean."""
    return _with_stats(sims, stats).withColumn("score", F.round(F.col("score") - F.col("mean"), 9)).select(*sims.columns)


def hubness_z(sims: DataFrame, stats: DataFrame) -> DataFrame:
    """(score - mean) / sd."""
    return _with_stats(sims, stats).withColumn(
        "score", F.round((F.col("score") - F.col("mean")) / F.col("sd"), 9)).select(*sims.columns)


def hubness_pooled_unit(sims: DataFrame) -> DataFrame:
    """Centred per tag, then divided by one pooled deviation of the centred table (0 counts as 1)."""
    centred = _with_stats(sims, sims.groupBy("tag_id").agg(F.avg("score").alias("mean"))).withColumn(
        "c", F.col("score") - F.col("mean"))
    pooled = centred.agg(F.stddev_pop("c")).scalar()
    scaled = centred.withColumn("sd", pooled)
    divisor = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return scaled.withColumn("score", F.round(F.col("c") / divisor, 9)).select(*sims.columns)


def hubness_csls(sims: DataFrame, k: int = 10) -> DataFrame:
    """score - half the mean of the tag's k highest cosines. The k best per tag survive a WindowGroupLimit, so a
    tag's texts never gather in one task."""
    best = rank_list(sims, max(int(k), 1), keys=("tag_id",), tie=("text_id",)).groupBy("tag_id").agg(F.avg("score").alias("r"))
    return sims.join(best, "tag_id").withColumn("score", F.round(F.col("score") - F.col("r") * 0.5, 12)).select(*sims.columns)


def hubness_dsm(sims: DataFrame, arg: float = 1.0) -> DataFrame:
    """score - t * log-mean-exp(score / t) per tag, with t = arg pooled deviations of the centred table. The tag's
    maximum is taken out before exponentiating."""
    stats = sims.groupBy("tag_id").agg(F.avg("score").alias("mean"), F.max("score").alias("peak"))
    rows = sims.join(stats, "tag_id")
    pooled = rows.agg(F.stddev_pop(F.col("score") - F.col("mean"))).scalar()
    scaled = rows.withColumn("t", F.lit(float(arg)) * pooled)
    soft = scaled.groupBy("tag_id").agg(F.log(F.avg(F.exp((F.col("score") - F.col("peak")) / F.nullif("t", F.lit(0.0))))).alias("lme"))
    shifted = F.col("score") - F.col("peak") - F.col("t") * F.col("lme")
    return scaled.join(soft, "tag_id").withColumn(
        "score", F.round(F.when(F.col("t") > 0, shifted).otherwise(F.col("score")), 9)).select(*sims.columns)


def global_unit(sims: DataFrame) -> DataFrame:
    """Subtract the overall mean and divide by the overall deviation (0: only subtract)."""
    stats = sims.agg(F.struct(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))).scalar()
    rows = sims.withColumn("st", stats)
    divisor = F.when(F.col("st.sd") > 0, F.col("st.sd")).otherwise(F.lit(1.0))
    return rows.withColumn("score", F.round((F.col("score") - F.col("st.mean")) / divisor, 9)).select(*sims.columns)


def score_ensemble(tables: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted mean of unit-free score tables over the same (text, tag) pairs, rescaled to unit deviation."""
    weights = [1.0] * len(tables) if weights is None else list(weights)
    total = float(sum(weights))
    parts = [t.select("text_id", "tag_id", (F.col("score") * F.lit(w / total)).alias("s")) for t, w in zip(tables, weights)]
    mean = union_all(parts).groupBy("text_id", "tag_id").agg(F.sum("s").alias("s"))
    sd = mean.agg(F.stddev_pop("s")).scalar()
    divisor = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return mean.withColumn("sd", sd).select("text_id", "tag_id", F.round(F.col("s") / divisor, 9).alias("score"))


def top_tags(sims: DataFrame, m: int) -> DataFrame:
    """The m best tags per text from a (corrected) score table."""
    return rank_list(sims, m, keys=("text_id",), tie=("tag_id",))


def _unit_components(df: DataFrame, owner: str) -> DataFrame:
    """(owner, dim, x) of unit vectors."""
    parts = df.select(owner, F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "x"))
    return _unit_long(parts, owner)


def _unit_long(parts: DataFrame, owner: str) -> DataFrame:
    length = parts.groupBy(owner).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    safe = F.when(F.col("len") == 0, F.lit(1.0)).otherwise(F.col("len"))
    return parts.join(length, owner).select(owner, "dim", (F.col("x") / safe).alias("x"))


def tag_prototypes(titles: DataFrame, roles: DataFrame, bridge: DataFrame, a: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., tag_id, vec): a * unit(title) + (1 - a) * unit(sum of the unit role vectors carrying the tag); a
    tag no role carries keeps its unit title. Summed per (tag, dimension), so a tag carried by a third of all
    roles is combined map-side. `bridge` may carry extra keys (a training half)."""
    title = _unit_components(titles.select("tag_id", "vec"), "tag_id").withColumnRenamed("x", "tx")
    member = bridge.select(*keys, "role_id", "tag_id").distinct().join(_unit_components(roles, "role_id"), "role_id")
    sums = member.groupBy(*keys, "tag_id", "dim").agg(F.sum("x").alias("x"))
    length = sums.groupBy(*keys, "tag_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    safe = F.when(F.col("len") == 0, F.lit(1.0)).otherwise(F.col("len"))
    proto = sums.join(length, [*keys, "tag_id"]).select(*keys, "tag_id", "dim", (F.col("x") / safe).alias("px"))
    if keys:
        frame = bridge.select(*keys).distinct()
        values = F.array_distinct(F.collect_list(F.struct(*keys)))
        halves = frame.agg(values).scalar()
        title = title.withColumn("h", F.explode(halves)).select(*[F.col(f"h.{k}").alias(k) for k in keys], "tag_id", "dim", "tx")
    mixed = title.join(proto, [*keys, "tag_id", "dim"], "left").select(
        *keys, "tag_id", "dim", F.when(F.col("px").isNull(), F.col("tx"))
        .otherwise(F.lit(a) * F.col("tx") + F.lit(1.0 - a) * F.col("px")).alias("x"))
    return mixed.groupBy(*keys, "tag_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))


def role_knn_tags(texts: DataFrame, roles: DataFrame, bridge: DataFrame, tau: float) -> DataFrame:
    """(text_id, tag_id, score): softmax(cosine to the roles / tau) pushed through the role-tag bridge; tags without weight
    have no row.

    A role brings its tags into the block product. A pair of blocks gives, per text, the largest exponent it saw, the sum
    of its weights and their sums per tag; blocks are then put on the scale of the text's largest exponent and added up. So
    no text meets a role in a row of its own."""
    tags = bridge.select("role_id", "tag_id").distinct().groupBy("role_id").agg(F.sort_array(F.collect_set(F.col("tag_id").cast("double"))).alias("t"))
    held = roles.select("role_id", "vec").join(tags, "role_id", "left").withColumn("t", F.coalesce("t", F.array().cast("array<double>")))
    width = held.agg(F.max(F.size("t"))).first()[0] or 0
    # Tag ids as numbers, filled up to one length with what no tag is.
    carried = held.select("role_id", F.concat("t", F.array_repeat(F.lit(float("nan")), F.lit(width) - F.size("t"))).alias("p"))

    def emit(text_ids, role_ids, cosines, numbers):
        z = cosines / tau
        peak = z.max(axis=1)
        weights = np.exp(z - peak[:, None])
        role, slot = np.nonzero(~np.isnan(numbers))
        names, place = np.unique(numbers[role, slot], return_inverse=True)
        carries = np.zeros((len(role_ids), len(names) + 1))
        carries[role, place] = 1.0
        carries[:, -1] = 1.0                                    # the last column adds up all weights
        sums = weights @ carries
        return pd.DataFrame({"text_id": np.repeat(text_ids, sums.shape[1]), "tag_id": pd.array([*names.astype(np.int64), None] * len(text_ids), dtype="Int64"),
                             "peak": np.repeat(peak, sums.shape[1]), "mass": sums.ravel()})

    parts = checkpoint(carried_products(texts.select("text_id", "vec"), held.select("role_id", "vec"), carried, emit, "text_id long, tag_id long, peak double, mass double", "text_id", "role_id"))
    top = parts.where(F.col("tag_id").isNull()).groupBy("text_id").agg(F.max("peak").alias("top"))
    sums = parts.join(top, "text_id").groupBy("text_id", "tag_id").agg(F.sum(F.col("mass") * F.exp(F.col("peak") - F.col("top"))).alias("mass"))
    total = sums.where(F.col("tag_id").isNull()).select("text_id", F.col("mass").alias("total"))
    return sums.where(F.col("tag_id").isNotNull()).join(total, "text_id").select("text_id", "tag_id", F.round(F.col("mass") / F.col("total"), 9).alias("score"))


def centred_unit(scores: DataFrame) -> DataFrame:
    """A full (text_id, tag_id, score) table with every tag's mean taken off, over the deviation of all that is left."""
    means = scores.groupBy("tag_id").agg(F.avg("score").alias("mean"))
    centred = scores.join(means, "tag_id").select("text_id", "tag_id", (F.col("score") - F.col("mean")).alias("c"))
    sd = centred.agg(F.stddev_pop("c")).scalar()
    return centred.withColumn("sd", sd).select("text_id", "tag_id", F.round(F.col("c") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)), 9).alias("score"))


def gold_tag_metrics(predicted: DataFrame, gold: DataFrame, texts: DataFrame, ms: Sequence[int] = (5, 10, 20, 30)) -> DataFrame:
    """(text_id, m, precision, recall, hit) of the top-m predicted tags; gold size is floored at 1."""
    hits = predicted.where(F.col("rank") <= max(ms)).join(
        gold.select("text_id", "tag_id").distinct(), ["text_id", "tag_id"], "left_semi")
    grid = F.array(*[F.lit(int(m)) for m in ms])
    found = (hits.withColumn("m", F.explode(grid)).where(F.col("rank") <= F.col("m"))
             .groupBy("text_id", "m").agg(F.count(F.lit(1)).alias("hits")))
    size = gold.select("text_id", "tag_id").distinct().groupBy("text_id").agg(F.count(F.lit(1)).alias("n_gold"))
    frame = texts.select("text_id").distinct().withColumn("m", F.explode(grid))
    rows = frame.join(found, ["text_id", "m"], "left").join(size, "text_id", "left")
    h = F.coalesce("hits", F.lit(0))
    return rows.select("text_id", "m", (h / F.col("m")).alias("precision"),
                       (h / F.greatest(F.coalesce("n_gold", F.lit(0)), F.lit(1))).alias("recall"),
                       (h > 0).cast("double").alias("hit"))
