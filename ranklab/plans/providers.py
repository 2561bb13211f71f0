"""The provider bench: the tag channel tuned on dev queries, then measured on test queries beside the other channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ranklab.operators.bootstrap import boot_draws, bootstrap_ci
from ranklab.operators.fusion import rrf_fuse_n
from ranklab.operators.metrics import (condensed_lists, metrics_per_query, outside_pool_found, to_long, ungraded_counts, unique_positive_summary)
from ranklab.operators.ordering import rank_list
from ranklab.operators.pools import permuted_control
from ranklab.operators.roles import grid_select
from ranklab.session import checkpoint, union_all

CELL = ["m_doc", "m_query", "b"]


def _each(name: str, values: Sequence[float]) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


def tag_grid(doc_tags: DataFrame, query_tags: DataFrame, docs: DataFrame, ms: Sequence[int], bs: Sequence[float], k1: float = 1.2,
             cells: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """(m_doc, m_query, b, query_id, doc_id, score) of the BM25 tag channel for every cut of both sides' ranked tags.

    doc_tags(doc_id, tag_id, rank) and query_tags(query_id, tag_id, rank) hold tags best first. A cell keeps the m_doc best
    tags of a document and the m_query best of a query; document frequencies and lengths follow the cut. The sides are
    joined once: a shared tag carries its idf under every cut it survives, and one aggregation per pair adds up all cells,
    of which b is only a factor. Scores that are not positive go."""
    cells = list(cells) if cells is not None else [(a, c) for a in ms for c in ms]
    cuts = sorted({a for a, _ in cells})
    d = doc_tags.where(F.col("rank") <= max(cuts)).select("doc_id", "tag_id", F.col("rank").alias("rd"))
    q = query_tags.where(F.col("rank") <= max(c for _, c in cells)).select("query_id", "tag_id", F.col("rank").alias("rq"))
    n_docs = docs.select("doc_id").distinct().agg(F.count(F.lit(1))).scalar()
    df = d.groupBy("tag_id").agg(*[F.count_if(F.col("rd") <= a).alias(f"df{a}") for a in cuts]).withColumn("n", n_docs)
    idf = df.select("tag_id", *[F.log1p((F.col("n") - F.col(f"df{a}") + 0.5) / (F.col(f"df{a}") + 0.5)).alias(f"idf{a}") for a in cuts])
    sums = d.join(idf, "tag_id").join(q, "tag_id").groupBy("query_id", "doc_id").agg(
        *[F.sum(F.when((F.col("rd") <= a) & (F.col("rq") <= c), F.col(f"idf{a}"))).alias(f"s{a}_{c}") for a, c in cells])
    lengths = d.groupBy("doc_id").agg(*[F.count_if(F.col("rd") <= a).alias(f"dl{a}") for a in cuts])
    averages = [F.greatest(d.agg(F.count_if(F.col("rd") <= a)).scalar() / n_docs, F.lit(1e-12)).alias(f"avg{a}") for a in cuts]
    every = F.array(*[F.struct(F.lit(a).alias("m_doc"), F.lit(c).alias("m_query"), F.col(f"s{a}_{c}").alias("s"), F.col(f"dl{a}").alias("dl"), F.col(f"avg{a}").alias("avg"))
                      for a, c in cells])
    # Rows meet by query before they become cells, so ranking the lists of the cells shuffles nothing more.
    wide = sums.join(lengths, "doc_id").select("*", *averages).repartition("query_id")
    cell = wide.select("query_id", "doc_id", F.explode(F.filter(every, lambda x: x["s"].isNotNull())).alias("x")).select("query_id", "doc_id", "x.*").select("*", _each("b", [float(b) for b in bs]))
    factor = (k1 + 1.0) / (1.0 + k1 * (1.0 - F.col("b") + F.col("b") * F.col("dl") / F.col("avg")))
    return cell.select(*CELL, "query_id", "doc_id", F.round(factor * F.col("s"), 9).alias("score")).where(F.col("score") > 0)


def grid_recall(scores: DataFrame, gains: DataFrame, queries: DataFrame, ms: Sequence[int], bs: Sequence[float], k: int = 50) -> DataFrame:
    """(m_doc, m_query, b, value): mean recall at k over the queries, of every cell, cells without a list too."""
    lists = rank_list(scores.join(queries.select("query_id"), "query_id", "left_semi"), k, keys=(*CELL, "query_id"))
    frame = queries.select("query_id").distinct().select("query_id", _each("m_doc", ms)).select("*", _each("m_query", ms)).select("*", _each("b", [float(b) for b in bs]))
    per = metrics_per_query(lists, gains, (k,), queries=frame, by=CELL)
    return per.groupBy(*CELL).agg(F.avg(f"r_{k}").alias("value"))


def tuned_tag_channel(doc_tags: DataFrame, query_tags: DataFrame, docs: DataFrame, gains: DataFrame, dev: DataFrame, ms: Sequence[int],
                      bs: Sequence[float], k1: float = 1.2, k: int = 50) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(grid, selected, tag lists of all queries, control lists): the cell with the best recall at k on the dev queries,
    ties to fewer tags on either side and to the b nearest 0.75. The control gives every query another one's tags."""
    doc_tags, query_tags = checkpoint(doc_tags), checkpoint(query_tags)
    on_dev = query_tags.join(dev.select("query_id"), "query_id", "left_semi")
    grid = checkpoint(grid_recall(tag_grid(doc_tags, on_dev, docs, ms, bs, k1), gains, dev, ms, bs, k))
    selected = checkpoint(grid_select(grid, "value", [F.col("m_doc"), F.col("m_query"), F.abs(F.col("b") - 0.75), F.col("b")]))
    best = selected.first()
    swapped = permuted_control(query_tags.where(F.col("rank") <= best.m_query)).withColumn("rank", F.lit(1))
    lists = [checkpoint(rank_list(tag_grid(doc_tags, q, docs, ms, [best.b], k1, [(best.m_doc, best.m_query)]).drop(*CELL))) for q in (query_tags, swapped)]
    return grid, selected, *lists


def channel_report(channels: dict[str, DataFrame], gains: DataFrame, queries: DataFrame, n_boot: int = 2000, purpose: str = "sat/boot") -> DataFrame:
    """(system, metric, n, mean, lo, hi) of every channel over the queries; a channel without a list for a query scores 0."""
    lists = union_all([df.select(F.lit(n).alias("system"), "query_id", "doc_id", F.col("rank").cast("bigint").alias("rank")) for n, df in channels.items()])
    frame = queries.select("query_id").distinct().select(_each("system", list(channels)), "query_id")
    per = metrics_per_query(lists.join(queries.select("query_id"), "query_id", "left_semi"), gains, (5, 10, 20), (10, 20, 50, 100), frame, ["system"])
    return bootstrap_ci(to_long(per, ["system"]), boot_draws(queries, "query_id", n_boot, purpose=purpose), ["system", "metric"])


def fused_differences(channels: dict[str, DataFrame], judged: DataFrame, gains: DataFrame, queries: DataFrame, weights: Sequence[float] = (1.0, 0.5),
                      n_boot: int = 2000, purpose: str = "sat/boot") -> DataFrame:
    """(weight, treatment, metric, n, mean, lo, hi): three-list fusion with the tag channel at a weight, minus the two-list
    fusion `rrf2`, as lists are and without unjudged documents; one set of draws for all."""
    fused = {f"{w}": rrf_fuse_n([channels["bm25"], channels["dense"], channels["tag"]], [1.0, 1.0, w]) for w in weights} | {"rrf2": channels["rrf2"]}
    lists = union_all([df.select(F.lit(n).alias("system"), "query_id", "doc_id", F.col("rank").cast("bigint").alias("rank")) for n, df in fused.items()])
    lists = checkpoint(lists.join(queries.select("query_id"), "query_id", "left_semi"))
    by = ["treatment", "system"]
    both = union_all([lists.withColumn("treatment", F.lit("standard")), condensed_lists(lists, judged, ["system"]).withColumn("treatment", F.lit("condensed")).select(*lists.columns, "treatment")])
    frame = queries.select("query_id").distinct().select(_each("system", list(fused)), "query_id").select(_each("treatment", ["standard", "condensed"]), "*")
    long = checkpoint(to_long(metrics_per_query(both, gains, (10,), (10, 50, 100), frame, by), by))
    base = long.where("system = 'rrf2'").select("treatment", "query_id", "metric", F.col("value").alias("base"))
    diffs = long.where("system <> 'rrf2'").join(base, ["treatment", "query_id", "metric"]).select(
        F.col("system").cast("double").alias("weight"), "treatment", "metric", "query_id", (F.col("value") - F.col("base")).alias("value"))
    return bootstrap_ci(diffs, boot_draws(queries, "query_id", n_boot, purpose=purpose), ["weight", "treatment", "metric"])


def marginal_report(channels: dict[str, DataFrame], positives: DataFrame, queries: DataFrame, ks: Sequence[int] = (10, 20, 50)) -> DataFrame:
    """What each of the channels alone finds for the queries (k, channel, n_unique_hits, query_share, positive_share)."""
    lists = union_all([df.select(F.lit(n).alias("channel"), "query_id", "doc_id", "rank") for n, df in channels.items()])
    inside = lambda df: df.join(queries.select("query_id"), "query_id", "left_semi")
    return unique_positive_summary(inside(lists), inside(positives), queries, ks)


def label_gaps(channels: dict[str, DataFrame], judged: DataFrame, positives: DataFrame, ks: Sequence[int] = (10, 20, 50)) -> tuple[DataFrame, DataFrame]:
    """(ungraded tag-only pairs per k, positives outside the two-list pool and how many the tag channel has)."""
    others = union_all([channels[n].select("query_id", "doc_id", "rank") for n in ("bm25", "dense")])
    return ungraded_counts(channels["tag"], others, judged, ks), outside_pool_found(positives, channels["rrf2"], channels["tag"], max(ks))
