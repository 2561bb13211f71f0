"""Second-stage plans: recipes, fusion and the ablations over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ranklab.operators.bootstrap import bootstrap_ci, drawn_positions as boot_draws
from ranklab.operators.features import SCORE_FEATURES, normalize_by_query
from ranklab.operators.fusion import fuse_systems, order_by_feature
from ranklab.operators.ltr import rank_by_score
from ranklab.operators.metrics import condensed_lists, judged_share, mean_metrics, metric_columns, metrics_per_query, to_long
from ranklab.session import union_all

# The two recipes and their fusion weights.
FUSE_WEIGHTS = {"linz": 0.7, "noce": 0.3}


def zscored(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The table of the linz recipe: score features z-scored within each query."""
    return normalize_by_query(rows, [f for f in (*SCORE_FEATURES, "tag_score") if f in features], "zscore")


def recipe_lists(rows: DataFrame, linz: DataFrame, noce: DataFrame) -> dict[str, DataFrame]:
    """{system: ranked}: the fused order, linz (linear gain, z-scored score features), noce (exponential gain, raw
    features), both given by their out-of-fold scores, and their weighted fusion."""
    lists = {"rrf": order_by_feature(rows, "rrf_rank", descending=False), "linz": rank_by_score(linz, rows), "noce": rank_by_score(noce, rows)}
    lists["fused"] = fuse_systems([lists["linz"], lists["noce"]], [FUSE_WEIGHTS["linz"], FUSE_WEIGHTS["noce"]])
    return lists


def stack_systems(lists: dict[str, DataFrame]) -> DataFrame:
    """(system, query_id, doc_id, rank)."""
    return union_all([df.select(F.lit(name).alias("system"), "query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))
                      for name, df in lists.items()])


ABLATION = ["labels", "treatment", "system"]


def _under_labels(systems: DataFrame, label_sets: DataFrame) -> DataFrame:
    return systems.withColumn("labels", F.explode(label_sets.agg(F.sort_array(F.collect_set("labels"))).scalar()))


def ablation_metrics(systems: DataFrame, label_sets: DataFrame, gains: DataFrame) -> DataFrame:
    """Metrics of every query under every system x label set x {standard, condensed}: one long table and one metric pass
    cover all combinations. Inputs as in `downstream_ablation`."""
    spread = _under_labels(systems, label_sets)
    standard = spread.withColumn("treatment", F.lit("standard"))
    judged = condensed_lists(spread, label_sets, ["labels", "system"]).withColumn("treatment", F.lit("condensed"))
    long = union_all([df.select(*ABLATION, "query_id", "doc_id", "rank") for df in (standard, judged)])
    return metrics_per_query(long, gains, (5, 10, 20), by=ABLATION)


def ablation_means(per: DataFrame) -> DataFrame:
    return mean_metrics(per, ABLATION)


def ablation_differences(per: DataFrame, queries: DataFrame, n_boot: int = 2000, stages: Sequence[str] = ("rrf", "linz", "noce", "fused")) -> DataFrame:
    """Paired differences tag - base of every stage. Draws are made by the call, and both sides stand in one aggregation, so
    that metrics are made once."""
    side, stage = F.substring_index("system", "_", 1), F.substring_index("system", "_", -1)
    of = lambda name, c: F.max(F.when(side == name, F.col(c)))
    both = per.where(stage.isin(*stages) & side.isin("tag", "base")).groupBy("labels", "treatment", stage.alias("stage"), "query_id").agg(
        *[(of("tag", c) - of("base", c)).alias(c) for c in metric_columns(per, ABLATION)])
    diff = to_long(both, ["labels", "treatment", "stage"])
    draws = boot_draws(queries, "query_id", n_boot, purpose="downstream/boot")
    out = bootstrap_ci(diff, draws, ["labels", "treatment", "stage", "metric"])
    return out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def ablation_share(systems: DataFrame, label_sets: DataFrame) -> DataFrame:
    """Judged share of the fused lists under every label set."""
    fused = _under_labels(systems.where(F.col("system").endswith("_fused")), label_sets)
    return judged_share(fused, label_sets, (10,), fused.select("labels", "system", "query_id").distinct(), ["labels", "system"])


def downstream_ablation(systems: DataFrame, label_sets: DataFrame, gains: DataFrame, queries: DataFrame, n_boot: int = 2000,
                        stages: Sequence[str] = ("rrf", "linz", "noce", "fused")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(means, paired differences, judged share of the fused lists) over every system x label set x {standard, condensed}.

    `systems(system, query_id, doc_id, rank)` holds base_<stage> and tag_<stage>; `label_sets(labels, query_id,
    doc_id)` the judged pairs and `gains(labels, query_id, doc_id, gain)` their gains. Who wants one of the three calls the
    function that makes it."""
    per = ablation_metrics(systems, label_sets, gains)
    return ablation_means(per), ablation_differences(per, queries, n_boot, stages), ablation_share(systems, label_sets)
