"""Agreement between raters, calibration reports and audit scoring."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ranklab.functions.intervals import newcombe, wilson
from ranklab.functions.lexicon import BAND_CUTS
from ranklab.operators.metrics import auc, spearman_by
from ranklab.operators.ordering import upper_median

GRADES = (0, 1, 2, 3)


def band_grade(score: Column) -> Column:
    """0-3 grade of a 0-1 score: the number of band cuts it reaches."""
    return reduce(lambda acc, cut: acc + (score >= F.lit(cut)).cast("int"), BAND_CUTS, F.lit(0))


def _grid(spark: SparkSession, labels: Sequence[int]) -> DataFrame:
    return (spark.range(1).select(F.explode(F.array(*[F.lit(int(x)) for x in labels])).alias("a"))
            .withColumn("b", F.explode(F.array(*[F.lit(int(x)) for x in labels]))))


def confusion_matrix(pairs: DataFrame, labels: Sequence[int] = GRADES, by: Sequence[str] = ()) -> DataFrame:
    """(by..., a, b, n) over the full label grid, zeros included."""
    by = list(by)
    counts = pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    if by:
        cells = F.array(*[F.struct(F.lit(int(x)).alias("a"), F.lit(int(y)).alias("b")) for x in labels for y in labels])
        frame = counts.select(*by).distinct().withColumn("cell", F.explode(cells)).select(*by, "cell.a", "cell.b")
    else:
        frame = _grid(pairs.sparkSession, labels)
    return frame.join(counts, [*by, "a", "b"], "left").select(*by, "a", "b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def cohen_kappa(pairs: DataFrame, labels: Sequence[int] = GRADES, weights: str | None = None,
                by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, kappa) of columns a, b; an expected disagreement of 0 gives 1."""
    by = list(by)
    index = {int(x): i for i, x in enumerate(labels)}
    place = lambda c: reduce(lambda acc, kv: acc.when(F.col(c) == kv[0], F.lit(kv[1])), index.items(), F).otherwise(F.lit(None))
    grid = confusion_matrix(pairs, labels, by)
    grid = grid.withColumn("i", place("a")).withColumn("j", place("b"))
    totals = Window.partitionBy(*by)
    rows, cols = Window.partitionBy(*by, "a"), Window.partitionBy(*by, "b")
    gap = F.col("i") - F.col("j")
    if weights == "quadratic":
        width = max(len(labels) - 1, 1)
        weight = gap * gap / F.lit(float(width * width))
    else:
        weight = (gap != 0).cast("double")
    cells = (grid.withColumn("total", F.sum("n").over(totals)).withColumn("row", F.sum("n").over(rows))
             .withColumn("col", F.sum("n").over(cols)).withColumn("w", weight))
    total = F.nullif(F.col("total").cast("double"), F.lit(0.0))
    aggs = [F.max("total").alias("n"), F.sum(F.col("w") * F.col("n") / total).alias("observed"),
            F.sum(F.col("w") * F.col("row") / total * F.col("col") / total).alias("expected")]
    out = cells.groupBy(*by).agg(*aggs) if by else cells.agg(*aggs)
    kappa = F.when(F.col("expected") > 0, F.lit(1.0) - F.col("observed") / F.col("expected")).otherwise(F.lit(1.0))
    return out.select(*by, "n", kappa.alias("kappa"))


def binary_kappa(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, kappa) of 0/1 columns; NULL when there is nothing to compare or chance agreement is 1."""
    by = list(by)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"),
            F.avg(F.col("a").cast("double")).alias("pa"), F.avg(F.col("b").cast("double")).alias("pb")]
    out = pairs.groupBy(*by).agg(*aggs) if by else pairs.agg(*aggs)
    pe = F.col("pa") * F.col("pb") + (F.lit(1.0) - F.col("pa")) * (F.lit(1.0) - F.col("pb"))
    return out.select(*by, "n", ((F.col("po") - pe) / F.nullif(F.lit(1.0) - pe, F.lit(0.0))).alias("kappa"))


def calibration_report(pairs: DataFrame) -> DataFrame:
    """One row for pairs(a = original grade, b = regrade, expected): exact, within one, quadratic kappa,
    kappa of grade >= 2."""
    base = pairs.agg(F.count(F.lit(1)).alias("n"),
                     F.avg((F.col("a") == F.col("b")).cast("double")).alias("exact"),
                     F.avg((F.abs(F.col("a") - F.col("b")) <= 1).cast("double")).alias("within_one"))
    qwk = cohen_kappa(pairs, GRADES, "quadratic").select("kappa")
    high = pairs.select((F.col("a") >= 2).cast("int").alias("a"), (F.col("b") >= 2).cast("int").alias("b"))
    ge2 = cohen_kappa(high, (0, 1)).select("kappa")
    return base.select("n", F.round("exact", 6).alias("exact"), F.round("within_one", 6).alias("within_one"),
                       F.round(qwk.scalar(), 6).alias("quadratic_kappa"), F.round(ge2.scalar(), 6).alias("kappa_ge2"))


def expected_by_assigned(pairs: DataFrame) -> DataFrame:
    """(grade, n, mean_expected_grade) for every grade."""
    grid = _grid(pairs.sparkSession, GRADES).select(F.col("a").alias("grade")).distinct()
    stats = pairs.groupBy(F.col("b").alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.avg("expected").alias("m"))
    return grid.join(stats, "grade", "left").select("grade", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                                                    F.round("m", 6).alias("mean_expected_grade"))


def continuous_by_grade(pairs: DataFrame) -> DataFrame:
    """(grade, n, mean, median, min, max) of a continuous score per original grade a; the median is the upper one."""
    grid = _grid(pairs.sparkSession, GRADES).select(F.col("a").alias("grade")).distinct()
    graded = pairs.select(F.col("a").alias("grade"), "score")
    stats = graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"),
                                        F.min("score").alias("min"), F.max("score").alias("max"))
    middle = upper_median(graded, "score", ["grade"])
    return grid.join(stats, "grade", "left").join(middle, "grade", "left").select(
        "grade", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.round("mean", 6).alias("mean"),
        F.round("median", 6).alias("median"), F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


def continuous_calibration(pairs: DataFrame) -> DataFrame:
    """One row for pairs(a = original grade, score): rank agreement, AUC at each boundary, banded agreement, share
    of scores in the gaps between bands, distinct scores, share ending in 0 or 5 hundredths."""
    banded = pairs.withColumn("b", band_grade(F.col("score")))
    s = F.col("score")
    in_gap = ((s > 0.15) & (s < 0.20)) | ((s > 0.45) & (s < 0.55)) | ((s > 0.80) & (s < 0.85))
    hundredths = F.bround(s * 100, 0).cast("bigint")
    base = banded.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("exact"),
        F.avg((F.abs(F.col("a") - F.col("b")) <= 1).cast("double")).alias("within_one"),
        F.avg(in_gap.cast("double")).alias("gap"), F.count_distinct("score").alias("distinct_scores"),
        F.avg((F.pmod(hundredths, F.lit(5)) == 0).cast("double")).alias("round5"))
    rho = spearman_by(pairs.select(F.col("a").cast("double").alias("a"), "score"), "a", "score").select("spearman")
    cuts = {g: auc(pairs.select("score", (F.col("a") >= g).cast("int").alias("y")), "score", "y").select("auc")
            for g in (1, 2, 3)}
    qwk = cohen_kappa(banded, GRADES, "quadratic").select("kappa")
    high = banded.select((F.col("a") >= 2).cast("int").alias("a"), (F.col("b") >= 2).cast("int").alias("b"))
    ge2 = cohen_kappa(high, (0, 1)).select("kappa")
    return base.select(
        "n", F.round(rho.scalar(), 6).alias("spearman"),
        *[F.round(df.scalar(), 6).alias(f"auc_ge{g}") for g, df in cuts.items()],
        F.round("exact", 6).alias("banded_exact"), F.round("within_one", 6).alias("banded_within_one"),
        F.round(qwk.scalar(), 6).alias("banded_quadratic_kappa"), F.round(ge2.scalar(), 6).alias("banded_kappa_ge2"),
        F.round("gap", 6).alias("share_in_gaps"), "distinct_scores", F.round("round5", 6).alias("share_round5"))


def agreement_2x2(pool: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Over pooled pairs: both relevant, only a, only b, neither, and the agreement rate. `a` and `b` hold
    (query_id, doc_id, relevant); a missing pair is not relevant."""
    pair = ["query_id", "doc_id"]
    rows = (pool.select(*pair).distinct()
            .join(a.select(*pair, F.col("relevant").alias("ra")), pair, "left")
            .join(b.select(*pair, F.col("relevant").alias("rb")), pair, "left")
            .select(F.coalesce("ra", F.lit(False)).alias("ra"), F.coalesce("rb", F.lit(False)).alias("rb")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ra") & F.col("rb")).alias("both_relevant"),
                    F.count_if(F.col("ra") & ~F.col("rb")).alias("only_a"),
                    F.count_if(~F.col("ra") & F.col("rb")).alias("only_b"),
                    F.count_if(~F.col("ra") & ~F.col("rb")).alias("neither"),
                    F.round(F.avg((F.col("ra") == F.col("rb")).cast("double")), 6).alias("agreement"))


def proportion_ci(rows: DataFrame, group: Sequence[str], flag: str) -> DataFrame:
    """(group..., k, n, rate, lo, hi) with Wilson bounds."""
    counts = rows.groupBy(*group).agg(F.count_if(F.col(flag)).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return counts.select(*group, "k", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"),
                         F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def proportion_difference(rows: DataFrame, group: str, first, second, flag: str) -> DataFrame:
    """One row: p(first) - p(second) with Newcombe's interval."""
    k1, n1 = F.count_if((F.col(group) == first) & F.col(flag)), F.count_if(F.col(group) == first)
    k2, n2 = F.count_if((F.col(group) == second) & F.col(flag)), F.count_if(F.col(group) == second)
    counts = rows.agg(k1.alias("k1"), n1.alias("n1"), k2.alias("k2"), n2.alias("n2"))
    d, lo, hi = newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return counts.select("k1", "n1", "k2", "n2", F.round(d, 6).alias("difference"), F.round(lo, 6).alias("lo"),
                         F.round(hi, 6).alias("hi"))


def join_audit(key: DataFrame, grades: DataFrame) -> DataFrame:
    """Audit key with the second rater's grade; an ungraded item stops the job."""
    joined = key.join(grades.select("item", F.col("grade").alias("audit_grade")), "item", "left")
    return joined.withColumn("audit_grade", F.when(
        F.col("audit_grade").isNull(), F.raise_error(F.concat(F.lit("ungraded item "), F.col("item").cast("string"))))
        .otherwise(F.col("audit_grade")).cast("int"))


def audit_score(rows: DataFrame) -> DataFrame:
    """Per stratum and over all ('ALL'): exact agreement, agreement on >= 2 with Wilson bounds, kappa, how often the
    audit is lower or higher. rows(stratum, grade, audit_grade)."""
    both = rows.withColumn("stratum", F.explode(F.array(F.lit("ALL"), F.col("stratum"))))
    qp, ap = F.col("grade") >= 2, F.col("audit_grade") >= 2
    counts = both.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") == F.col("audit_grade")).alias("same"),
        F.count_if(qp == ap).alias("agree"), F.count_if(F.col("grade") > F.col("audit_grade")).alias("audit_lower"),
        F.count_if(F.col("grade") < F.col("audit_grade")).alias("audit_higher"),
        F.count_if(qp).alias("rater_ge2"), F.count_if(ap).alias("audit_ge2"))
    kappa = binary_kappa(both.select("stratum", qp.cast("int").alias("a"), ap.cast("int").alias("b")), ["stratum"])
    lo, hi = wilson(F.col("agree"), F.col("n"))
    return counts.join(kappa.select("stratum", "kappa"), "stratum").select(
        "stratum", "n", F.round(F.col("same") / F.col("n"), 6).alias("exact"), "agree",
        F.round(lo, 6).alias("agree_lo"), F.round(hi, 6).alias("agree_hi"), F.round("kappa", 6).alias("kappa"),
        "audit_lower", "audit_higher", "rater_ge2", "audit_ge2")


def confirmed_by_confidence(rows: DataFrame) -> DataFrame:
    """Among the rater's grades >= 2: how many the audit confirms, per stratum and bin of the rater's P(>= 2)."""
    p = F.col("p_ge2")
    bin_ = (F.when(p < 0.6, "[0.00,0.60)").when(p < 0.8, "[0.60,0.80)").when(p < 0.95, "[0.80,0.95)")
            .otherwise("[0.95,1.00]"))
    return rows.where(F.col("grade") >= 2).groupBy("stratum", bin_.alias("confidence")).agg(
        F.count_if(F.col("audit_grade") >= 2).alias("confirmed"), F.count(F.lit(1)).alias("n"))


def rater_vs_audit(rows: DataFrame, raters: dict[str, Column], groups: dict[str, Sequence[str]]) -> DataFrame:
    """Several binary raters against one audit, per stratum, per named group of strata, and over everything.

    rows(stratum, audit_grade, ...). Raters are unpivoted and each row is tagged with the groups it belongs to,
    so one aggregation yields every (group, rater)."""
    rater_structs = F.array(*[F.struct(F.lit(name).alias("rater"), rel.alias("rel")) for name, rel in raters.items()])
    tags = [F.lit("all"), F.col("stratum")]
    tags += [F.when(F.col("stratum").isin(*members), F.lit(name)) for name, members in groups.items()]
    long = (rows.withColumn("grp", F.explode(F.array_compact(F.array(*tags))))
            .withColumn("r", F.explode(rater_structs))
            .select("grp", "r.rater", F.col("r.rel").cast("int").alias("a"), (F.col("audit_grade") >= 2).cast("int").alias("b")))
    a, b = F.col("a") == 1, F.col("b") == 1
    counts = long.groupBy("grp", "rater").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a).alias("rated"), F.count_if(a & b).alias("both"),
        F.count_if(a & ~b).alias("rater_only"), F.count_if(~a & b).alias("audit_only"),
        F.avg((F.col("a") == F.col("b")).cast("double")).alias("agree"))
    kappa = cohen_kappa(long, (0, 1), by=["grp", "rater"]).select("grp", "rater", "kappa")
    return counts.join(kappa, ["grp", "rater"]).select(
        "grp", "rater", "n", "rated", "both", "rater_only", "audit_only", F.round("agree", 6).alias("agree"),
        F.round("kappa", 6).alias("kappa"))


def kept_by_raters(rows: DataFrame, raters: dict[str, Column], base: Column) -> DataFrame:
    """Of the base rater's positives: how many audit-confirmed and audit-rejected ones each other rater keeps, with
    Wilson bounds of the rejected share."""
    rater_structs = F.array(*[F.struct(F.lit(name).alias("rater"), rel.alias("rel")) for name, rel in raters.items()])
    long = rows.where(base).withColumn("r", F.explode(rater_structs))
    ok = F.col("audit_grade") >= 2
    counts = long.groupBy(F.col("r.rater").alias("rater")).agg(
        F.count_if(ok & F.col("r.rel")).alias("kept_confirmed"), F.count_if(ok).alias("n_confirmed"),
        F.count_if(~ok & F.col("r.rel")).alias("kept_rejected"), F.count_if(~ok).alias("n_rejected"))
    lo, hi = wilson(F.col("kept_rejected"), F.col("n_rejected"))
    return counts.select("*", F.round(lo, 6).alias("rejected_lo"), F.round(hi, 6).alias("rejected_hi"))
