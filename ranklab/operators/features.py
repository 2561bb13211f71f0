"""Candidate features, labels and per-query normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ranklab.functions.fits import avail_immediacy, budget_fit, seniority_fit, sentinel_date

PAIR = ["query_id", "doc_id"]
DEFAULT_FEATURES = ("bm25_score", "bm25_rank", "dense_cosine", "dense_rank", "rrf_score", "rrf_rank", "budget_fit",
                    "seniority_fit", "avail_immediacy")
SCORE_FEATURES = ("bm25_score", "dense_cosine", "rrf_score", "budget_fit", "seniority_fit", "avail_immediacy")


def candidate_features(fused: DataFrame, bm25: DataFrame, dense: DataFrame, gigs: DataFrame, providers: DataFrame,
                       grades: DataFrame, top: int = 50, as_of: Column | None = None) -> DataFrame:
    """One row per pooled pair: channel scores and ranks (a channel that did not return the pair: 0), the three
    term fits, the grade (NULL = unjudged) and `judged`."""
    as_of = F.lit("2026-10-01").cast("date") if as_of is None else as_of
    pool = fused.where(F.col("rank") <= top).select(*PAIR, F.round("score", 8).alias("rrf_score"), F.col("rank").alias("rrf_rank"))
    channel = lambda df, s, r: df.select(*PAIR, F.round("score", 6).alias(s), F.col("rank").alias(r))
    rows = (pool.join(channel(bm25, "bm25_score", "bm25_rank"), PAIR, "left")
            .join(channel(dense, "dense_cosine", "dense_rank"), PAIR, "left")
            .join(gigs, "query_id", "left").join(providers, "doc_id", "left")
            .join(grades.select(*PAIR, "grade"), PAIR, "left"))
    zero = F.lit(0.0)
    money = lambda c: F.coalesce(F.col(c), zero)
    return rows.select(
        *PAIR, F.col("grade").alias("label"), F.col("grade").isNotNull().cast("int").alias("judged"),
        F.coalesce("bm25_score", zero).alias("bm25_score"), F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"),
        F.coalesce("dense_cosine", zero).alias("dense_cosine"), F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"),
        "rrf_score", "rrf_rank",
        F.round(budget_fit(money("budget_lo"), money("budget_hi"), money("rate_per_hour")), 4).alias("budget_fit"),
        F.round(seniority_fit(F.col("seniority_needed"), F.col("seniority")), 4).alias("seniority_fit"),
        F.round(avail_immediacy(F.col("available_from"), F.col("start_by"), F.col("availability"), as_of), 4).alias("avail_immediacy"))


def tag_features(candidates: DataFrame, tag: DataFrame, raw: bool = True) -> DataFrame:
    """Add tag_score and tag_rank; an absent pair is 0 for the raw variant and NULL (missing) for the others."""
    joined = candidates.join(tag.select(*PAIR, F.round("score", 6).alias("tag_score"), F.col("rank").alias("tag_rank")), PAIR, "left")
    if raw:
        joined = joined.fillna({"tag_score": 0.0, "tag_rank": 0})
    return joined


def label_policy(candidates: DataFrame, policy: str = "judged") -> DataFrame:
    """Training rows: judged pairs only, or all pairs with unjudged counted as 0."""
    if policy == "judged":
        return candidates.where(F.col("label").isNotNull())
    if policy == "all":
        return candidates.withColumn("label", F.coalesce("label", F.lit(0)))
    raise ValueError(f"unknown label policy {policy!r}")


def pool_recall_loss(fused: DataFrame, grades: DataFrame, top: int = 50) -> DataFrame:
    """One row: relevant pairs (grade >= 2) and how many of them the pool misses."""
    inside = fused.where(F.col("rank") <= top).select(*PAIR, F.lit(1).alias("inside"))
    rows = grades.where(F.col("grade") >= 2).select(*PAIR).join(inside, PAIR, "left")
    return rows.agg(F.count(F.lit(1)).alias("n_relevant"), F.count_if(F.col("inside").isNull()).alias("n_outside"))


def swap_labels(candidates: DataFrame, grades: DataFrame) -> DataFrame:
    """The same candidates labelled by another label set."""
    out = candidates.drop("label", "judged").join(grades.select(*PAIR, F.col("grade").alias("label")), PAIR, "left")
    return out.withColumn("judged", F.col("label").isNotNull().cast("int"))


def normalize_by_query(rows: DataFrame, cols: Sequence[str], how: str = "zscore", query: str = "query_id") -> DataFrame:
    """Rescale features within each query: z-score with the population deviation (0 counts as 1), or 1 / dense rank
    (best = 1, ties equal). NULL and NaN are skipped and come back as NULL; a query with fewer than two values stays as it is.

    z-scores use one aggregation joined back, so a query with very many rows is combined map-side and AQE may
    split its rows; the rank form ranks the distinct values only."""
    if how == "none":
        return rows
    kinds = dict(rows.dtypes)
    for c in cols:
        if kinds[c] in ("double", "float"):
            rows = rows.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    if how == "zscore":
        aggs = [f(c).alias(f"{c}__{n}") for c in cols for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop))]
        stats = rows.groupBy(query).agg(*aggs)
        out = rows.join(stats, query)
        for c in cols:
            sd = F.col(f"{c}__sd")
            scaled = (F.col(c) - F.col(f"{c}__mean")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
            out = out.withColumn(c, F.when(F.col(f"{c}__n") >= 2, scaled).otherwise(F.col(c)))
        return out.select(*rows.columns)
    if how == "rank":
        out = rows
        for c in cols:
            values = rows.where(F.col(c).isNotNull()).groupBy(query, c).agg(F.count(F.lit(1)).alias("_n"))
            w = Window.partitionBy(query)
            ranked = values.select(query, c, F.row_number().over(w.orderBy(F.col(c).desc())).alias("_r"), F.sum("_n").over(w).alias("_all"))
            out = out.join(ranked, [query, c], "left").withColumn(
                c, F.when(F.col("_all") >= 2, F.lit(1.0) / F.col("_r")).otherwise(F.col(c))).drop("_r", "_all")
        return out.select(*rows.columns)
    raise ValueError(f"unknown normalisation {how!r}")


def binarise_examples(rows: DataFrame, positive_grade: int = 3) -> DataFrame:
    """grade >= positive -> 1, grade <= 1 -> 0, the ambiguous middle is left out."""
    y = F.when(F.col("grade") >= positive_grade, F.lit(1.0)).when(F.col("grade") <= 1, F.lit(0.0))
    return rows.withColumn("example", y).where(F.col("example").isNotNull())


# The three prompt forms of the external grader; only their layout and version names are kept here,
# the rubric text is a table the caller supplies.
PROMPT_VERSIONS = {"repro": "rubric_0_3.v2-repro", "orig": "rubric_0_3.v2-orig-text", "cont": "rubric_0_1.v2-cont"}


def _number(c: Column) -> Column:
    """A number as printed by %g: at most 6 significant digits, no trailing zeros."""
    science = F.format_string("%.5e", c)
    exponent = F.substring_index(science, "e", -1).cast("int")
    # one format and one pattern a number: an array of all formats would be made whole, and again wherever it is read
    digits = F.lit(5) - F.least(F.greatest(exponent, F.lit(-4)), F.lit(5))
    fixed = F.call_function("format_string", F.concat(F.lit("%."), digits.cast("string"), F.lit("f")), c)
    short = lambda x: F.regexp_replace(x, r"\.0*$|(\.[0-9]*?)0+$", "$1")
    scientific = F.concat(short(F.substring_index(science, "e", 1)), F.lit("e"), F.substring_index(science, "e", -1))
    return F.when(c == 0, "0").when(exponent.between(-4, 5), short(fixed)).otherwise(scientific)


def _day(value: Column, as_of: Column) -> Column:
    return F.date_format(sentinel_date(value, as_of), "d MMM yyyy")


def _days_a_week(n: Column) -> Column:
    whole = n.cast("int")
    return F.concat(whole.cast("string"), F.when(whole == 1, F.lit(" day a week")).otherwise(F.lit(" days a week")))


def _filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def gig_terms(as_of: Column) -> Column:
    """Terms of a gig, one line each; missing values leave their line out."""
    return F.array_compact(F.array(
        F.concat(F.lit("Budget: S$"), _number(F.col("budget_lo")), F.lit("-"), _number(F.col("budget_hi")), F.lit(" per hour")),
        F.concat(F.lit("Seniority needed: "), _filled("seniority_needed")),
        F.concat(F.lit("Start date: "), _day(F.col("start_by"), as_of)),
        F.concat(F.lit("Commitment: "), _days_a_week(F.col("commitment")))))


def provider_terms(as_of: Column) -> Column:
    dated = F.concat(F.lit("Availability: from "), _day(F.col("available_from"), as_of), F.lit(", "), _days_a_week(F.col("capacity")))
    return F.array_compact(F.array(
        F.concat(F.lit("Rate: S$"), _number(F.col("rate_per_hour")), F.lit(" per hour")),
        F.concat(F.lit("Seniority: "), _filled("seniority")),
        F.coalesce(dated, F.concat(F.lit("Availability: "), _filled("availability")))))


def grading_requests(pairs: DataFrame, gigs: DataFrame, providers: DataFrame, rubrics: DataFrame, variant: str = "repro",
                     as_of: Column | None = None) -> DataFrame:
    """(query_id, doc_id, prompt_version, prompt): the request table of an external grader.

    rubrics(variant, rubric, gig_head, provider_head, closing) has one row per prompt form; gigs and providers
    carry `text` and their terms."""
    if variant not in PROMPT_VERSIONS:
        raise ValueError(f"no prompt form {variant!r}; there are {', '.join(PROMPT_VERSIONS)}")
    as_of = F.lit("2026-10-01").cast("date") if as_of is None else as_of
    g = gigs.select("query_id", F.col("text").alias("gig_text"), gig_terms(as_of).alias("gig_terms"))
    p = providers.select("doc_id", F.col("text").alias("provider_text"), provider_terms(as_of).alias("provider_terms"))
    return prompts(pairs.select(*PAIR).join(g, "query_id").join(p, "doc_id"), rubrics, variant)


def prompts(rows: DataFrame, rubrics: DataFrame, variant: str = "repro") -> DataFrame:
    """The requests of rows(query_id, doc_id, gig_text, gig_terms, provider_text, provider_terms), which need no join."""
    form = rubrics.where(F.col("variant") == variant).select(
        F.struct("rubric", "gig_head", "provider_head", "closing")).scalar()
    rows = rows.withColumn("form", form)
    lines = F.concat(
        F.array(F.col("form.rubric"), F.lit(""), F.concat(F.col("form.gig_head"), F.col("gig_text"))), F.col("gig_terms"),
        F.array(F.lit(""), F.concat(F.col("form.provider_head"), F.col("provider_text"))), F.col("provider_terms"),
        F.array(F.lit(""), F.col("form.closing")))
    return rows.select(*PAIR, F.lit(PROMPT_VERSIONS[variant]).alias("prompt_version"), F.array_join(lines, "\n").alias("prompt"))


def bucket_budget(hi: Column, rate: Column) -> Column:
    return (F.when(rate <= hi, "within or under").when(rate <= hi * 1.15, "<=15% over")
            .when(rate <= hi * 1.4, "15-40% over").otherwise(">40% over"))


def bucket_start(late_days: Column) -> Column:
    return (F.when(late_days <= 0, "on time").when(late_days <= 14, "<=14 days late")
            .when(late_days <= 30, "15-30 days late").otherwise(">30 days late"))


def bucket_days(short: Column) -> Column:
    return F.when(short <= 0, "enough").when(short == 1, "1 day short").otherwise(">=2 days short")


def bucket_seniority(diff: Column) -> Column:
    return F.when(diff == 0, "same level").when(diff == 1, "one level apart").otherwise("mid vs expert")


def label_distribution(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, bucket, pairs, g0..g3, share_ge2): grades by every dimension in one aggregation; an array-valued
    dimension (pool sources) counts a pair under each element."""
    parts = []
    for name, expr in dimensions.items():
        parts.append(F.struct(F.lit(name).alias("dimension"), expr.alias("bucket")))
    long = rows.withColumn("d", F.explode(F.array(*parts))).where(F.col("d.bucket").isNotNull())
    return long.groupBy(F.col("d.dimension").alias("dimension"), F.col("d.bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("pairs"), *[F.count_if(F.col("grade") == g).alias(f"g{g}") for g in range(4)],
        F.round(F.avg((F.col("grade") >= 2).cast("double")), 6).alias("share_ge2"))


def positives_per_query(grades: DataFrame) -> DataFrame:
    """(n_positive, n_queries): queries by number of documents graded >= 2."""
    per = grades.groupBy("query_id").agg(F.count_if(F.col("grade") >= 2).alias("n"))
    return per.groupBy(F.col("n").alias("n_positive")).agg(F.count(F.lit(1)).alias("n_queries"))
