"""The judgment log and the label sets made from it.

log(seq, query_id, doc_id, status, grade, score, probs, prompt_version) is append-only. The merge rules differ on
purpose: first wins when labels are added, last wins when a regrade replaces them, and seeding inserts what is
absent in priority order. All of them are min_by / max_by aggregates, combined map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ranklab.functions.fits import score_of_grade
from ranklab.functions.keys import key_to_long, seeded_key
from ranklab.functions.lexicon import DEFAULT_PROMPT_VERSION
from ranklab.operators.agreement import band_grade
from ranklab.operators.ordering import prefix_sum
from ranklab.session import union_all

PAIR = ["query_id", "doc_id"]


def grade_from_logprobs(records: DataFrame) -> DataFrame:
    """(…, probs, grade, expected_grade, status) from top_logprobs array<struct<token, logprob>>.

    Tokens are trimmed; the probabilities of the digits 0..3 are added and renormalised; the first maximum wins;
    without a digit the status is an error. Done inside the row with array functions."""
    entries = F.coalesce("top_logprobs", F.array().cast("array<struct<token:string,logprob:double>>"))

    def mass_of(grade: int) -> Column:
        def add(acc, e):
            return acc + F.when(F.trim(e["token"]) == str(grade), F.exp(e["logprob"])).otherwise(F.lit(0.0))
        return F.aggregate(entries, F.lit(0.0), add)

    rows = records.withColumn("mass", F.array(*[mass_of(g) for g in range(4)]))
    total = F.aggregate("mass", F.lit(0.0), lambda acc, x: acc + x)
    rows = rows.withColumn("p", F.when(total > 0, F.transform("mass", lambda x: x / total)))
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    expected = F.col("p")[1] + F.col("p")[2] * 2 + F.col("p")[3] * 3
    return rows.select(
        *[c for c in records.columns if c not in ("top_logprobs", "status")],
        F.when(F.col("p").isNull(), "error: no grade token in top_logprobs").otherwise("ok").alias("status"),
        F.transform("p", lambda x: F.round(x, 4)).alias("probs"), best.alias("grade"), F.round(expected, 4).alias("expected_grade"))


def score_from_text(text: Column) -> Column:
    """The first standalone decimal of a grader's answer, if it is in [0, 1], else NULL: of the runs of digits and dots
    the first that is 0, 1 or a fraction with at most one such digit before the point."""
    def is_decimal(run: Column) -> Column:
        whole, point, fraction = F.substring_index(run, ".", 1), F.instr(run, "."), F.substring_index(run, ".", -1)
        dots = F.length(run) - F.length(F.replace(run, F.lit("."), F.lit("")))
        return F.when(point == 0, run.isin("0", "1")).otherwise((dots == 1) & whole.isin("", "0", "1") & (fraction != ""))

    value = F.get(F.filter(F.split(F.coalesce(text, F.lit("")), "[^0-9.]+"), is_decimal), F.lit(0)).try_cast("double")
    return F.when(value.between(0, 1), value)


def continuous_grades(records: DataFrame) -> DataFrame:
    """Score and band grade from `generated`; no score in the answer is an error record."""
    scored = records.withColumn("score", score_from_text(F.col("generated")))
    return scored.withColumn("grade", F.when(F.col("score").isNotNull(), band_grade(F.col("score")))).withColumn(
        "status", F.when(F.col("score").isNull(), "error: no score in output").otherwise("ok"))


def ok_records(log: DataFrame) -> DataFrame:
    return log.where(F.col("status") == "ok")


def pending_pairs(wanted: DataFrame, log: DataFrame, seed: int = 7, limit: int | None = None) -> DataFrame:
    """Wanted pairs without an ok record (errors are retried), with their place `order_key` in a seeded order."""
    todo = wanted.select(*PAIR).distinct().join(ok_records(log).select(*PAIR), PAIR, "left_anti").withColumn(
        "order_key", seeded_key(seed, "pending", *PAIR))
    return todo.orderBy("order_key").limit(limit) if limit is not None else todo


def run_stats(wanted: DataFrame, done_before: DataFrame, log: DataFrame, abort_after: int = 20) -> DataFrame:
    """One row: requested, already done, graded, errors, longest error streak, aborted.

    The streak is gaps-and-islands over seq: errors sharing the same count of preceding ok records form one
    island; the count is a running sum over ranges of seq (a number or a string), so no task orders the whole log."""
    pairs = wanted.select(*PAIR).distinct()
    done = ok_records(done_before).select(*PAIR).distinct().join(pairs, PAIR, "left_semi").agg(F.count(F.lit(1)))
    ok = (F.col("status") == "ok").cast("int")
    islands = prefix_sum(log.select("seq", "status"), [], [F.col("seq")], ok, "oks")
    streak = islands.where(F.col("status") != "ok").groupBy("oks").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
    counts = log.agg(F.count_if(F.col("status") == "ok").alias("graded"), F.count_if(F.col("status") != "ok").alias("errors"))
    longest = F.coalesce(streak.scalar(), F.lit(0))
    return counts.select(pairs.agg(F.count(F.lit(1))).scalar().alias("requested"), done.scalar().alias("already_done"),
                         "graded", "errors", longest.alias("longest_error_streak"), (longest >= abort_after).alias("aborted"))


def first_ok(log: DataFrame, *cols: str) -> DataFrame:
    """(pair, cols) of the first ok record of every pair."""
    return ok_records(log).groupBy(*PAIR).agg(F.min_by(F.struct(*cols), "seq").alias("r")).select(*PAIR, "r.*")


def latest_ok(log: DataFrame, *cols: str) -> DataFrame:
    return ok_records(log).groupBy(*PAIR).agg(F.max_by(F.struct(*cols), "seq").alias("r")).select(*PAIR, "r.*")


def latest_ok_grade(log: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade) of the last ok record."""
    return latest_ok(log, "grade")


def merge_labels_first_wins(base: DataFrame, log: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade): the base labels plus the first ok grade of pairs that have none."""
    new = first_ok(log, "grade").join(base.select(*PAIR), PAIR, "left_anti")
    return union_all([base.select(*PAIR, "grade"), new.select(*PAIR, "grade")])


def merge_counts(base: DataFrame, log: DataFrame) -> DataFrame:
    """One row: added, kept_existing (ok records of a pair that already had a label), skipped_errors."""
    per_pair = ok_records(log).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).join(
        base.select(*PAIR).distinct().withColumn("old", F.lit(1)), PAIR, "left")
    errors = log.agg(F.count_if(F.col("status") != "ok"))
    return per_pair.agg(F.count_if(F.col("old").isNull()).alias("added"),
                        F.coalesce(F.sum(F.when(F.col("old").isNull(), F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("kept_existing")
                        ).withColumn("skipped_errors", errors.scalar())


def overlay_labels_last_wins(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of both sets; the second overrides the first."""
    return first.select(*PAIR, F.col("grade").alias("a")).join(second.select(*PAIR, F.col("grade").alias("b")), PAIR, "full").select(
        *PAIR, F.coalesce("b", "a").alias("grade"))


def gains_from_grades(grades: DataFrame) -> DataFrame:
    """(query_id, doc_id, gain): 33 / 67 / 100; grade 0 is left out."""
    return grades.where(F.col("grade") > 0).select(*PAIR, score_of_grade(F.col("grade")).cast("double").alias("gain"))


def single_grader_guard(log: DataFrame) -> DataFrame:
    """One row (prompt_version, n_versions); more than one version among ok records is an error. A record without
    a version counts as the default one."""
    version = F.coalesce("prompt_version", F.lit(DEFAULT_PROMPT_VERSION))
    row = ok_records(log).agg(F.count_distinct(version).alias("n"), F.min(version).alias("v"))
    return row.select(F.when(F.col("n") > 1, F.raise_error(F.lit("records from more than one grader")))
                      .otherwise(F.coalesce("v", F.lit(DEFAULT_PROMPT_VERSION))).cast("string").alias("prompt_version"), F.col("n").alias("n_versions"))


def grader_versions(log: DataFrame) -> DataFrame:
    """(prompt_version, n_ok): what the guard looks at."""
    return ok_records(log).groupBy(F.coalesce("prompt_version", F.lit(DEFAULT_PROMPT_VERSION)).alias("prompt_version")).agg(
        F.count(F.lit(1)).alias("n_ok"))


# Relevance definitions - name, minimum P(grade >= 2), minimum score, demote on a term mismatch.
RELEVANCE = (
    ("repro", 0.0, 0.0, False), ("p60", 0.6, 0.0, False), ("p80", 0.8, 0.0, False), ("term", 0.0, 0.0, True),
    ("p80+term", 0.8, 0.0, True), ("s60", 0.0, 0.6, False), ("s70", 0.0, 0.7, False), ("s60+term", 0.0, 0.6, True),
)


def truth_with_cutoffs(log: DataFrame, flagged: DataFrame, definitions: Sequence[tuple] = RELEVANCE) -> DataFrame:
    """(relevance, query_id, doc_id, gain) for every definition in one pass: the latest ok grade, where a grade
    >= 2 drops to 1 if its P(>= 2) or score is below the cut or the pair is flagged. A cut whose field is missing
    is an error. `flagged(query_id, doc_id)` lists pairs with a serious term mismatch."""
    marks = flagged.select(*PAIR).distinct().withColumn("flag", F.lit(True))
    rows = latest_ok(log, "grade", "score", "probs").join(marks, PAIR, "left")
    defs = F.array(*[F.struct(F.lit(n).alias("relevance"), F.lit(float(p)).alias("min_p"), F.lit(float(s)).alias("min_score"),
                              F.lit(t).alias("term")) for n, p, s, t in definitions])
    rows = rows.withColumn("d", F.explode(defs))
    high = F.col("grade") >= 2
    p_ge2 = F.get("probs", F.lit(2)) + F.get("probs", F.lit(3))
    missing = high & (((F.col("d.min_p") > 0) & p_ge2.isNull()) | ((F.col("d.min_score") > 0) & F.col("score").isNull()))
    low = (((F.col("d.min_p") > 0) & (F.round(p_ge2, 9) < F.col("d.min_p")))
           | ((F.col("d.min_score") > 0) & (F.col("score") < F.col("d.min_score")))
           | (F.col("d.term") & F.coalesce("flag", F.lit(False))))
    grade = (F.when(missing, F.raise_error(F.lit("a cut-off needs a field this grader does not record")).cast("int"))
             .when(high & low, F.lit(1)).otherwise(F.col("grade")))
    return rows.select(F.col("d.relevance").alias("relevance"), *PAIR, grade.alias("grade")).where(F.col("grade") > 0).select(
        "relevance", *PAIR, score_of_grade(F.col("grade")).cast("double").alias("gain"))


def graded_gains(log: DataFrame) -> DataFrame:
    """(query_id, doc_id, gain): 100 x the latest ok score; zero is left out, a missing score is an error."""
    rows = latest_ok(log, "score")
    value = F.when(F.col("score").isNull(), F.raise_error(F.lit("graded gains need the continuous score")).cast("double")).otherwise(F.col("score") * 100.0)
    return rows.select(*PAIR, value.alias("gain")).where(F.col("gain") > 0)


def seed_grades(log: DataFrame, sources: Sequence[DataFrame], wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade, source_no): wanted pairs the log lacks, from earlier logs in priority order."""
    parts = [ok_records(s).select(*PAIR, "grade", F.lit(i).alias("source_no"), "seq") for i, s in enumerate(sources, start=1)]
    best = union_all(parts).groupBy(*PAIR).agg(
        F.min_by(F.struct("grade", "source_no"), F.struct("source_no", "seq")).alias("r")).select(*PAIR, "r.*")
    return best.join(wanted.select(*PAIR).distinct(), PAIR, "left_semi").join(ok_records(log).select(*PAIR), PAIR, "left_anti")


def fill_missing_bounds(pool: DataFrame, log: DataFrame, mode: str = "error") -> DataFrame:
    """(query_id, doc_id, grade, score, filled): latest grades inside the pool; pairs without one become the worst
    ('irrelevant') or best ('relevant') grade, or stop the job ('error')."""
    rows = pool.select(*PAIR).distinct().join(latest_ok(log, "grade", "score"), PAIR, "left")
    gap = F.col("grade").isNull()
    if mode == "error":
        return rows.withColumn("grade", F.when(gap, F.raise_error(F.lit("pool pairs without a grade")).cast("int")).otherwise(F.col("grade"))
                               ).withColumn("filled", F.lit(False))
    if mode not in ("irrelevant", "relevant"):
        raise ValueError(f"unknown mode {mode!r}")
    g, s = (0, 0.0) if mode == "irrelevant" else (3, 1.0)
    return rows.select(*PAIR, F.coalesce("grade", F.lit(g)).alias("grade"), F.when(gap, F.lit(s)).otherwise(F.col("score")).alias("score"), gap.alias("filled"))


def restate_extended_labels(base: DataFrame, extended: DataFrame) -> DataFrame:
    """One row: pairs and positives (grade >= 2) the extended set adds to the base set."""
    new = extended.select(*PAIR, "grade").join(base.select(*PAIR, F.col("grade").alias("old")), PAIR, "left")
    return new.agg(F.count_if(F.col("old").isNull()).alias("extra_pairs"),
                   F.count_if((F.col("grade") >= 2) & ~F.coalesce(F.col("old") >= 2, F.lit(False))).alias("extra_positives"))


def termcheck(log: DataFrame, mismatches: DataFrame) -> DataFrame:
    """(kind, n_flagged_positive, n_positive, n_flagged, n_pairs): grades >= 2 given despite a serious mismatch, over
    all and by kind. mismatches(query_id, doc_id, kinds)."""
    rows = latest_ok(log, "grade").join(mismatches.select(*PAIR, "kinds"), PAIR, "left")
    n_pairs = rows.agg(F.struct(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("grade") >= 2).alias("positive")).alias("s")).scalar()
    tags = F.concat(F.when(F.size(F.coalesce("kinds", F.array().cast("array<string>"))) > 0, F.array(F.lit("any"))).otherwise(F.array().cast("array<string>")),
                    F.coalesce("kinds", F.array().cast("array<string>")))
    flagged = rows.withColumn("kind", F.explode(tags)).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_flagged"), F.count_if(F.col("grade") >= 2).alias("n_flagged_positive"))
    return flagged.withColumn("s", n_pairs).select("kind", "n_flagged_positive", F.col("s.positive").alias("n_positive"),
                                                   "n_flagged", F.col("s.pairs").alias("n_pairs"))


def termcheck_paired(log_a: DataFrame, log_b: DataFrame, mismatches: DataFrame) -> DataFrame:
    """(mismatch, n, a_ge2, b_ge2) on pairs graded by both graders."""
    both = latest_ok(log_a, "grade").withColumnRenamed("grade", "ga").join(latest_ok(log_b, "grade").withColumnRenamed("grade", "gb"), PAIR)
    rows = both.join(mismatches.where(F.size("kinds") > 0).select(*PAIR, F.lit(True).alias("m")), PAIR, "left")
    return rows.groupBy(F.coalesce("m", F.lit(False)).alias("mismatch")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ga") >= 2).alias("a_ge2"), F.count_if(F.col("gb") >= 2).alias("b_ge2"))
