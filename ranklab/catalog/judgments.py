"""The judgment log: events as append-only grade records of two graders."""

from pyspark.sql import functions as F

from ranklab.catalog import tables as t
from ranklab.catalog.pairs import mismatch_kinds
from ranklab.catalog.pooling import pool, sql_key
from ranklab.catalog.registry import fragment, query
from ranklab.operators import labels as lb
from ranklab.operators.agreement import band_grade
from ranklab.session import scratch_path
from ranklab.sources import readers as rd
from ranklab.sources import sinks as sk


def logprob_records(spark, d):
    """Per event the first-token log-probabilities of a grader: two digits around the value, a spaced twin, a word."""
    e = t.table(spark, d, "events")
    g = F.least(F.floor(F.col("value") / 30), F.lit(3)).cast("int")
    entry = lambda token, p: F.struct(token.alias("token"), F.log(p).alias("logprob"))
    near = F.least(g + 1, F.lit(3))
    share = (F.col("event_id") % 7 + 1) / 10.0
    tokens = F.array(entry(g.cast("string"), share), entry(F.concat(F.lit(" "), near.cast("string")), F.lit(0.15)), entry(F.lit("We"), F.lit(0.05)))
    words = F.array(entry(F.lit("We"), F.lit(0.6)), entry(F.lit("Grade"), F.lit(0.2)))
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", words).otherwise(tokens).alias("top_logprobs"))


@query("grade_from_logprobs", """WITH m AS (SELECT event_id AS seq, event_type, list_transform([0, 1, 2, 3], lambda g: CASE WHEN event_type = 'error' THEN 0 ELSE
    CASE WHEN g = least(floor(value / 30), 3) THEN exp(ln((event_id % 7 + 1) / 10.0::DOUBLE)) ELSE 0 END + CASE WHEN g = least(least(floor(value / 30), 3) + 1, 3) THEN exp(ln(0.15::DOUBLE)) ELSE 0 END END) AS mass FROM events),
  p AS (SELECT seq, event_type = 'error' AS bad, list_transform(mass, lambda x: x / list_sum(mass)) AS p FROM m)
  SELECT seq, CASE WHEN bad THEN 'error: no grade token in top_logprobs' ELSE 'ok' END AS status, CASE WHEN NOT bad THEN round(p[1], 4) END AS p0, CASE WHEN NOT bad THEN round(p[4], 4) END AS p3,
  CASE WHEN NOT bad THEN list_position(p, list_max(p))::INT - 1 END AS grade, CASE WHEN NOT bad THEN round(p[2] + 2 * p[3] + 3 * p[4], 4) END AS expected_grade FROM p""")
def from_logprobs(spark, d):
    out = lb.grade_from_logprobs(logprob_records(spark, d))
    return out.select("seq", "status", F.get("probs", F.lit(0)).alias("p0"), F.get("probs", F.lit(3)).alias("p3"), "grade", "expected_grade")


@query("score_from_text", """WITH a AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'I cannot grade ' || event_id WHEN event_id % 7 = 0 THEN 'v2.' || event_id || ': ' || (cents % 100) || ' of 1.0'
    WHEN event_id % 5 = 0 THEN 'Score .' || lpad((cents % 100)::VARCHAR, 2, '0') ELSE 'Score: ' || (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') || ' (of 1)' END AS generated
    FROM (SELECT event_id, event_type, least(floor(value), 130)::BIGINT AS cents FROM events)),
  r AS (SELECT event_id, list_filter(regexp_extract_all(generated, '[0-9.]+'), lambda x: regexp_full_match(x, '[01]|[01]?[.][0-9]+')) AS runs FROM a),
  s AS (SELECT event_id, CASE WHEN runs[1]::DOUBLE BETWEEN 0 AND 1 THEN runs[1]::DOUBLE END AS score FROM r)
  SELECT event_id, score, CASE WHEN score IS NOT NULL THEN (score >= 0.175)::INT + (score >= 0.5)::INT + (score >= 0.825)::INT END AS grade, CASE WHEN score IS NULL THEN 'error: no score in output' ELSE 'ok' END AS status FROM s""")
def from_text(spark, d):
    """Scores read from free answers built from the event values."""
    e = t.table(spark, d, "events").withColumn("cents", F.least(F.floor("value"), F.lit(130)))
    part = F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    answer = (F.when(F.col("event_type") == "error", F.concat(F.lit("I cannot grade "), F.col("event_id").cast("string")))
              .when(F.col("event_id") % 7 == 0, F.concat(F.lit("v2."), F.col("event_id").cast("string"), F.lit(": "), (F.col("cents") % 100).cast("string"), F.lit(" of 1.0")))
              .when(F.col("event_id") % 5 == 0, F.concat(F.lit("Score ."), part))
              .otherwise(F.concat(F.lit("Score: "), F.floor(F.col("cents") / 100).cast("string"), F.lit("."), part, F.lit(" (of 1)"))))
    return lb.continuous_grades(e.select("event_id", answer.alias("generated"))).select("event_id", "score", "grade", "status")


@query("band_grade", "SELECT seq, (score >= 0.175)::INT + (score >= 0.5)::INT + (score >= 0.825)::INT AS grade FROM ev_log", ("ev_log",))
def bands(spark, d):
    return t.ev_log(spark, d).select("seq", band_grade(F.col("score")).alias("grade"))


@query("src_judgment_log", "SELECT seq, query_id, doc_id, status, score, grade FROM ev_log WHERE status = 'ok'", ("ev_log",))
def read_log(spark, d):
    """The log appended as JSON lines and read back; its time stamp carries the number of the event."""
    path = scratch_path(spark, "log")
    sk.sink_log(t.ev_log(spark, d).select(F.col("query_id").cast("string").alias("hire_id"), F.col("doc_id").cast("string").alias("provider_id"),
                                          F.col("seq").cast("string").alias("timestamp"), "status", "score", "grade"), path)
    rows = lb.ok_records(rd.read_judgment_log(spark, path))
    return rows.select(F.col("timestamp").cast("bigint").alias("seq"), "query_id", "doc_id", "status", "score", F.col("grade").cast("int").alias("grade"))


@query("pending_pairs", f"SELECT query_id, doc_id, {sql_key(7, 'pending', 'query_id', 'doc_id')} AS order_key FROM pool ANTI JOIN (SELECT * FROM ev_log WHERE status = 'ok') USING (query_id, doc_id)".replace("ANTI JOIN (SELECT * FROM ev_log WHERE status = 'ok')", "ANTI JOIN (SELECT query_id, doc_id FROM log_b)"), ("pool", "log_b"))
def pending(spark, d):
    return lb.pending_pairs(pool(spark, d), t.ev_log_half(spark, d, False))


@query("run_stats", """WITH s AS (SELECT seq, status, sum((status = 'ok')::INT) OVER (ORDER BY seq) AS oks FROM log_a), st AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM s WHERE status <> 'ok' GROUP BY oks))
  SELECT (SELECT count(*) FROM pool) AS requested, (SELECT count(*) FROM pool SEMI JOIN log_b USING (query_id, doc_id)) AS already_done, count(*) FILTER (status = 'ok') AS graded, count(*) FILTER (status <> 'ok') AS errors,
  (SELECT m FROM st) AS longest_error_streak, (SELECT m FROM st) >= 5 AS aborted FROM log_a""", ("pool", "log_a", "log_b"))
def stats(spark, d):
    return lb.run_stats(pool(spark, d), t.ev_log_half(spark, d, False), t.ev_log_half(spark, d, True), abort_after=5)


def base_labels(spark, d):
    return lb.latest_ok_grade(t.ev_log_half(spark, d, False))


@query("merge_labels_first_wins", """SELECT query_id, doc_id, grade FROM latest_b UNION ALL
  SELECT query_id, doc_id, arg_min(grade, seq) AS grade FROM log_a ANTI JOIN latest_b USING (query_id, doc_id) WHERE status = 'ok' GROUP BY 1, 2""", ("log_a", "latest_b"))
def merge(spark, d):
    return lb.merge_labels_first_wins(base_labels(spark, d), t.ev_log_half(spark, d, True))


@query("merge_counts", """SELECT (SELECT count(*) FROM (SELECT DISTINCT query_id, doc_id FROM log_a WHERE status = 'ok') ANTI JOIN latest_b USING (query_id, doc_id)) AS added,
  (SELECT count(*) FROM log_a WHERE status = 'ok') - (SELECT count(*) FROM (SELECT DISTINCT query_id, doc_id FROM log_a WHERE status = 'ok') ANTI JOIN latest_b USING (query_id, doc_id)) AS kept_existing,
  (SELECT count(*) FROM log_a WHERE status <> 'ok') AS skipped_errors""", ("log_a", "latest_b"))
def counts(spark, d):
    return lb.merge_counts(base_labels(spark, d), t.ev_log_half(spark, d, True))


@query("overlay_labels_last_wins", "SELECT query_id, doc_id, coalesce(a.grade, b.grade) AS grade FROM latest_b b FULL JOIN latest_a a USING (query_id, doc_id)", ("latest_a", "latest_b"))
def overlay(spark, d):
    return lb.overlay_labels_last_wins(base_labels(spark, d), lb.latest_ok_grade(t.ev_log_half(spark, d, True)))


@query("latest_ok_grade", "SELECT query_id, doc_id, arg_max(grade, seq) AS grade FROM ev_log WHERE status = 'ok' GROUP BY 1, 2", ("ev_log",))
def latest(spark, d):
    return lb.latest_ok_grade(t.ev_log(spark, d))


@query("single_grader_guard", "SELECT 'rubric_0_3.v2-repro' AS prompt_version, count(DISTINCT 1) AS n_versions FROM ev_log WHERE status = 'ok'", ("ev_log",))
def guard(spark, d):
    log = t.ev_log(spark, d).withColumn("prompt_version", F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("prompt_version")))
    return lb.single_grader_guard(log)


@query("grader_versions", "SELECT CASE WHEN event_type = 'click' THEN 'rubric_0_3.v2-repro' ELSE 'rubric_' || event_type END AS prompt_version, count(*) AS n_ok FROM ev_log WHERE status = 'ok' GROUP BY 1", ("ev_log",))
def versions(spark, d):
    log = t.ev_log(spark, d).withColumn("prompt_version", F.when(F.col("event_type") != "click", F.concat(F.lit("rubric_"), F.col("event_type"))))
    return lb.grader_versions(log)


def flagged(spark, d):
    """Pairs with a serious term mismatch between a user's order and the part of the document's number."""
    pairs = t.ev_log(spark, d).select("query_id", "doc_id").distinct().withColumn("available_from", F.lit(None).cast("string"))
    rows = pairs.join(t.gig_struct(spark, d), "query_id").join(t.provider_struct(spark, d), "doc_id")
    return rows.select("query_id", "doc_id", mismatch_kinds().alias("kinds"))


fragment("ev_mismatch", f"""SELECT query_id, doc_id, list_filter([CASE WHEN rate_per_hour > 1.4::DOUBLE * budget_hi THEN 'budget' END, CASE WHEN abs({t.NEED} - {t.HAVE}) = 2 THEN 'seniority' END,
  CASE WHEN commitment - capacity >= 2 THEN 'days' END], lambda k: k IS NOT NULL) AS kinds FROM (SELECT DISTINCT query_id, doc_id FROM ev_log) JOIN gig_struct USING (query_id) JOIN provider_struct USING (doc_id)""",
         ("ev_log", "gig_struct", "provider_struct"))
fragment("latest_all", "SELECT query_id, doc_id, arg_max(grade, seq) AS grade, arg_max(score, seq) AS score FROM ev_log WHERE status = 'ok' GROUP BY 1, 2", ("ev_log",))
_DEFS = ", ".join(f"('{n}', {p}, {s}, {str(tt).lower()})" for n, p, s, tt in lb.RELEVANCE)
fragment("truths", f"""SELECT relevance, query_id, doc_id, CASE g WHEN 1 THEN 33.0 WHEN 2 THEN 67.0 ELSE 100.0 END::DOUBLE AS gain FROM (
  SELECT relevance, query_id, doc_id, CASE WHEN grade >= 2 AND ((min_p > 0 AND score < min_p) OR (min_s > 0 AND score < min_s) OR (term AND coalesce(len(kinds), 0) > 0)) THEN 1 ELSE grade END AS g
  FROM latest_all LEFT JOIN ev_mismatch USING (query_id, doc_id), (VALUES {_DEFS}) d(relevance, min_p, min_s, term)) WHERE g > 0""", ("latest_all", "ev_mismatch"))


def truths(spark, d):
    return lb.truth_with_cutoffs(t.ev_log(spark, d), flagged(spark, d).where(F.size("kinds") > 0))


@query("truth_with_cutoffs", "SELECT * FROM truths", ("truths",))
def truth(spark, d):
    return truths(spark, d)


@query("graded_gains", "SELECT query_id, doc_id, round(100 * score, 6) AS gain FROM latest_all WHERE score > 0", ("latest_all",))
def gains(spark, d):
    return lb.graded_gains(t.ev_log(spark, d)).withColumn("gain", F.round("gain", 6))


@query("seed_grades", """SELECT query_id, doc_id, arg_min(grade, (no, seq)) AS grade, min(no) AS source_no FROM (SELECT 1 AS no, * FROM ev_log WHERE event_type = 'click' AND status = 'ok' UNION ALL SELECT 2, * FROM ev_log WHERE event_type = 'view' AND status = 'ok')
  SEMI JOIN pool USING (query_id, doc_id) ANTI JOIN log_b USING (query_id, doc_id) GROUP BY 1, 2""", ("ev_log", "pool", "log_b"))
def seed(spark, d):
    log = t.ev_log(spark, d)
    return lb.seed_grades(t.ev_log_half(spark, d, False), [log.where("event_type = 'click'"), log.where("event_type = 'view'")], pool(spark, d))


@query("fill_missing_bounds", """SELECT bound, query_id, doc_id, coalesce(grade, CASE bound WHEN 'relevant' THEN 3 ELSE 0 END) AS grade, CASE WHEN grade IS NULL THEN CASE bound WHEN 'relevant' THEN 1.0 ELSE 0.0 END ELSE score END::DOUBLE AS score, grade IS NULL AS filled
  FROM pool LEFT JOIN latest_b USING (query_id, doc_id), (VALUES ('relevant'), ('irrelevant')) b(bound)""", ("pool", "latest_b"))
def fill(spark, d):
    from ranklab.session import union_all
    log = t.ev_log_half(spark, d, False)
    return union_all([lb.fill_missing_bounds(pool(spark, d), log, m).select(F.lit(m).alias("bound"), "*") for m in ("relevant", "irrelevant")])


@query("restate_extended_labels", """SELECT count(*) FILTER (b.query_id IS NULL) AS extra_pairs, count(*) FILTER (x.grade >= 2 AND NOT coalesce(b.grade >= 2, false)) AS extra_positives FROM
  (SELECT query_id, doc_id, coalesce(a.grade, b.grade) AS grade FROM latest_b b FULL JOIN latest_a a USING (query_id, doc_id)) x LEFT JOIN latest_b b ON b.query_id = x.query_id AND b.doc_id = x.doc_id""", ("latest_a", "latest_b"))
def restate(spark, d):
    base = base_labels(spark, d)
    return lb.restate_extended_labels(base, lb.overlay_labels_last_wins(base, lb.latest_ok_grade(t.ev_log_half(spark, d, True))))


@query("termcheck", """SELECT kind, count(*) FILTER (grade >= 2) AS n_flagged_positive, (SELECT count(*) FROM latest_all WHERE grade >= 2) AS n_positive, count(*) AS n_flagged, (SELECT count(*) FROM latest_all) AS n_pairs
  FROM (SELECT grade, unnest(CASE WHEN len(kinds) > 0 THEN list_concat(['any'], kinds) ELSE [] END) AS kind FROM latest_all JOIN ev_mismatch USING (query_id, doc_id)) GROUP BY 1""", ("latest_all", "ev_mismatch"))
def termcheck(spark, d):
    return lb.termcheck(t.ev_log(spark, d), flagged(spark, d))


@query("termcheck_paired", """SELECT coalesce(len(kinds), 0) > 0 AS mismatch, count(*) AS n, count(*) FILTER (a.grade >= 2) AS a_ge2, count(*) FILTER (b.grade >= 2) AS b_ge2
  FROM latest_a a JOIN latest_b b USING (query_id, doc_id) LEFT JOIN ev_mismatch USING (query_id, doc_id) GROUP BY 1""", ("latest_a", "latest_b", "ev_mismatch"))
def termcheck_paired(spark, d):
    return lb.termcheck_paired(t.ev_log_half(spark, d, True), t.ev_log_half(spark, d, False), flagged(spark, d))


def by_pair(df, *cols):
    return df.select("query_id", "doc_id", *cols)


@query("labels_unnest", "SELECT query_id, doc_id, grade AS value FROM ev_grades", ("ev_grades",))
def unnest(spark, d):
    """The nested form of each user's grades, read back as rows."""
    from ranklab.sources.readers import labels_nest, labels_unnest
    nested = labels_nest(t.ev_grades(spark, d)).select(F.create_map(F.col("query_id").cast("string"), F.col("labels")).alias("labels"))
    return labels_unnest(nested)


@query("labels_nest", "SELECT query_id, count(*) AS n_labels, md5(string_agg(doc_id::VARCHAR || ':' || grade::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS labels_md5 FROM ev_grades GROUP BY 1", ("ev_grades",))
def nest(spark, d):
    from ranklab.sources.readers import labels_nest
    entries = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return labels_nest(t.ev_grades(spark, d)).select("query_id", F.size("labels").cast("bigint").alias("n_labels"), F.md5(F.array_join(entries, ",")).alias("labels_md5"))
