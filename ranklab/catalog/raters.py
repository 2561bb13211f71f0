"""Agreement, uncertainty and selection."""

from pyspark.sql import functions as F

from ranklab.catalog import tables as t
from ranklab.catalog.pooling import pool
from ranklab.catalog.registry import fragment, query
from ranklab.catalog.scores import systems
from ranklab.operators import agreement as ag
from ranklab.operators import bootstrap as bs
from ranklab.operators import metrics as m

N_BOOT = 2000
fragment("draws", f"""SELECT boot, query_id, count(*) AS times FROM (SELECT boot, ('0x' || substr(md5(concat_ws('|', '7', 'boot', boot::VARCHAR, slot::VARCHAR)), 1, 15))::UBIGINT::BIGINT % n + 1 AS pos
  FROM (SELECT count(*) AS n FROM ev_queries), unnest(range(1, {N_BOOT + 1})) b(boot), unnest(range(1, n + 1)) s(slot)) JOIN (SELECT query_id, row_number() OVER (ORDER BY query_id) AS pos FROM ev_queries) USING (pos) GROUP BY 1, 2""", ("ev_queries",))
fragment("ev_long", """SELECT system, query_id, unnest(['p_10', 'r_10', 'ndcg_10', 'mrr']) AS metric, unnest([p_10, r_10, ndcg_10, mrr]) AS value FROM ev_metrics""", ("ev_metrics",))


def long_metrics(spark, d):
    per = m.metrics_per_query(systems(spark, d), t.ev_gains(spark, d), by=["system"]).select("system", "query_id", "p_10", "r_10", "ndcg_10", "mrr")
    return m.to_long(per, ["system"])


def sql_ci(values, by):
    return f"""SELECT {by}, n, round(mean, 6) + 0.0 AS mean, round(quantile_cont(mm, 0.025), 6) + 0.0 AS lo, round(quantile_cont(mm, 0.975), 6) + 0.0 AS hi FROM (
      SELECT {by}, boot, sum(value * times) / sum(times) AS mm FROM {values} JOIN draws USING (query_id) WHERE value IS NOT NULL GROUP BY ALL)
      JOIN (SELECT {by}, count(*) AS n, avg(value) AS mean FROM {values} WHERE value IS NOT NULL GROUP BY ALL) USING ({by}) GROUP BY {by}, n, mean"""


def plus0(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c) + 0.0)
    return df


@query("bootstrap_ci", sql_ci("ev_long", "system, metric"), ("ev_long", "draws"))
def bootstrap(spark, d):
    draws = bs.boot_draws(t.ev_queries(spark, d), "query_id", N_BOOT)
    return plus0(bs.bootstrap_ci(long_metrics(spark, d), draws, ["system", "metric"]), "mean", "lo", "hi")


COMPARISONS = (("rrf2 - click", "rrf2", "click"), ("rrf3 - rrf2", "rrf3", "rrf2"), ("purchase - view", "purchase", "view"))
fragment("comparisons", "SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{a}', '{b}')" for x, a, b in COMPARISONS) + ") c(label, a, b)")
fragment("paired", """SELECT label, x.metric, x.query_id, x.value - y.value AS value FROM comparisons JOIN ev_long x ON x.system = a JOIN ev_long y ON y.system = b AND y.metric = x.metric AND y.query_id = x.query_id""", ("comparisons", "ev_long"))


def comparison_table(spark):
    return spark.createDataFrame(COMPARISONS, "label string, a string, b string")


@query("paired_diff_ci", f"SELECT *, lo > 0 OR hi < 0 AS significant FROM ({sql_ci('paired', 'label, metric')})", ("paired", "draws"))
def paired(spark, d):
    draws = bs.boot_draws(t.ev_queries(spark, d), "query_id", N_BOOT)
    return plus0(bs.paired_diff_ci(long_metrics(spark, d), draws, comparison_table(spark)), "mean", "lo", "hi")


fragment("both_graders", "SELECT query_id, doc_id, a.grade AS a, b.grade AS b, b.score AS score, a.score AS score_a FROM latest_a a JOIN latest_b b USING (query_id, doc_id)", ("latest_a", "latest_b"))


def both(spark, d):
    from ranklab.operators.labels import latest_ok
    a = latest_ok(t.ev_log_half(spark, d, True), "grade", "score").select("query_id", "doc_id", F.col("grade").alias("a"), F.col("score").alias("score_a"))
    b = latest_ok(t.ev_log_half(spark, d, False), "grade", "score").select("query_id", "doc_id", F.col("grade").alias("b"), "score")
    return a.join(b, ["query_id", "doc_id"])


def sql_kappa(rows, w, k=4):
    """Cohen's kappa over the label grid, from marginals."""
    weight = "((x - y) * (x - y))::DOUBLE / 9" if w == "quadratic" else "(x <> y)::INT::DOUBLE"
    grid = f"(SELECT x, y FROM range({k}) r(x), range({k}) s(y))"
    return f"""SELECT CASE WHEN e > 0 THEN 1 - o / e ELSE 1 END FROM (SELECT sum({weight} * coalesce(c, 0) / n) AS o, sum({weight} * coalesce(ra, 0) / n * coalesce(rb, 0) / n) AS e FROM {grid}
      LEFT JOIN (SELECT a AS x, b AS y, count(*)::DOUBLE AS c FROM {rows} GROUP BY 1, 2) USING (x, y) LEFT JOIN (SELECT a AS x, count(*)::DOUBLE AS ra FROM {rows} GROUP BY 1) USING (x)
      LEFT JOIN (SELECT b AS y, count(*)::DOUBLE AS rb FROM {rows} GROUP BY 1) USING (y), (SELECT count(*)::DOUBLE AS n FROM {rows}))"""


BIN = "(SELECT (a >= 2)::INT AS a, (b >= 2)::INT AS b FROM both_graders)"


@query("cohen_kappa", f"SELECT 'none' AS weights, round(({sql_kappa('both_graders', None)}), 6) AS kappa UNION ALL SELECT 'quadratic', round(({sql_kappa('both_graders', 'quadratic')}), 6)", ("both_graders",))
def kappa(spark, d):
    from ranklab.session import union_all
    rows = both(spark, d)
    return union_all([ag.cohen_kappa(rows, weights=w).select(F.lit(w or "none").alias("weights"), F.round("kappa", 6).alias("kappa")) for w in (None, "quadratic")])


@query("binary_kappa", """SELECT lang, count(*) AS n, round((avg((quality = toxic)::INT) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / nullif(1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic))), 0), 6) AS kappa
  FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def binary(spark, d):
    rows = t.table(spark, d, "labels").join(t.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return ag.binary_kappa(rows.select("lang", F.col("quality").alias("a"), F.col("toxic").alias("b")), ["lang"]).withColumn("kappa", F.round("kappa", 6))


@query("confusion_matrix", "SELECT x::INT AS a, y::INT AS b, coalesce(n, 0) AS n FROM range(4) r(x), range(4) s(y) LEFT JOIN (SELECT a, b, count(*) AS n FROM both_graders GROUP BY 1, 2) c ON c.a = x AND c.b = y".replace("FROM range(4) r(x), range(4) s(y)", "FROM (SELECT x, y FROM range(4) r(x), range(4) s(y)) g"), ("both_graders",))
def confusion(spark, d):
    return ag.confusion_matrix(both(spark, d))


MID = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"


@query("spearman", f"SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM (SELECT {MID.format('a')} AS ra, {MID.format('score')} AS rb FROM both_graders)", ("both_graders",))
def spearman(spark, d):
    return m.spearman_by(both(spark, d).select(F.col("a").cast("double").alias("a"), "score"), "a", "score").withColumn("spearman", F.round("spearman", 6))


@query("calibration_report", f"""SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS exact, round(avg((abs(a - b) <= 1)::INT), 6) AS within_one, round(({sql_kappa('both_graders', 'quadratic')}), 6) AS quadratic_kappa,
  round(({sql_kappa(BIN, None, 2)}), 6) AS kappa_ge2 FROM both_graders""", ("both_graders",))
def calibration(spark, d):
    return ag.calibration_report(both(spark, d))


@query("expected_by_assigned", "SELECT g::INT AS grade, count(b) AS n, round(avg(score * 3), 6) AS mean_expected_grade FROM range(4) r(g) LEFT JOIN both_graders ON b = g GROUP BY 1", ("both_graders",))
def expected(spark, d):
    return ag.expected_by_assigned(both(spark, d).withColumn("expected", F.col("score") * 3))


def sql_auc(label):
    return f"""SELECT (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (y) * count(*) FILTER (NOT y), 0) FROM (SELECT {label} AS y, {MID.format('score')} AS r FROM both_graders)"""


BAND = "(SELECT a, (score >= 0.175)::INT + (score >= 0.5)::INT + (score >= 0.825)::INT AS b FROM both_graders)"
BAND2 = "(SELECT (a >= 2)::INT AS a, (score >= 0.5)::INT AS b FROM both_graders)"


@query("continuous_calibration", f"""SELECT count(*) AS n, (SELECT round(corr(ra, rb), 6) FROM (SELECT {MID.format('a')} AS ra, {MID.format('score')} AS rb FROM both_graders)) AS spearman,
  round(({sql_auc('a >= 1')}), 6) AS auc_ge1, round(({sql_auc('a >= 2')}), 6) AS auc_ge2, round(({sql_auc('a >= 3')}), 6) AS auc_ge3,
  round(avg((a = g)::INT), 6) AS banded_exact, round(avg((abs(a - g) <= 1)::INT), 6) AS banded_within_one, round(({sql_kappa(BAND, 'quadratic')}), 6) AS banded_quadratic_kappa, round(({sql_kappa(BAND2, None, 2)}), 6) AS banded_kappa_ge2,
  round(avg(((score > 0.15 AND score < 0.2) OR (score > 0.45 AND score < 0.55) OR (score > 0.8 AND score < 0.85))::INT), 6) AS share_in_gaps, count(DISTINCT score) AS distinct_scores, round(avg((round(score * 100)::BIGINT % 5 = 0)::INT), 6) AS share_round5
  FROM (SELECT *, (score >= 0.175)::INT + (score >= 0.5)::INT + (score >= 0.825)::INT AS g FROM both_graders)""", ("both_graders",))
def continuous(spark, d):
    return ag.continuous_calibration(both(spark, d))


@query("continuous_by_grade", """SELECT g::INT AS grade, count(a) AS n, round(avg(score), 6) AS mean, round((list(score ORDER BY score))[count(a) // 2 + 1], 6) AS median, round(min(score), 6) AS min, round(max(score), 6) AS max
  FROM range(4) r(g) LEFT JOIN both_graders ON a = g GROUP BY 1""", ("both_graders",))
def by_grade(spark, d):
    return ag.continuous_by_grade(both(spark, d))


@query("agreement_2x2", """SELECT count(*) AS n, count(*) FILTER (x AND y) AS both_relevant, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b, count(*) FILTER (NOT x AND NOT y) AS neither, round(avg((x = y)::INT), 6) AS agreement
  FROM (SELECT coalesce(a.grade >= 2, false) AS x, coalesce(b.grade >= 2, false) AS y FROM pool LEFT JOIN latest_a a USING (query_id, doc_id) LEFT JOIN latest_b b USING (query_id, doc_id))""", ("pool", "latest_a", "latest_b"))
def agreement(spark, d):
    from ranklab.operators.labels import latest_ok_grade
    relevant = lambda first: latest_ok_grade(t.ev_log_half(spark, d, first)).select("query_id", "doc_id", (F.col("grade") >= 2).alias("relevant"))
    return ag.agreement_2x2(pool(spark, d), relevant(True), relevant(False))


def sql_wilson(k, n):
    c = f"({k}::DOUBLE / {n} + 3.8416::DOUBLE / (2.0::DOUBLE * {n}))"
    h = f"(1.96::DOUBLE * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + 3.8416::DOUBLE / (4.0::DOUBLE * {n} * {n})))"
    den = f"(1 + 3.8416::DOUBLE / {n})"
    return f"(({c} - {h}) / {den})", f"(({c} + {h}) / {den})"


LO, HI = sql_wilson("k", "n")


@query("proportion_ci", f"SELECT lang, k, n, round(k::DOUBLE / n, 6) AS rate, round({LO}, 6) + 0.0 AS lo, round({HI}, 6) AS hi FROM (SELECT lang, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)")
def proportions(spark, d):
    rows = t.table(spark, d, "labels").join(t.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("ok", F.col("quality") == 1)
    return plus0(ag.proportion_ci(rows, ["lang"], "ok"), "lo")


def strata():
    s = F.col("score_a")
    return F.when(s.between(0.35, 0.65), "borderline").when(s > 0.65, "positive").otherwise("negative")


fragment("audit_rows", "SELECT query_id, doc_id, a AS grade, b AS audit_grade, score_a AS p_ge2, score, CASE WHEN score_a BETWEEN 0.35 AND 0.65 THEN 'borderline' WHEN score_a > 0.65 THEN 'positive' ELSE 'negative' END AS stratum FROM both_graders", ("both_graders",))


def audit_rows(spark, d):
    """Grader A's pairs as the audit key, grader B as the second rater."""
    rows = both(spark, d)
    key = rows.select(F.concat_ws("-", "query_id", "doc_id").alias("item"), "query_id", "doc_id", F.col("a").alias("grade"), F.col("score_a").alias("p_ge2"), strata().alias("stratum"))
    grades = rows.select(F.concat_ws("-", "query_id", "doc_id").alias("item"), F.col("b").alias("grade"))
    return ag.join_audit(key, grades).join(rows.select("query_id", "doc_id", "score"), ["query_id", "doc_id"])


ALO, AHI = sql_wilson("agree", "n")


@query("audit_score", f"""SELECT stratum, n, round(same::DOUBLE / n, 6) AS exact, agree, round({ALO}, 6) AS agree_lo, round({AHI}, 6) AS agree_hi,
  round((agree::DOUBLE / n - pe) / nullif(1 - pe, 0), 6) AS kappa, audit_lower, audit_higher, rater_ge2, audit_ge2 FROM (SELECT *, (rater_ge2::DOUBLE / n) * (audit_ge2::DOUBLE / n) + (1 - rater_ge2::DOUBLE / n) * (1 - audit_ge2::DOUBLE / n) AS pe FROM (
    SELECT stratum, count(*) AS n, count(*) FILTER (grade = audit_grade) AS same, count(*) FILTER ((grade >= 2) = (audit_grade >= 2)) AS agree, count(*) FILTER (grade > audit_grade) AS audit_lower, count(*) FILTER (grade < audit_grade) AS audit_higher,
    count(*) FILTER (grade >= 2) AS rater_ge2, count(*) FILTER (audit_grade >= 2) AS audit_ge2 FROM (SELECT * FROM audit_rows UNION ALL SELECT * REPLACE ('ALL' AS stratum) FROM audit_rows) GROUP BY 1))""", ("audit_rows",))
def audit(spark, d):
    return ag.audit_score(audit_rows(spark, d))


@query("confirmed_by_confidence", """SELECT stratum, CASE WHEN p_ge2 < 0.6 THEN '[0.00,0.60)' WHEN p_ge2 < 0.8 THEN '[0.60,0.80)' WHEN p_ge2 < 0.95 THEN '[0.80,0.95)' ELSE '[0.95,1.00]' END AS confidence,
  count(*) FILTER (audit_grade >= 2) AS confirmed, count(*) AS n FROM audit_rows WHERE grade >= 2 GROUP BY 1, 2""", ("audit_rows",))
def confirmed(spark, d):
    return ag.confirmed_by_confidence(audit_rows(spark, d))


L1, U1 = sql_wilson("k1", "n1")
L2, U2 = sql_wilson("k2", "n2")


@query("audit_entering_vs_leaving", f"""SELECT k1, n1, k2, n2, round(k1::DOUBLE / n1 - k2::DOUBLE / n2, 6) AS difference,
  round(k1::DOUBLE / n1 - k2::DOUBLE / n2 - sqrt(pow(k1::DOUBLE / n1 - {L1}, 2) + pow({U2} - k2::DOUBLE / n2, 2)), 6) AS lo, round(k1::DOUBLE / n1 - k2::DOUBLE / n2 + sqrt(pow({U1} - k1::DOUBLE / n1, 2) + pow(k2::DOUBLE / n2 - {L2}, 2)), 6) AS hi
  FROM (SELECT count(*) FILTER (side = 'entering' AND grade >= 2) AS k1, count(*) FILTER (side = 'entering') AS n1, count(*) FILTER (side = 'leaving' AND grade >= 2) AS k2, count(*) FILTER (side = 'leaving') AS n2 FROM diff JOIN latest_all USING (query_id, doc_id))""", ("diff", "latest_all"))
def entering(spark, d):
    from ranklab.catalog.lists import rrf2, rrf3
    from ranklab.operators.fusion import list_diff
    from ranklab.operators.labels import latest_ok_grade
    rows = list_diff(rrf3(spark, d, top=10), rrf2(spark, d, top=10)).join(latest_ok_grade(t.ev_log(spark, d)), ["query_id", "doc_id"])
    return ag.proportion_difference(rows.withColumn("ok", F.col("grade") >= 2), "side", "entering", "leaving", "ok")


RATERS = {"grade>=2": "grade >= 2", "score>=0.5": "score >= 0.5", "score>=0.7": "score >= 0.7", "p>=0.6": "p_ge2 >= 0.6"}
GROUPS = {"uncertain or positive": ("borderline", "positive")}


@query("rater_vs_audit", f"""WITH l AS (SELECT grp, r.rater, r.rel::INT AS a, (audit_grade >= 2)::INT AS b FROM (SELECT *, unnest(CASE WHEN stratum IN ('borderline', 'positive') THEN ['all', stratum, 'uncertain or positive'] ELSE ['all', stratum] END) AS grp FROM audit_rows),
    LATERAL (SELECT unnest([{', '.join("{'rater': '" + n + "', 'rel': " + e + "}" for n, e in RATERS.items())}]) AS r)),
  c AS (SELECT grp, rater, count(*) AS n, sum(a)::BIGINT AS rated, count(*) FILTER (a = 1 AND b = 1) AS "both", count(*) FILTER (a = 1 AND b = 0) AS rater_only, count(*) FILTER (a = 0 AND b = 1) AS audit_only, avg((a = b)::INT) AS agree, avg(a) AS pa, avg(b) AS pb FROM l GROUP BY 1, 2)
  SELECT grp, rater, n, rated, "both", rater_only, audit_only, round(agree, 6) AS agree, round(CASE WHEN pa * (1 - pb) + (1 - pa) * pb > 0 THEN 1 - (1 - agree) / (pa * (1 - pb) + (1 - pa) * pb) ELSE 1 END, 6) AS kappa FROM c""", ("audit_rows",))
def rater_audit(spark, d):
    return ag.rater_vs_audit(audit_rows(spark, d), {n: F.expr(e) for n, e in RATERS.items()}, GROUPS)


RLO, RHI = sql_wilson("kept_rejected", "n_rejected")


@query("kept_by_raters", f"""SELECT *, round({RLO}, 6) + 0.0 AS rejected_lo, round({RHI}, 6) AS rejected_hi FROM (SELECT r.rater AS rater, count(*) FILTER (audit_grade >= 2 AND r.rel) AS kept_confirmed, count(*) FILTER (audit_grade >= 2) AS n_confirmed,
  count(*) FILTER (audit_grade < 2 AND r.rel) AS kept_rejected, count(*) FILTER (audit_grade < 2) AS n_rejected FROM audit_rows, LATERAL (SELECT unnest([{', '.join("{'rater': '" + n + "', 'rel': " + e + "}" for n, e in RATERS.items())}]) AS r) WHERE grade >= 2 GROUP BY 1)""", ("audit_rows",))
def kept(spark, d):
    return plus0(ag.kept_by_raters(audit_rows(spark, d), {n: F.expr(e) for n, e in RATERS.items()}, F.col("grade") >= 2), "rejected_lo")
