"""Fusion and list algebra over the event channels."""

from pyspark.sql import functions as F

from ranklab.catalog import tables as t
from ranklab.catalog.channels import shown
from ranklab.catalog.registry import fragment, query, shown9
from ranklab.operators import fusion as fu
from ranklab.session import scratch_path
from ranklab.sources.sinks import sink_ranked_lists

SQL_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank"


def three(spark, d):
    return [t.ev_list(spark, d, c) for c in t.CHANNELS]


fragment("rrf2", f"""SELECT *, {SQL_RANK} FROM (SELECT query_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 12) AS score
  FROM ev_click a FULL JOIN ev_view b USING (query_id, doc_id))""", ("ev_click", "ev_view"))
fragment("stacked3", """SELECT 1 AS list_no, query_id, doc_id, rank FROM ev_click UNION ALL SELECT 2, query_id, doc_id, rank FROM ev_view
  UNION ALL SELECT 3, query_id, doc_id, rank FROM ev_purchase""", ("ev_click", "ev_view", "ev_purchase"))
fragment("rrf3", """SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen) AS rank FROM (
  SELECT query_id, doc_id, round(sum(CASE list_no WHEN 3 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)), 12) AS score, min(list_no * 1000000 + rank) AS first_seen
  FROM stacked3 GROUP BY 1, 2)""", ("stacked3",))


def rrf2(spark, d, **kw):
    return fu.rrf_fuse2(t.ev_list(spark, d, "click"), t.ev_list(spark, d, "view"), **kw)


def rrf3(spark, d, **kw):
    return fu.rrf_fuse_n(three(spark, d), [1.0, 1.0, 0.5], **kw)


def fused_shown(df, *extra):
    return df.select(*extra, "query_id", "doc_id", shown9("score"), F.col("rank").cast("bigint").alias("rank"))


@query("rrf_fuse2", "SELECT query_id, doc_id, round(score + 2.5e-13, 9) + 0.0 AS score, rank FROM rrf2", ("rrf2",))
def rrf_fuse2(spark, d):
    return fused_shown(rrf2(spark, d))


@query("rrf_fuse_n", "SELECT query_id, doc_id, round(score + 2.5e-13, 9) + 0.0 AS score, rank FROM rrf3", ("rrf3",))
def rrf_fuse_n(spark, d):
    return fused_shown(rrf3(spark, d))


GRID = ((10, 1.0, 1.0), (60, 1.0, 1.0), (100, 1.0, 1.0), (60, 1.0, 1.5), (60, 0.7, 1.3), (60, 1.5, 1.0))


@query("rrf_sweep", f"""SELECT config, query_id, doc_id, round(score + 2.5e-13, 9) + 0.0 AS score, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT config, query_id, doc_id, round(coalesce(wa / (k + a.rank), 0) + coalesce(wb / (k + b.rank), 0), 12) AS score
  FROM (ev_click a FULL JOIN ev_view b USING (query_id, doc_id)), (VALUES {', '.join(f'({i}, {k}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)' for i, (k, a, b) in enumerate(GRID, 1))}) g(config, k, wa, wb))
  QUALIFY rank <= 10""", ("ev_click", "ev_view"))
def rrf_sweep(spark, d):
    return fused_shown(fu.rrf_sweep(t.ev_list(spark, d, "click"), t.ev_list(spark, d, "view"), GRID, top=10), "config")


@query("fuse_systems", """SELECT query_id, doc_id, round(score + 2.5e-13, 9) + 0.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen) AS rank FROM (
  SELECT query_id, doc_id, round(sum(CASE list_no WHEN 1 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / (60 + rank)), 12) AS score, min(list_no * 1000000 + rank) AS first_seen
  FROM stacked3 WHERE list_no < 3 AND query_id IN (SELECT query_id FROM ev_click) GROUP BY 1, 2)""", ("stacked3", "ev_click"))
def fuse_systems(spark, d):
    return fused_shown(fu.fuse_systems([t.ev_list(spark, d, "click"), t.ev_list(spark, d, "view")], [7.0, 3.0]))


@query("rrf_tied_rank", """SELECT query_id, doc_id, round(round(sum(share), 12) + 2.5e-13, 9) + 0.0 AS score FROM (
  SELECT query_id, doc_id, CASE WHEN s > 0 THEN 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY s DESC)) ELSE 0 END AS share FROM (SELECT query_id, doc_id, floor(score / 20) AS s FROM ev_click)
  UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY s DESC)) FROM (SELECT query_id, doc_id, floor(score / 20) AS s FROM ev_view)) GROUP BY 1, 2""",
       ("ev_click", "ev_view"))
def rrf_tied(spark, d):
    coarse = lambda c: t.ev_scores(spark, d).where(F.col("channel") == c).select("query_id", "doc_id", F.floor(F.col("score") / 20).cast("double").alias("score"))
    return fu.rrf_tied_rank([coarse("click"), coarse("view")], [True, False]).withColumn("score", shown9("score"))


def ev_candidates(spark, d):
    """Fused candidates with a second feature: the purchase score (missing where purchases lack the pair)."""
    extra = t.ev_scores(spark, d).where(F.col("channel") == "purchase").select("query_id", "doc_id", F.col("score").alias("bought"))
    return rrf2(spark, d).select("query_id", "doc_id", F.col("score").alias("rrf_score"), F.col("rank").alias("rrf_rank")).join(extra, ["query_id", "doc_id"], "left")


fragment("ev_cands", "SELECT r.query_id, r.doc_id, r.score AS rrf_score, r.rank AS rrf_rank, p.score AS bought FROM rrf2 r LEFT JOIN ev_purchase p USING (query_id, doc_id)", ("rrf2", "ev_purchase"))


@query("order_by_feature", """SELECT query_id, doc_id, round(bought, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY bought DESC NULLS LAST, rrf_rank) AS rank FROM ev_cands""", ("ev_cands",))
def order_by_feature(spark, d):
    return shown(fu.order_by_feature(ev_candidates(spark, d), "bought"))


@query("head_plus_tail", """WITH head AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY bought DESC NULLS LAST, rrf_rank) AS rank FROM ev_cands WHERE rrf_rank <= 5)
  SELECT query_id, doc_id, rank FROM head UNION ALL
  SELECT r.query_id, r.doc_id, n + row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) FROM rrf2 r JOIN (SELECT query_id, count(*) AS n FROM head GROUP BY 1) USING (query_id)
  WHERE r.rank > 5""", ("ev_cands", "rrf2"))
def head_plus_tail(spark, d):
    head = fu.order_by_feature(ev_candidates(spark, d).where("rrf_rank <= 5"), "bought")
    return fu.head_plus_tail(head, rrf2(spark, d))


@query("rerank_by_external_score", """SELECT query_id, doc_id, round(bought, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY bought DESC NULLS LAST, rrf_rank) AS rank FROM ev_cands""", ("ev_cands",))
def rerank_external(spark, d):
    scores = t.ev_scores(spark, d).where(F.col("channel") == "purchase")
    return shown(fu.rerank_by_external_score(ev_candidates(spark, d), scores))


@query("missing_score_counts", "SELECT count(*) AS n_candidates, count(*) - count(bought) AS n_missing FROM ev_cands", ("ev_cands",))
def missing_counts(spark, d):
    return fu.missing_score_counts(ev_candidates(spark, d), t.ev_scores(spark, d).where(F.col("channel") == "purchase"))


@query("pair_texts", """SELECT query_id, doc_id, md5(trim(g.text, ' ')) AS query_md5, length(trim(dd.text, ' ')) AS doc_chars FROM text_grades JOIN gigs g USING (query_id) JOIN docs dd USING (doc_id) WHERE grade > 0""",
       ("text_grades", "gigs", "docs"))
def pair_texts(spark, d):
    pairs = fu.pair_texts(t.text_grades(spark, d).where("grade > 0"), t.gigs(spark, d), t.docs(spark, d))
    return pairs.select("query_id", "doc_id", F.md5("query_text").alias("query_md5"), F.length("doc_text").cast("bigint").alias("doc_chars"))


@query("top_k", "SELECT query_id, doc_id, rank FROM rrf2 WHERE rank <= 10", ("rrf2",))
def top_k(spark, d):
    return fu.top_k(rrf2(spark, d, top=10), 10).select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@query("restrict_to_pool", """SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM rrf2 SEMI JOIN ev_grades USING (query_id, doc_id)""", ("rrf2", "ev_grades"))
def restrict(spark, d):
    return fu.restrict_to_pool(rrf2(spark, d), t.ev_grades(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


SQL_DIFF = """SELECT query_id, doc_id, 'entering' AS side FROM rrf3 WHERE rank <= 10 AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM rrf2 WHERE rank <= 10)
  UNION ALL SELECT query_id, doc_id, 'leaving' FROM rrf2 WHERE rank <= 10 AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM rrf3 WHERE rank <= 10)"""
fragment("diff", SQL_DIFF, ("rrf2", "rrf3"))


@query("list_diff", "SELECT * FROM diff", ("diff",))
def list_diff(spark, d):
    return fu.list_diff(rrf3(spark, d, top=10), rrf2(spark, d, top=10))


@query("list_diff_summary", """SELECT count(*) AS n_queries, count(n) AS n_changed, coalesce(sum(e), 0)::BIGINT AS n_entering, coalesce(sum(l), 0)::BIGINT AS n_leaving,
  round(coalesce(sum(e), 0)::DOUBLE / count(*), 6) AS entering_per_query FROM ev_queries LEFT JOIN (SELECT query_id, count(*) AS n, count(*) FILTER (side = 'entering') AS e,
  count(*) FILTER (side = 'leaving') AS l FROM diff GROUP BY 1) USING (query_id)""", ("diff", "ev_queries"))
def list_diff_summary(spark, d):
    return fu.list_diff_summary(rrf3(spark, d, top=10), rrf2(spark, d, top=10), t.ev_queries(spark, d))


@query("list_overlap", """SELECT round(avg(o), 6) AS mean_overlap, round(min(o), 6) AS worst_overlap, round(avg((o = 1)::INT), 6) AS identical_share FROM (
  SELECT a.query_id, count(b.rank) / 10.0::DOUBLE AS o FROM (SELECT * FROM rrf3 WHERE rank <= 10) a LEFT JOIN (SELECT * FROM rrf2 WHERE rank <= 10) b USING (query_id, doc_id) GROUP BY 1)""", ("rrf2", "rrf3"))
def list_overlap(spark, d):
    return fu.list_overlap(rrf3(spark, d, top=10), rrf2(spark, d, top=10), 10)


@query("sink_ranked_lists", "SELECT channel, query_id, list(doc_id ORDER BY rank) AS ids FROM ev_lists GROUP BY 1, 2", ("ev_lists",))
def ranked_lists(spark, d):
    """Every channel written to its own folder and read back from there."""
    path = scratch_path(spark, "lists")
    for channel in ("click", "view", "purchase"):
        sink_ranked_lists(t.ev_list(spark, d, channel), path, channel)
    return spark.read.schema("query_id bigint, ids array<bigint>, system string").json(path).withColumnRenamed("system", "channel")
