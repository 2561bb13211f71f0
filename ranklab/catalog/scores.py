"""Ranking metrics."""

from pyspark.sql import functions as F

from ranklab.catalog import tables as t
from ranklab.catalog.lists import rrf2, rrf3
from ranklab.catalog.registry import fragment, query
from ranklab.functions.keys import seeded_key
from ranklab.operators import metrics as m
from ranklab.session import union_all


def sql_metrics(ranked: str, gains: str, ks=(5, 10), recall_ks=None, by: str = "", queries: str | None = None) -> str:
    """Per-query metrics, written as correlated list lookups rather than as the operator's conditional sums."""
    recall_ks = ks if recall_ks is None else recall_ks
    b = f"{by}, " if by else ""
    part = "".join(
        [f", CASE WHEN n = 0 THEN 0 ELSE coalesce(h{k}, 0)::DOUBLE / least(n, {k}) END AS p_{k}" for k in ks]
        + [f", coalesce(h{k}, 0)::DOUBLE / nullif(n_rel, 0) AS r_{k}" for k in recall_ks]
        + [f", CASE WHEN coalesce(i{k}, 0) = 0 THEN 0 ELSE coalesce(d{k}, 0) / i{k} END AS ndcg_{k}" for k in ks])
    hits = "".join(f", count(*) FILTER (rank <= {k} AND gain >= 40) AS h{k}" for k in sorted(set(list(ks) + list(recall_ks))))
    dcg = "".join(f", sum(gain / log2(rank + 1)) FILTER (rank <= {k} AND gain > 0) AS d{k}" for k in ks)
    idcg = "".join(f", sum(gain / log2(pos + 1)) FILTER (pos <= {k}) AS i{k}" for k in ks)
    inner = f"""SELECT {b}query_id, count(*) AS n, min(rank) FILTER (gain >= 40) AS first{hits}{dcg} FROM {ranked} LEFT JOIN {gains} USING (query_id, doc_id) GROUP BY ALL"""
    if queries:
        inner = f"SELECT * REPLACE (coalesce(n, 0) AS n) FROM {queries} LEFT JOIN ({inner}) USING ({b}query_id)"
    return f"""SELECT {b}query_id{part}, coalesce(1.0::DOUBLE / first, 0) AS mrr FROM ({inner}) LEFT JOIN (
      SELECT query_id, count(*) FILTER (gain >= 40) AS n_rel{idcg} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS pos FROM {gains}) GROUP BY 1) USING (query_id)"""


def sql_round(cols, by=""):
    return ", ".join(([by] if by else []) + [f"round(avg({c}), 6) AS {c}" for c in cols])


def columns(ks, recall_ks=None):
    return [f"p_{k}" for k in ks] + [f"r_{k}" for k in (recall_ks or ks)] + [f"ndcg_{k}" for k in ks] + ["mrr"]


fragment("ev_systems", """SELECT 'click' AS system, query_id, doc_id, rank FROM ev_click UNION ALL SELECT 'view', query_id, doc_id, rank FROM ev_view
  UNION ALL SELECT 'purchase', query_id, doc_id, rank FROM ev_purchase UNION ALL SELECT 'rrf2', query_id, doc_id, rank FROM rrf2 UNION ALL SELECT 'rrf3', query_id, doc_id, rank FROM rrf3""",
         ("ev_click", "ev_view", "ev_purchase", "rrf2", "rrf3"))
fragment("ev_metrics", sql_metrics("ev_systems", "ev_gains", by="system"), ("ev_systems", "ev_gains"))


def systems(spark, d):
    lists = t.ev_lists(spark, d).select(F.col("channel").alias("system"), "query_id", "doc_id", "rank")
    fused = [df.select(F.lit(name).alias("system"), "query_id", "doc_id", "rank") for name, df in (("rrf2", rrf2(spark, d)), ("rrf3", rrf3(spark, d)))]
    return union_all([lists, *fused])


def rounded(df, by=("query_id",)):
    return df.select(*[c if c in by else F.round(c, 6).alias(c) for c in df.columns])


ONE = columns((5, 10))
_round_each = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def _single(name, cols):
    @query(name, f"SELECT query_id, {_round_each(cols)} FROM ev_metrics WHERE system = 'rrf2'", ("ev_metrics",))
    def run(spark, d):
        return rounded(m.metrics_per_query(rrf2(spark, d), t.ev_gains(spark, d))).select("query_id", *cols)


for _name, _cols in (("precision_at_k", ["p_5", "p_10"]), ("recall_at_k", ["r_5", "r_10"]), ("ndcg_at_k", ["ndcg_5", "ndcg_10"]), ("mrr", ["mrr"])):
    _single(_name, _cols)


@query("evaluate_all", f"SELECT {sql_round(ONE, 'system')} FROM ev_metrics GROUP BY system", ("ev_metrics",))
def evaluate_all(spark, d):
    return m.evaluate_all(systems(spark, d), t.ev_gains(spark, d), by=["system"])


@query("evaluate_labelled_only", f"SELECT {sql_round(ONE, 'system')} FROM ev_metrics WHERE query_id IN (SELECT query_id FROM ev_grades) GROUP BY system", ("ev_metrics", "ev_grades"))
def evaluate_labelled(spark, d):
    return m.evaluate_labelled_only(systems(spark, d), t.ev_gains(spark, d), t.ev_grades(spark, d), by=["system"])


KS, RKS = (5, 10, 20), (10, 20, 50, 100)


@query("metrics_per_query", f"SELECT system, query_id, {_round_each(columns(KS, RKS))} FROM ({sql_metrics('ev_systems', 'ev_gains', KS, RKS, 'system', '(SELECT DISTINCT system, q.query_id FROM ev_systems, ev_queries q)')})",
       ("ev_systems", "ev_gains", "ev_queries"))
def metrics_per_query(spark, d):
    names = F.array(*[F.lit(s) for s in ("click", "view", "purchase", "rrf2", "rrf3")])
    frame = t.ev_queries(spark, d).withColumn("system", F.explode(names))
    return rounded(m.metrics_per_query(systems(spark, d), t.ev_gains(spark, d), KS, RKS, frame, ["system"]), ("system", "query_id"))


@query("condensed_lists", """SELECT system, query_id, doc_id, row_number() OVER (PARTITION BY system, query_id ORDER BY rank) AS rank FROM ev_systems SEMI JOIN ev_grades USING (query_id, doc_id)""", ("ev_systems", "ev_grades"))
def condensed(spark, d):
    return m.condensed_lists(systems(spark, d), t.ev_grades(spark, d), ["system"]).withColumn("rank", F.col("rank").cast("bigint"))


@query("judged_share", """SELECT system, round(avg(coalesce(s10, 1)), 6) AS judged_share_10, round(avg(coalesce(s20, 1)), 6) AS judged_share_20
  FROM (SELECT DISTINCT system, q.query_id FROM ev_systems, ev_queries q) LEFT JOIN (SELECT system, query_id, avg((g.grade IS NOT NULL)::INT) FILTER (rank <= 10) AS s10,
  avg((g.grade IS NOT NULL)::INT) FILTER (rank <= 20) AS s20 FROM ev_systems LEFT JOIN ev_grades g USING (query_id, doc_id) GROUP BY 1, 2) USING (system, query_id) GROUP BY 1""",
       ("ev_systems", "ev_grades", "ev_queries"))
def judged(spark, d):
    names = F.array(*[F.lit(s) for s in ("click", "view", "purchase", "rrf2", "rrf3")])
    frame = t.ev_queries(spark, d).withColumn("system", F.explode(names))
    return m.judged_share(systems(spark, d), t.ev_grades(spark, d), (10, 20), frame, ["system"])


fragment("ev_pos", "SELECT query_id, doc_id FROM ev_grades WHERE grade >= 2", ("ev_grades",))


@query("unique_positives", """SELECT k, channel, count(h.query_id) AS n_unique_hits, round(count(DISTINCT h.query_id)::DOUBLE / (SELECT count(*) FROM ev_queries), 6) AS query_share,
  round(count(h.query_id)::DOUBLE / (SELECT count(*) FROM ev_pos), 6) AS positive_share
  FROM (SELECT * FROM (SELECT DISTINCT channel FROM ev_lists), (VALUES (5), (10), (20)) ks(k)) f LEFT JOIN (SELECT a.channel, a.query_id, a.doc_id, kk.k FROM ev_lists a SEMI JOIN ev_pos USING (query_id, doc_id), (VALUES (5), (10), (20)) kk(k)
    WHERE a.rank <= kk.k AND NOT EXISTS (SELECT 1 FROM ev_lists o WHERE o.channel <> a.channel AND o.query_id = a.query_id AND o.doc_id = a.doc_id AND o.rank <= kk.k)) h USING (channel, k) GROUP BY 1, 2""",
       ("ev_lists", "ev_pos", "ev_queries"))
def unique_positives(spark, d):
    return m.unique_positive_summary(t.ev_lists(spark, d), t.ev_grades(spark, d).where("grade >= 2"), t.ev_queries(spark, d), (5, 10, 20))


@query("outside_pool_found", """SELECT count(*) AS n_outside, count(DISTINCT query_id) AS n_queries, count(p.rank) AS n_found FROM (SELECT * FROM ev_pos ANTI JOIN (SELECT * FROM rrf2 WHERE rank <= 10) USING (query_id, doc_id))
  LEFT JOIN (SELECT * FROM ev_purchase WHERE rank <= 10) p USING (query_id, doc_id)""", ("ev_pos", "rrf2", "ev_purchase"))
def outside_pool(spark, d):
    return m.outside_pool_found(t.ev_grades(spark, d).where("grade >= 2"), rrf2(spark, d), t.ev_list(spark, d, "purchase"), 10)


@query("ungraded_counts", """SELECT k, count(*) FILTER (only_p) AS only_pairs, count(*) FILTER (only_p AND g IS NULL) AS only_unjudged, count(*) FILTER (g IS NULL) AS top_k_unjudged FROM (
  SELECT k, p.query_id, p.doc_id, g.grade AS g, NOT EXISTS (SELECT 1 FROM ev_lists o WHERE o.channel <> 'purchase' AND o.query_id = p.query_id AND o.doc_id = p.doc_id AND o.rank <= k) AS only_p
  FROM (SELECT * FROM ev_purchase, (VALUES (5), (10), (20)) ks(k) WHERE rank <= k) p LEFT JOIN ev_grades g USING (query_id, doc_id)) GROUP BY 1""", ("ev_lists", "ev_purchase", "ev_grades"))
def ungraded(spark, d):
    lists = t.ev_lists(spark, d)
    return m.ungraded_counts(lists.where("channel = 'purchase'"), lists.where("channel <> 'purchase'"), t.ev_grades(spark, d), (5, 10, 20))


@query("auc", """SELECT lang, n_pos, n_neg, round(auc, 6) AS auc FROM (SELECT lang, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg,
  (sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0), 0) AS auc
  FROM (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS r FROM labels JOIN documents USING (doc_id)) GROUP BY 1)""")
def auc(spark, d):
    rows = t.table(spark, d, "labels").join(t.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return m.auc(rows, "n_chars", "quality", ["lang"]).withColumn("auc", F.round("auc", 6))


@query("pool_metrics", """WITH pool AS (SELECT query_id, doc_id, grade, md5(concat_ws('|', '7', 'tie', doc_id::VARCHAR)) AS tie, coalesce(p.score, 0) AS score FROM ev_grades LEFT JOIN ev_purchase p USING (query_id, doc_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie) AS rank FROM pool),
  mm AS (""" + sql_metrics("(SELECT query_id, doc_id, rank FROM ranked)", "ev_gains") + """),
  r AS (SELECT query_id, grade, rank() OVER (PARTITION BY query_id ORDER BY score) + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2.0::DOUBLE AS mr FROM pool),
  a AS (SELECT query_id, count(*) FILTER (grade >= 2) AS np, count(*) FILTER (grade < 2) AS nn, sum(mr) FILTER (grade >= 2) AS s FROM r GROUP BY 1)
  SELECT query_id, CASE WHEN np > 0 AND nn > 0 THEN round(ndcg_5, 6) END AS ndcg_5, CASE WHEN np > 0 AND nn > 0 THEN round(ndcg_10, 6) END AS ndcg_10,
  round((s - np * (np + 1) / 2.0::DOUBLE) / nullif(np * nn, 0), 6) AS auc FROM a JOIN mm USING (query_id)""", ("ev_grades", "ev_purchase", "ev_gains"))
def pool_metrics(spark, d):
    pool = t.ev_grades(spark, d).withColumn("tie", seeded_key(7, "tie", "doc_id"))
    return rounded(m.pool_metrics(t.ev_list(spark, d, "purchase"), pool, t.ev_gains(spark, d)))


@query("complementarity", """WITH both2 AS (SELECT query_id, c.score AS d, coalesce(v.score, 0) AS s FROM ev_click c LEFT JOIN ev_view v USING (query_id, doc_id)),
  rk AS (SELECT query_id, rank() OVER (PARTITION BY query_id ORDER BY d) + (count(*) OVER (PARTITION BY query_id, d) - 1) / 2.0::DOUBLE AS rd,
    rank() OVER (PARTITION BY query_id ORDER BY s) + (count(*) OVER (PARTITION BY query_id, s) - 1) / 2.0::DOUBLE AS rs FROM both2),
  rho AS (SELECT query_id, CASE WHEN stddev_pop(rd) = 0 OR stddev_pop(rs) = 0 THEN 0 ELSE corr(rd, rs) END AS spearman FROM rk GROUP BY 1),
  novel AS (SELECT query_id, count(*) / 10.0::DOUBLE AS nv FROM (SELECT * FROM ev_view WHERE rank <= 10) ANTI JOIN (SELECT * FROM rrf2 WHERE rank <= 10) USING (query_id, doc_id) GROUP BY 1)
  SELECT query_id, round(spearman, 6) AS spearman, round(coalesce(nv, 0), 6) AS novelty FROM rho LEFT JOIN novel USING (query_id)""", ("ev_click", "ev_view", "rrf2"))
def complementarity(spark, d):
    view = t.ev_list(spark, d, "view").withColumn("tie", F.col("doc_id"))
    return rounded(m.complementarity(view, t.ev_list(spark, d, "click"), rrf2(spark, d), 10))


@query("embedding_positive_cosine", """SELECT dim::INT AS dim, count(*) AS n_pairs, round(avg(list_cosine_similarity(a.vec[1:dim], p.vec[1:dim])), 6) AS mean_cosine
  FROM vecs a JOIN vecs p ON p.doc_id = a.doc_id + 1, (VALUES (64), (16)) d(dim) WHERE a.doc_id % 2 = 0 GROUP BY 1""", ("vecs",))
def positive_cosines(spark, d):
    """Every even vector with its odd successor, at the full and at the cut width."""
    vectors = t.vectors(spark, d)
    pairs = vectors.where("doc_id % 2 = 0").select(F.col("doc_id").alias("anchor"), (F.col("doc_id") + 1).alias("positive"))
    return m.positive_cosine(pairs, vectors, (64, 16))


@query("embedding_spread", """WITH u AS (SELECT dim, x / sqrt(list_dot_product(vec, vec)) AS x FROM (SELECT vec, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS dim FROM vecs)), s AS (SELECT dim, sum(x) AS s, sum(x * x) AS sq, count(*) AS n FROM u GROUP BY 1)
  SELECT max(n) AS n, 0::BIGINT AS n_nan, round((sum(s * s) - sum(sq)) / (max(n) * (max(n) - 1)::DOUBLE), 6) AS mean_pairwise_cosine, (sum(s * s) - sum(sq)) / (max(n) * (max(n) - 1)::DOUBLE) > 0.95 AS collapsed FROM s""", ("vecs",))
def spread(spark, d):
    return m.embedding_spread(t.vectors(spark, d))
