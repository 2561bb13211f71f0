"""Retrieval channels."""

from pyspark.sql import functions as F

from ranklab.catalog import tables as t
from ranklab.catalog.registry import query, shown6
from ranklab.operators import tags as tg
from ranklab.operators.bm25 import bm25_rank, okapi_idf, text_index
from ranklab.operators.dense import dense_rank, embedding_variant_compare, matryoshka_sweep

ROUND = "SELECT query_id, doc_id, round(score + 2.5e-10, 6) + 0.0 AS score, rank FROM "


def shown(df, *extra):
    return df.select(*extra, "query_id", "doc_id", shown6("score"), F.col("rank").cast("bigint").alias("rank"))


@query("bm25_baseline", ROUND + "plain_bm25", ("plain_bm25",))
def bm25_baseline(spark, d):
    return shown(bm25_rank(t.docs(spark, d), t.gigs(spark, d), 50, refined=False))


@query("bm25_refined", ROUND + "bm25", ("bm25",))
def bm25_refined(spark, d):
    return shown(bm25_rank(t.docs(spark, d), t.gigs(spark, d), 50))


@query("okapi_idf", "SELECT term, df, round(idf, 6) AS idf FROM idf", ("idf",))
def idf(spark, d):
    return text_index(t.docs(spark, d), True).idf.select("term", "df", F.round("idf", 6).alias("idf"))


def sql_dense(docs, queries, k, dim="64"):
    return f"""SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT query_id, doc_id, round(list_cosine_similarity(q.vec[1:{dim}], v.vec[1:{dim}]), 9) + 0.0 AS score FROM {docs} v, {queries} q) QUALIFY rank <= {k}"""


@query("dense_rank", ROUND + f"({sql_dense('vecs', 'centroids', 50)})", ("vecs", "centroids"))
def dense(spark, d):
    return shown(dense_rank(t.vectors(spark, d), t.centroids(spark, d), 50))


@query("matryoshka_truncate", " UNION ALL ".join(
    f"SELECT {n}::BIGINT AS dim, query_id, doc_id, round(score + 2.5e-10, 6) + 0.0 AS score, rank FROM ({sql_dense('vecs', 'centroids', 20, n)})" for n in (64, 32, 16, 8)), ("vecs", "centroids"))
def matryoshka(spark, d):
    sweep = matryoshka_sweep(t.vectors(spark, d), t.centroids(spark, d), (64, 32, 16, 8), 20)
    return shown(sweep.withColumn("dim", F.col("dim").cast("bigint")), "dim")


@query("embedding_variant_compare", f"""WITH a AS MATERIALIZED ({sql_dense('vecs', 'centroids', 10)}), b AS MATERIALIZED ({sql_dense('vecs', 'centroids', 10, '32')})
  SELECT query_id, round(count(b.rank) / 10.0::DOUBLE, 6) AS overlap, round(avg(abs(a.rank - b.rank)), 6) AS mean_rank_shift FROM a LEFT JOIN b USING (query_id, doc_id) GROUP BY 1""", ("vecs", "centroids"))
def variant_compare(spark, d):
    docs, queries = t.vectors(spark, d), t.centroids(spark, d)
    half = lambda df: df.withColumn("vec", F.slice("vec", 1, 32))
    return embedding_variant_compare(docs, queries, half(docs), half(queries), 10)


SQL_TAG_BM25 = """SELECT query_id, doc_id, round(2.2::DOUBLE / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * sum(idf), 9) AS score
  FROM nation_queries JOIN tag_idf USING (tag_id) JOIN customer_tags USING (tag_id)
  JOIN (SELECT doc_id, count(*) AS dl FROM customer_tags GROUP BY 1) USING (doc_id),
    (SELECT (SELECT count(*) FROM customer_tags)::DOUBLE / count(*) AS avgdl FROM customer) GROUP BY query_id, doc_id, dl, avgdl"""
TAG_NEEDS = ("nation_queries", "tag_idf", "customer_tags")
SQL_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank"


def tag_inputs(spark, d):
    return t.customer_tags(spark, d), t.customers(spark, d), t.nation_queries(spark, d)


@query("tag_bm25", f"SELECT query_id, doc_id, round(score + 2.5e-10, 6) + 0.0 AS score, {SQL_RANK} FROM ({SQL_TAG_BM25}) QUALIFY rank <= 50", TAG_NEEDS)
def tag_bm25(spark, d):
    return shown(tg.tag_rank(*tag_inputs(spark, d), k=50))


@query("tag_coverage", f"""SELECT query_id, doc_id, round(score + 2.5e-10, 6) + 0.0 AS score, {SQL_RANK} FROM (
  SELECT query_id, doc_id, round(count(*)::DOUBLE / n, 9) AS score FROM nation_queries JOIN customer_tags USING (tag_id)
  JOIN (SELECT query_id, count(*) AS n FROM nation_queries WHERE tag_id IN (SELECT tag_id FROM customer_tags) GROUP BY 1) USING (query_id)
  GROUP BY query_id, doc_id, n) QUALIFY rank <= 50""", TAG_NEEDS)
def tag_coverage(spark, d):
    return shown(tg.tag_rank(*tag_inputs(spark, d), k=50, method="coverage"))


@query("tag_idf_overlap", f"""SELECT query_id, doc_id, round(score + 2.5e-10, 6) + 0.0 AS score, {SQL_RANK} FROM (
  SELECT query_id, doc_id, round(sum(idf), 9) AS score FROM nation_queries JOIN tag_idf USING (tag_id) JOIN customer_tags USING (tag_id)
  GROUP BY 1, 2) QUALIFY rank <= 50""", TAG_NEEDS)
def tag_idf_overlap(spark, d):
    return shown(tg.tag_rank(*tag_inputs(spark, d), k=50, method="idf_overlap"))


@query("tag_sum_levels", f"""SELECT query_id, doc_id, round(score + 2.5e-10, 6) + 0.0 AS score, {SQL_RANK} FROM (
  SELECT query_id, doc_id, round(sum(level)::DOUBLE, 9) AS score FROM nation_queries JOIN customer_tags USING (tag_id)
  GROUP BY 1, 2) QUALIFY rank <= 50""", TAG_NEEDS)
def tag_sum_levels(spark, d):
    return shown(tg.tag_rank(*tag_inputs(spark, d), k=50, method="sum_levels"))


@query("tag_from_pairs", """SELECT c_custkey AS doc_id, count(tag_id) AS n_tags, coalesce(list(tag_id ORDER BY tag_id) FILTER (tag_id IS NOT NULL), []) AS tags
  FROM customer LEFT JOIN customer_tags ON doc_id = c_custkey GROUP BY 1""", ("customer_tags",))
def tag_from_pairs(spark, d):
    return tg.tag_from_pairs(t.customer_tags(spark, d), t.customers(spark, d))


def doc_weights(spark, d):
    """A customer's tag weight: 8 - the lowest line number that carries the tag (1..7)."""
    return t.customer_tags(spark, d).select("doc_id", "tag_id", (8.0 - F.col("level")).alias("weight"))


def query_weights(spark, d):
    """A nation's tag weight: its line count, as a share of its best tag's, times 4."""
    s = t.nation_tag_scores(spark, d)
    best = s.groupBy("query_id").agg(F.max("score").alias("best"))
    return s.where(F.col("rank") <= 30).join(best, "query_id").select("query_id", "tag_id", F.round(F.col("score") / F.col("best") * 4, 6).alias("weight"))


SQL_WEIGHTS = """doc_w AS (SELECT doc_id, tag_id, 8.0::DOUBLE - level - {tau} AS w FROM customer_tags WHERE 8.0::DOUBLE - level > {tau}),
  query_w AS (SELECT query_id, tag_id, w - {tau} AS w FROM (SELECT query_id, tag_id, rank, round(score / max(score) OVER (PARTITION BY query_id) * 4, 6) AS w FROM nation_tags)
    WHERE rank <= 30 AND w > {tau} AND tag_id IN (SELECT tag_id FROM customer_tags)),
  wcos AS (SELECT query_id, doc_id, round(sum(d.w * q.w) / (dn * qn), 9) AS score FROM doc_w d JOIN query_w q USING (tag_id)
    JOIN (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM doc_w GROUP BY 1) USING (doc_id) JOIN (SELECT query_id, sqrt(sum(w * w)) AS qn FROM query_w GROUP BY 1) USING (query_id)
    GROUP BY query_id, doc_id, dn, qn)"""


@query("tag_weighted_cosine", "WITH " + SQL_WEIGHTS.format(tau="1.0::DOUBLE") + f" SELECT query_id, doc_id, round(score + 2.5e-10, 6) + 0.0 AS score, {SQL_RANK} FROM wcos QUALIFY rank <= 50",
       ("customer_tags", "nation_tags"))
def tag_weighted_cosine(spark, d):
    from ranklab.operators.ordering import rank_list
    return shown(rank_list(tg.tag_weighted_cosine(doc_weights(spark, d), query_weights(spark, d), 1.0), 50))


def predicted(df, owner):
    from ranklab.operators.ordering import rank_list
    return rank_list(df.withColumnRenamed("weight", "score"), keys=(owner,), tie=("tag_id",))


@query("tag_channel_rank", "WITH best_d AS (SELECT doc_id, tag_id, row_number() OVER (PARTITION BY doc_id ORDER BY level, tag_id) AS r FROM customer_tags QUALIFY r <= 10),"
       """ best_q AS (SELECT query_id, tag_id, rank FROM nation_tags WHERE rank <= 10),
  idf2 AS (SELECT tag_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT tag_id, count(*) AS df FROM best_d GROUP BY 1), (SELECT count(*) AS n FROM customer)),
  s AS (SELECT query_id, doc_id, round(2.2::DOUBLE / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * sum(idf), 9) AS score
    FROM best_q JOIN idf2 USING (tag_id) JOIN best_d USING (tag_id) JOIN (SELECT doc_id, count(*) AS dl FROM best_d GROUP BY 1) USING (doc_id),
      (SELECT (SELECT count(*) FROM best_d)::DOUBLE / count(*) AS avgdl FROM customer) GROUP BY query_id, doc_id, dl, avgdl)
  SELECT query_id, doc_id, round(score + 2.5e-10, 6) + 0.0 AS score, """ + SQL_RANK + " FROM s QUALIFY rank <= 50", ("customer_tags", "nation_tags"))
def tag_channel(spark, d):
    return shown(tg.tag_channel_rank(predicted(doc_weights(spark, d), "doc_id"), predicted(query_weights(spark, d), "query_id"),
                                     t.customers(spark, d), m=10, k=50))
