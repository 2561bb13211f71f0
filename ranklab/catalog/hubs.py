"""Tagging by similarity and hubness correction: every embedding is a text, label-and-sign groups are tags."""

from pyspark.sql import functions as F

from ranklab.catalog import tables as t
from ranklab.catalog.registry import fragment, query, shown6, shown9
from ranklab.operators import hubness as hb
from ranklab.operators import tags as tg
from ranklab.operators.similarity import top_k_cosine
from ranklab.session import scratch_path

TOP = "row_number() OVER (PARTITION BY text_id ORDER BY score DESC, tag_id) AS rank"


def r6(df, *cols):
    return df.select(*[shown6(c) if c in (cols or ("score",)) else F.col(c) for c in df.columns])


def ranked6(df):
    return df.select("text_id", "tag_id", shown6("score"), F.col("rank").cast("bigint").alias("rank"))


@query("tag_text_corpus", f"SELECT text_id, tag_id, round(score + 2.5e-10, 6) + 0.0 AS score, {TOP} FROM sims QUALIFY rank <= 30", ("sims",))
def tag_texts(spark, d):
    return ranked6(hb.tag_text_corpus(t.texts(spark, d), t.tag_titles(spark, d), 30))


fragment("stats", "SELECT tag_id, avg(score) AS mean, greatest(stddev_pop(score), 1e-6) AS sd FROM sims GROUP BY 1", ("sims",))


@query("hubness_stats", "SELECT tag_id, round(mean, 6) AS mean, round(sd, 6) AS sd FROM stats", ("stats",))
def stats(spark, d):
    out = hb.hubness_stats_blocked(t.texts(spark, d), t.tag_titles(spark, d))
    return out.select("tag_id", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


fragment("centered", "SELECT text_id, tag_id, round(score - mean, 9) AS score FROM sims JOIN stats USING (tag_id)", ("sims", "stats"))
fragment("zscored", "SELECT text_id, tag_id, round((score - mean) / sd, 9) AS score FROM sims JOIN stats USING (tag_id)", ("sims", "stats"))
fragment("pooled", """SELECT text_id, tag_id, round(c / CASE WHEN sd > 0 THEN sd ELSE 1 END, 9) AS score FROM (SELECT text_id, tag_id, score - mean AS c FROM sims JOIN stats USING (tag_id)),
  (SELECT stddev_pop(score - mean) AS sd FROM sims JOIN stats USING (tag_id))""", ("sims", "stats"))


@query("hubness_center", f"SELECT text_id, tag_id, round(score + 2.5e-10, 6) + 0.0 AS score, {TOP} FROM centered QUALIFY rank <= 20", ("centered",))
def center(spark, d):
    return ranked6(hb.tag_corrected(t.texts(spark, d), t.tag_titles(spark, d), "center", 20))


@query("hubness_z", f"SELECT text_id, tag_id, round(score + 2.5e-10, 6) + 0.0 AS score, {TOP} FROM zscored QUALIFY rank <= 20", ("zscored",))
def zscore(spark, d):
    return ranked6(hb.tag_corrected(t.texts(spark, d), t.tag_titles(spark, d), "z", 20))


@query("hubness_pooled_unit", f"SELECT text_id, tag_id, round(score + 2.5e-10, 6) + 0.0 AS score, {TOP} FROM pooled QUALIFY rank <= 20", ("pooled",))
def pooled(spark, d):
    return ranked6(hb.tag_corrected(t.texts(spark, d), t.tag_titles(spark, d), "pooled", 20))


@query("hubness_csls", f"""SELECT text_id, tag_id, round(score + 2.5e-13, 9) + 0.0 AS score, {TOP} FROM (SELECT text_id, tag_id, round(score - 0.5::DOUBLE * r, 12) AS score FROM sims JOIN (SELECT tag_id, avg(score) AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY score DESC, text_id) AS p FROM sims) WHERE p <= 10 GROUP BY 1) USING (tag_id)) QUALIFY rank <= 20""", ("sims",))
def csls(spark, d):
    out = hb.tag_corrected(t.texts(spark, d), t.tag_titles(spark, d), "csls", 20)
    return out.select("text_id", "tag_id", shown9("score"), F.col("rank").cast("bigint").alias("rank"))


@query("hubness_dsm", f"""WITH tt AS (SELECT stddev_pop(score - mean) AS t FROM sims JOIN stats USING (tag_id)),
  l AS (SELECT tag_id, max(score) AS peak, any_value(t) AS t, ln(avg(exp((score - pk) / t))) AS lme FROM (SELECT *, max(score) OVER (PARTITION BY tag_id) AS pk FROM sims), tt GROUP BY 1)
  SELECT text_id, tag_id, round(score + 2.5e-10, 6) + 0.0 AS score, {TOP} FROM (SELECT text_id, tag_id, round(score - peak - t * lme, 9) AS score FROM sims JOIN l USING (tag_id)) QUALIFY rank <= 20""", ("sims", "stats"))
def dsm(spark, d):
    return ranked6(hb.tag_corrected(t.texts(spark, d), t.tag_titles(spark, d), "dsm", 20))


@query("global_unit", f"SELECT text_id, tag_id, round(score + 2.5e-10, 6) + 0.0 AS score, {TOP} FROM (SELECT text_id, tag_id, round((score - m) / sd, 9) AS score FROM sims, (SELECT avg(score) AS m, stddev_pop(score) AS sd FROM sims)) QUALIFY rank <= 20", ("sims",))
def global_unit(spark, d):
    return ranked6(hb.tag_corrected(t.texts(spark, d), t.tag_titles(spark, d), "global", 20))


fragment("ensemble", """SELECT text_id, tag_id, round(s / sd, 9) AS score FROM (SELECT text_id, tag_id, 0.75::DOUBLE * p.score + 0.25::DOUBLE * z.score AS s FROM pooled p JOIN zscored z USING (text_id, tag_id)),
  (SELECT stddev_pop(0.75::DOUBLE * p.score + 0.25::DOUBLE * z.score) AS sd FROM pooled p JOIN zscored z USING (text_id, tag_id))""", ("pooled", "zscored"))


@query("score_ensemble", f"SELECT text_id, tag_id, round(score + 2.5e-10, 6) + 0.0 AS score, {TOP} FROM ensemble QUALIFY rank <= 20", ("ensemble",))
def ensemble(spark, d):
    return ranked6(hb.tag_corrected(t.texts(spark, d), t.tag_titles(spark, d), "mix", 20, weights=(3.0, 1.0)))


def role_vectors(spark, d):
    """Roles of the vector world: mean vectors of (label, three sign bits of the middle components); a role carries
    the tags of its members."""
    sign = lambda i: F.when(F.col("vec")[i] > 0, 1).otherwise(0)
    rows = t.with_tag_id(t.vectors(spark, d)).withColumn("role_id", (F.col("label") * 8 + sign(31) * 4 + sign(32) * 2 + sign(33)).cast("bigint"))
    bridge = rows.select("role_id", "tag_id").distinct()
    return t.mean_vectors(rows, "role_id"), bridge


fragment("role_rows", """SELECT *, (label * 8 + CASE WHEN vec[32] > 0 THEN 4 ELSE 0 END + CASE WHEN vec[33] > 0 THEN 2 ELSE 0 END + CASE WHEN vec[34] > 0 THEN 1 ELSE 0 END)::BIGINT AS role_id FROM tagged_vecs""", ("tagged_vecs",))
fragment("vec_roles", """SELECT role_id, list(x ORDER BY dim) AS vec FROM (SELECT role_id, dim, avg(x) AS x FROM (SELECT role_id, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS dim FROM role_rows) GROUP BY 1, 2) GROUP BY 1""", ("role_rows",))
fragment("vec_bridge", "SELECT DISTINCT role_id, tag_id FROM role_rows", ("role_rows",))


def sql_unit(v):
    return f"list_transform({v}, lambda x: x / CASE WHEN sqrt(list_dot_product({v}, {v})) = 0 THEN 1 ELSE sqrt(list_dot_product({v}, {v})) END)"


def sql_proto(bridge_filter="TRUE"):
    return f"""SELECT t.tag_id, dim, CASE WHEN px IS NULL THEN tx ELSE 0.5::DOUBLE * tx + 0.5::DOUBLE * px END AS x FROM (
      SELECT tag_id, unnest(u) AS tx, unnest(range(1, len(u) + 1)) AS dim FROM (SELECT tag_id, {sql_unit('vec')} AS u FROM titles)) t
      LEFT JOIN (SELECT tag_id, dim, s / CASE WHEN sqrt(sum(s * s) OVER (PARTITION BY tag_id)) = 0 THEN 1 ELSE sqrt(sum(s * s) OVER (PARTITION BY tag_id)) END AS px FROM (
        SELECT tag_id, dim, sum(x) AS s FROM vec_bridge JOIN (SELECT role_id, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS dim FROM (SELECT role_id, {sql_unit('vec')} AS u FROM vec_roles)) USING (role_id)
        WHERE {bridge_filter} GROUP BY 1, 2)) p USING (tag_id, dim)"""


@query("tag_prototypes", f"SELECT tag_id, dim::BIGINT AS dim, round(x, 6) + 0.0 AS x FROM ({sql_proto()})", ("titles", "vec_roles", "vec_bridge"))
def prototypes(spark, d):
    roles, bridge = role_vectors(spark, d)
    out = hb.tag_prototypes(t.tag_titles(spark, d), roles, bridge, 0.5)
    return out.select("tag_id", F.posexplode("vec").alias("pos", "x")).select("tag_id", (F.col("pos") + 1).cast("bigint").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


@query("role_knn_tags", """WITH s AS (SELECT doc_id AS text_id, role_id, round(list_cosine_similarity(v.vec, r.vec), 9) / 0.05::DOUBLE AS z FROM vecs v, vec_roles r),
  w AS (SELECT text_id, role_id, exp(z - max(z) OVER (PARTITION BY text_id)) / sum(exp(z - mz)) OVER (PARTITION BY text_id) AS w FROM (SELECT *, max(z) OVER (PARTITION BY text_id) AS mz FROM s))
  SELECT text_id, tag_id, round(round(sum(w), 9) + 2.5e-10, 6) + 0.0 AS score FROM w JOIN vec_bridge USING (role_id) GROUP BY 1, 2""", ("vecs", "vec_roles", "vec_bridge"))
def role_knn(spark, d):
    roles, bridge = role_vectors(spark, d)
    return r6(hb.role_knn_tags(t.texts(spark, d), roles, bridge, 0.05))


@query("weighted_tag_vectors", f"SELECT text_id, tag_id, round(score - 1.0::DOUBLE + 2.5e-10, 6) + 0.0 AS weight FROM (SELECT *, {TOP} FROM pooled QUALIFY rank <= 20) WHERE score > 1.0", ("pooled",))
def weighted_vectors(spark, d):
    return r6(tg.weighted_tag_vectors(hb.tag_corrected(t.texts(spark, d), t.tag_titles(spark, d), "pooled", 20), "text_id", 20, 1.0), "weight")


fragment("pair_cos", f"""SELECT a.query_id, b.text_id AS doc_id, round(sum(a.w * b.w) / (qn * dn), 9) AS score FROM
  (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS qn FROM (SELECT query_id, tag_id, score - 1.0::DOUBLE AS w FROM (SELECT query_id, tag_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tag_id) AS rk FROM gig_pooled) WHERE rk <= 20 AND score > 1.0)) a
  JOIN (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY text_id)) AS dn FROM (SELECT text_id, tag_id, score - 1.0::DOUBLE AS w FROM (SELECT *, {TOP} FROM pooled QUALIFY rank <= 20) WHERE score > 1.0)) b USING (tag_id)
  GROUP BY a.query_id, b.text_id, qn, dn""", ("pooled", "gig_pooled"))
fragment("gig_sims", "SELECT query_id, tag_id, round(list_cosine_similarity(c.vec, t.vec), 9) AS score FROM centroids c, titles t", ("centroids", "titles"))
fragment("gig_pooled", """SELECT query_id, tag_id, round(c / sd, 9) AS score FROM (SELECT query_id, tag_id, score - avg(score) OVER (PARTITION BY tag_id) AS c FROM gig_sims),
  (SELECT stddev_pop(c) AS sd FROM (SELECT score - avg(score) OVER (PARTITION BY tag_id) AS c FROM gig_sims))""", ("gig_sims",))


def side_weights(spark, d):
    """Weighted tag vectors of both sides; each side is corrected with its own statistics."""
    docs = tg.weighted_tag_vectors(hb.tag_corrected(t.texts(spark, d), t.tag_titles(spark, d), "pooled", 20), "text_id", 20, 1.0).withColumnRenamed("text_id", "doc_id")
    gigs = t.centroids(spark, d).withColumnRenamed("query_id", "text_id")
    gig_scores = hb.tag_corrected(gigs, t.tag_titles(spark, d), "pooled", 20)
    return docs, tg.weighted_tag_vectors(gig_scores, "text_id", 20, 1.0).withColumnRenamed("text_id", "query_id")


def pair_scores(spark, d):
    docs, gigs = side_weights(spark, d)
    return tg.tag_weighted_cosine(docs, gigs, 0.0)


@query("pair_cosine_scores", "SELECT query_id, doc_id, round(score + 2.5e-10, 6) + 0.0 AS score FROM pair_cos", ("pair_cos",))
def pair_cosine(spark, d):
    return r6(pair_scores(spark, d))


fragment("vec_gold", "SELECT v.doc_id AS text_id, b.tag_id FROM (SELECT DISTINCT label, tag_id FROM tagged_vecs) b JOIN vecs v USING (label)", ("tagged_vecs", "vecs"))


def gold(spark, d):
    by_label = t.with_tag_id(t.vectors(spark, d)).select("label", "tag_id").distinct()
    return t.texts(spark, d).select("text_id", "label").join(by_label, "label").select("text_id", "tag_id")


@query("gold_tag_metrics", f"""SELECT f.text_id, m, round(count(g.tag_id)::DOUBLE / m + 2.5e-10, 6) + 0.0 AS precision, round(count(g.tag_id)::DOUBLE / any_value(n) + 2.5e-10, 6) + 0.0 AS recall, (count(g.tag_id) > 0)::INT::DOUBLE AS hit
  FROM (SELECT doc_id AS text_id, m FROM vecs, (VALUES (5), (10), (20), (30)) t(m)) f JOIN (SELECT text_id, count(*) AS n FROM vec_gold GROUP BY 1) s USING (text_id)
  JOIN (SELECT text_id, tag_id, {TOP} FROM centered) p ON p.text_id = f.text_id AND p.rank <= f.m LEFT JOIN vec_gold g ON g.text_id = p.text_id AND g.tag_id = p.tag_id GROUP BY 1, 2""", ("centered", "vec_gold", "vecs"))
def gold_metrics(spark, d):
    best = hb.tag_corrected(t.texts(spark, d), t.tag_titles(spark, d), "center", 30)
    return r6(hb.gold_tag_metrics(best, gold(spark, d), t.texts(spark, d)), "precision", "recall")


@query("tag_slot_stats", f"""WITH c AS (SELECT tag_id, count(text_id) AS n FROM titles LEFT JOIN (SELECT text_id, tag_id, {TOP} FROM sims QUALIFY rank <= 5) USING (tag_id) GROUP BY 1)
  SELECT round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, tag_id LIMIT 10))::DOUBLE / sum(n), 6) AS slot_share, count(*) FILTER (n > 0) AS tags_used, count(*) FILTER (n = 0) AS tags_never_picked, max(n) AS max_tag_freq FROM c""", ("titles", "sims"))
def slots(spark, d):
    titles = t.tag_titles(spark, d)
    return tg.tag_slot_stats(hb.tag_text_corpus(t.texts(spark, d), titles, 5), titles, 5, 10)


NEW_QUERY_SQL = f"""WITH q AS (SELECT query_id, tag_id, score - mean AS w FROM (SELECT query_id, tag_id, round(score - mean, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score - mean, 9) DESC, tag_id) AS rk, 0 AS mean FROM gig_sims JOIN stats USING (tag_id)) WHERE rk <= 10),
  dt AS (SELECT text_id AS doc_id, tag_id FROM (SELECT *, {TOP} FROM centered QUALIFY rank <= 10)),
  i AS (SELECT tag_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT tag_id, count(*) AS df FROM dt GROUP BY 1), (SELECT count(*) AS n FROM vecs))
  SELECT query_id, doc_id, round(score + 2.5e-10, 6) + 0.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, round(sum(idf), 9) AS score FROM q JOIN i USING (tag_id) JOIN dt USING (tag_id) GROUP BY 1, 2) QUALIFY rank <= 20"""
NEW_QUERY_NEEDS = ("gig_sims", "stats", "centered", "vecs")


def new_query_tables(spark, d):
    """Tag vectors, their statistics and the texts' tags. Every text keeps 10 tags, so the length factor of the scorer is 1."""
    texts, titles = t.texts(spark, d), t.tag_titles(spark, d)
    means = hb.correction(texts, titles, "center")
    st = means.select("tag_id", F.col("p")[0].alias("mean"), F.lit(1.0).alias("sd"))
    doc_tags = hb.corrected_top(texts, titles, means, "center", 10).select(F.col("text_id").alias("doc_id"), "tag_id", "score", "rank")
    return titles, st, doc_tags, t.vectors(spark, d).select("doc_id")


@query("tag_rank_new_query", NEW_QUERY_SQL, NEW_QUERY_NEEDS)
def new_query(spark, d):
    """Centroid queries that are in no tag table, corrected with the stored statistics of the corpus."""
    from ranklab.operators.new_query import rank_new_queries
    out = rank_new_queries(t.centroids(spark, d), *new_query_tables(spark, d), m=10, k=20)
    return out.select("query_id", "doc_id", shown6("score"), F.col("rank").cast("bigint").alias("rank"))


@query("tag_rank_new_query_stream", NEW_QUERY_SQL, NEW_QUERY_NEEDS)
def new_query_streamed(spark, d):
    """The same queries as a stream of files, one a batch, against published tables."""
    from ranklab.streaming import new_queries as nq
    tables, inbox, path = (scratch_path(spark, n) for n in ("tag-tables", "queries", "ranked"))
    nq.publish(tables, *new_query_tables(spark, d))
    t.centroids(spark, d).repartition(3, "query_id").write.parquet(inbox)
    stream = spark.readStream.schema("query_id BIGINT, vec ARRAY<DOUBLE>").option("maxFilesPerTrigger", 1).parquet(inbox)
    running = nq.new_query_stream(stream, tables, path, scratch_path(spark, "ranked-ckpt"), available_now=True, m=10, k=20)
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()
    return spark.read.parquet(path).select("query_id", "doc_id", shown6("score"), F.col("rank").cast("bigint").alias("rank"))


@query("cross_half_recipe", f"""WITH h AS (SELECT role_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '7', 'halves', role_id::VARCHAR))) <= count(*) OVER () // 2 THEN 'dev' ELSE 'test' END AS half FROM vec_roles),
  p AS (SELECT 'dev' AS trained, * FROM ({sql_proto("role_id IN (SELECT role_id FROM h WHERE half = 'dev')")}) UNION ALL SELECT 'test', * FROM ({sql_proto("role_id IN (SELECT role_id FROM h WHERE half = 'test')")})),
  pv AS (SELECT trained, tag_id, list(x ORDER BY dim) AS vec FROM p GROUP BY 1, 2)
  SELECT role_id, half, tag_id, round(score + 2.5e-10, 6) + 0.0 AS score, row_number() OVER (PARTITION BY role_id ORDER BY score DESC, tag_id) AS rank FROM (
    SELECT role_id, half, tag_id, round(list_cosine_similarity(r.vec, pv.vec), 9) AS score FROM vec_roles r JOIN h USING (role_id) JOIN pv ON trained <> half) QUALIFY rank <= 10""", ("titles", "vec_roles", "vec_bridge"))
def cross_half(spark, d):
    from ranklab.operators.new_query import cross_half_prototypes
    roles, bridge = role_vectors(spark, d)
    out = cross_half_prototypes(t.tag_titles(spark, d), roles, bridge, 0.5, m=10)
    return out.select("role_id", "half", "tag_id", shown6("score"), F.col("rank").cast("bigint").alias("rank"))


@query("cross_half_knn_and_mix", """WITH h AS (SELECT role_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '7', 'halves', role_id::VARCHAR))) <= count(*) OVER () // 2 THEN 'dev' ELSE 'test' END AS half FROM vec_roles),
  s AS (SELECT v.role_id AS text_id, half AS trained, r.role_id, round(list_cosine_similarity(v.vec, r.vec), 9) / 0.05::DOUBLE AS z FROM vec_roles v, vec_roles r JOIN h USING (role_id)),
  w AS (SELECT text_id, trained, role_id, exp(z - mz) / sum(exp(z - mz)) OVER (PARTITION BY text_id, trained) AS w FROM (SELECT *, max(z) OVER (PARTITION BY text_id, trained) AS mz FROM s)),
  k AS (SELECT trained, text_id, tag_id, round(sum(w), 9) AS score FROM w JOIN vec_bridge USING (role_id) GROUP BY 1, 2, 3),
  f AS (SELECT trained, x.text_id, x.tag_id, coalesce(k.score, 0) AS knn, title FROM (SELECT role_id AS text_id, tag_id, round(list_cosine_similarity(r.vec, t.vec), 9) AS title, trained FROM vec_roles r, titles t, (VALUES ('dev'), ('test')) tr(trained)) x LEFT JOIN k USING (trained, text_id, tag_id)),
  c AS (SELECT *, knn - avg(knn) OVER (PARTITION BY trained, tag_id) AS ck, title - avg(title) OVER (PARTITION BY trained, tag_id) AS ct FROM f),
  u AS (SELECT trained, text_id, tag_id, round(ck / stddev_pop(ck) OVER (PARTITION BY trained), 9) AS uk, round(ct / stddev_pop(ct) OVER (PARTITION BY trained), 9) AS ut FROM c),
  m AS (SELECT trained, text_id, tag_id, uk, (ut + 0.5::DOUBLE * uk) / 1.5::DOUBLE AS mm FROM u),
  a AS (SELECT 'knn' AS recipe, trained, text_id, tag_id, uk AS score FROM m UNION ALL SELECT 'mix', trained, text_id, tag_id, round(mm / stddev_pop(mm) OVER (PARTITION BY trained), 9) FROM m)
  SELECT recipe, role_id, half, tag_id, round(score + 2.5e-10, 6) + 0.0 AS score FROM (SELECT recipe, text_id AS role_id, half, tag_id, score, row_number() OVER (PARTITION BY recipe, text_id ORDER BY score DESC, tag_id) AS rank
    FROM a JOIN h ON h.role_id = text_id WHERE trained <> half) WHERE rank <= 10""", ("vec_roles", "vec_bridge", "titles"))
def cross_half_more(spark, d):
    from ranklab.operators.new_query import cross_half_recipes
    roles, bridge = role_vectors(spark, d)
    out = cross_half_recipes(t.tag_titles(spark, d), roles, bridge, 0.05, 0.5, m=10)
    return out.select("recipe", "role_id", "half", "tag_id", shown6("score"))


LSA_DIMS = (4, 8, 16, 32, 64, 128, 300)


def lsa_lists(spark, d):
    from ranklab.operators.lsa import lsa_sweep
    docs = t.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    return lsa_sweep(t.customer_tags(spark, d), docs, t.nation_queries(spark, d), LSA_DIMS, k=20)


@query("lsa_rank")
def lsa(spark, d):
    """Latent ranking of the customers' tag sets for the nations' tags at seven ranks of one basis."""
    return lsa_lists(spark, d).select("dim", "query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query("lsa_rank_full", """WITH w AS (SELECT doc_id, tag_id, idf FROM customer_tags JOIN tag_idf USING (tag_id)), q AS (SELECT query_id, tag_id, idf FROM nation_queries JOIN tag_idf USING (tag_id)),
  s AS (SELECT query_id, doc_id, sum(w.idf * q.idf) AS dot FROM w JOIN q USING (tag_id) GROUP BY 1, 2), dn AS (SELECT doc_id, sqrt(sum(idf * idf)) AS n FROM w GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(idf * idf)) AS n FROM q GROUP BY 1)
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, round(dot / (dn.n * qn.n) + 2.5e-10, 6) + 0.0 AS score FROM s JOIN dn USING (doc_id) JOIN qn USING (query_id)) QUALIFY rank <= 10""", ("customer_tags", "tag_idf", "nation_queries"))
def lsa_full(spark, d):
    """The rank of the whole vocabulary truncates nothing: every axis' sign cancels, and scores are plain cosines."""
    from ranklab.operators.lsa import lsa_rank
    from ranklab.operators.ordering import rank_list
    docs = t.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    wide = lsa_rank(t.customer_tags(spark, d), docs, t.nation_queries(spark, d), LSA_DIMS[-1], 40).select("query_id", "doc_id", shown6("score"))
    return rank_list(wide, 10).select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))
