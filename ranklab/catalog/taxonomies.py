"""Taxonomy operators over orders, parts, customers and nations."""

from pyspark.sql import functions as F

from ranklab.catalog import tables as t
from ranklab.catalog.registry import fragment, query, shown6
from ranklab.operators import tags as tg
from ranklab.operators import taxonomy as tx
from ranklab.operators.ordering import rank_list


def sectors(spark, d):
    region = t.table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("region_id"), F.col("r_name").alias("sector"))
    return t.tracks(spark, d).join(region, "region_id").select("track_id", "sector")


def truncated(spark, d):
    """Names as a short column would have stored them, for the tracks with two-digit numbers."""
    names = t.tracks(spark, d).where(F.length("name") > 8)
    return names.select(F.col("name").alias("stored"), F.concat(F.lit("NATION number "), F.substring("name", 8, 10)).alias("original"))


@query("taxonomy_assemble", """SELECT role_id, track_id, CASE WHEN length(name) > 8 THEN 'NATION number ' || substr(name, 8, 10) ELSE name END AS track_name, r_name AS sector,
  coalesce(n, 0) AS n_tags, coalesce(tags, []) AS tags FROM roles JOIN tracks USING (track_id) JOIN region ON r_regionkey = region_id
  LEFT JOIN (SELECT role_id, count(*) AS n, list(tag_id ORDER BY tag_id) AS tags FROM order_tags GROUP BY 1) USING (role_id)""", ("roles", "tracks", "order_tags"))
def assemble(spark, d):
    return tx.taxonomy_assemble(t.roles(spark, d), t.order_tags(spark, d), t.tracks(spark, d), sectors(spark, d), truncated(spark, d))


def bridge_rows(spark, d):
    """The raw bridge: one row per line, so repeated pairs are visible to the checks."""
    return t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("role_id"), (F.col("l_partkey") % 300).alias("tag_id"))


@query("taxonomy_verify", """WITH bridge AS (SELECT l_orderkey AS role_id, l_partkey % 300 AS tag_id FROM lineitem), lv AS (SELECT DISTINCT l_orderkey AS role_id, l_partkey % 300 AS tag_id FROM lineitem WHERE l_linenumber <= 5)
  SELECT 'rows:roles' AS "check", abs((SELECT count(*) FROM roles) - 15000) AS n_bad UNION ALL SELECT 'rows:tags', abs((SELECT count(*) FROM vocab) - 300)
  UNION ALL SELECT 'rows:tracks', abs((SELECT count(*) FROM tracks) - 25) UNION ALL SELECT 'duplicate_pairs', (SELECT count(*) FROM bridge) - (SELECT count(*) FROM (SELECT DISTINCT * FROM bridge))
  UNION ALL SELECT 'unknown_roles', (SELECT count(DISTINCT role_id) FROM bridge WHERE role_id NOT IN (SELECT role_id FROM roles))
  UNION ALL SELECT 'unknown_tags', (SELECT count(DISTINCT tag_id) FROM bridge WHERE tag_id NOT IN (SELECT tag_id FROM vocab))
  UNION ALL SELECT 'unknown_tracks', (SELECT count(DISTINCT track_id) FROM roles WHERE track_id NOT IN (SELECT track_id FROM tracks))
  UNION ALL SELECT 'only_in_levels', (SELECT count(*) FROM (SELECT * FROM lv EXCEPT SELECT * FROM bridge))
  UNION ALL SELECT 'only_in_bridge', (SELECT count(*) FROM (SELECT * FROM bridge EXCEPT SELECT * FROM lv))""", ("roles", "vocab", "tracks"))
def verify(spark, d):
    levels = t.table(spark, d, "lineitem").where("l_linenumber <= 5").select(F.col("l_orderkey").alias("role_id"), (F.col("l_partkey") % 300).alias("tag_id"))
    return tx.taxonomy_verify(t.roles(spark, d), t.tag_vocab(spark, d), t.tracks(spark, d), bridge_rows(spark, d), levels, {"roles": 15000, "tags": 300, "tracks": 25})


@query("equivalence_classes", "SELECT role_id, min(role_id) OVER (PARTITION BY tagset) AS class_id FROM tagsets", ("tagsets",))
def equivalence(spark, d):
    return tx.equivalence_classes(t.roles(spark, d), t.order_tags(spark, d))


@query("shared_tagset_count", """SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_sharing, count(*) AS n_classes, sum(n)::BIGINT AS n_roles FROM (SELECT tagset, count(*) AS n FROM tagsets GROUP BY 1)""", ("tagsets",))
def shared(spark, d):
    return tx.shared_tagset_count(t.roles(spark, d), t.order_tags(spark, d))


@query("duplicate_names", "SELECT p_name AS name, count(*) OVER (PARTITION BY p_name) AS n_ids, p_partkey AS id FROM part QUALIFY n_ids > 1")
def duplicate_names(spark, d):
    return tx.duplicate_names(t.table(spark, d, "part"), "p_partkey", "p_name")


@query("display_name_restore", """SELECT track_id, name, CASE WHEN length(name) > 8 THEN 'NATION number ' || substr(name, 8, 10) ELSE name END AS display_name FROM tracks""", ("tracks",))
def display_names(spark, d):
    return tx.display_name_restore(t.tracks(spark, d), truncated(spark, d))


fragment("market_idf", """SELECT tag_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT tag_id, count(*) AS df FROM market_bridge GROUP BY 1), (SELECT count(*) AS n FROM market_roles)""",
         ("market_bridge", "market_roles"))
fragment("nation_roles", """SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, role_id AS doc_id, round(2.2::DOUBLE / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * sum(idf), 9) AS score FROM nation_queries JOIN market_idf USING (tag_id)
  JOIN market_bridge USING (tag_id) JOIN (SELECT role_id, count(*) AS dl FROM market_bridge GROUP BY 1) USING (role_id),
  (SELECT (SELECT count(*) FROM market_bridge)::DOUBLE / count(*) AS avgdl FROM market_roles) GROUP BY query_id, role_id, dl, avgdl)""", ("nation_queries", "market_idf", "market_bridge", "market_roles"))


def market(spark, d):
    roles = t.market_roles(spark, d).select("role_id", "track_id").distinct()
    return roles, t.market_bridge(spark, d)


def nation_role_ranks(spark, d):
    roles, bridge = market(spark, d)
    return tg.tag_rank(bridge.withColumnRenamed("role_id", "doc_id"), roles.select(F.col("role_id").alias("doc_id")), t.nation_queries(spark, d))


@query("track_distribution", """SELECT query_id, track_id, round(mass + 2.5e-10, 6) + 0.0 AS mass, row_number() OVER (PARTITION BY query_id ORDER BY mass DESC, track_id) AS track_rank FROM (
  SELECT query_id, track_id, round(sum(score) / sum(sum(score)) OVER (PARTITION BY query_id), 9) AS mass FROM nation_roles JOIN market_roles ON role_id = doc_id WHERE rank <= 10 GROUP BY 1, 2)""", ("nation_roles", "market_roles"))
def track_distribution(spark, d):
    out = tx.track_distribution(nation_role_ranks(spark, d), market(spark, d)[0])
    return out.select("query_id", "track_id", shown6("mass"), F.col("track_rank").cast("bigint").alias("track_rank"))


@query("taxonomy_profile", """WITH s AS (SELECT role_id, count(tag_id) AS n FROM roles LEFT JOIN order_tags USING (role_id) GROUP BY 1)
  SELECT count(*) AS n_roles, min(n) AS min_tags, (list(n ORDER BY n))[count(*) // 2 + 1] AS median_tags, max(n) AS max_tags, round(avg(n), 6) AS mean_tags,
  (SELECT count(*) FROM vocab WHERE tag_id NOT IN (SELECT tag_id FROM order_tags)) AS n_unused_tags FROM s""", ("roles", "order_tags", "vocab"))
def profile(spark, d):
    return tx.taxonomy_profile(t.roles(spark, d), t.tag_vocab(spark, d), t.order_tags(spark, d))


@query("most_generic_tags", "SELECT tag_id, count(*) AS n_roles FROM order_tags GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", ("order_tags",))
def generic(spark, d):
    return tx.most_generic_tags(t.order_tags(spark, d))


@query("level_histogram", "SELECT level, count(*) AS n FROM order_tags GROUP BY 1", ("order_tags",))
def levels(spark, d):
    return tx.level_histogram(t.order_tags(spark, d))


@query("track_union_docs", "SELECT DISTINCT track_id, tag_id FROM order_tags JOIN roles USING (role_id)", ("order_tags", "roles"))
def union_docs(spark, d):
    return tx.track_union_docs(t.order_tags(spark, d), t.roles(spark, d))
