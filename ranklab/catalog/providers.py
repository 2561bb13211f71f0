"""The provider bench on the events: users and event documents carry ranked tags (bands of the event value)."""

from pyspark.sql import functions as F

from ranklab.catalog import tables as t
from ranklab.catalog.lists import rrf2
from ranklab.catalog.pooling import split, sql_key
from ranklab.catalog.raters import N_BOOT, plus0, sql_ci
from ranklab.catalog.registry import fragment, query
from ranklab.catalog.reports import PKS, PRK
from ranklab.catalog.scores import columns, sql_metrics
from ranklab.operators.ordering import rank_list
from ranklab.plans import providers as pr
from ranklab.session import checkpoint

MS, BS = (5, 10, 20, 30), (0.0, 0.25, 0.5, 0.75, 1.0)
TAGS = 60
_LIVE = "event_type IN ('click', 'view', 'purchase')"


def ranked_tags(spark, d, owner):
    """(owner, tag_id, rank): bands of the event value by their sum, best first."""
    who = F.col("user_id") if owner == "query_id" else F.col("event_id") % 97
    e = t.table(spark, d, "events").where(_LIVE)
    sums = e.groupBy(who.alias(owner), F.pmod(F.floor("value"), F.lit(TAGS)).cast("bigint").alias("tag_id")).agg(F.round(F.sum("value"), 6).alias("score"))
    return rank_list(sums, keys=(owner,), tie=("tag_id",)).select(owner, "tag_id", "rank")


for _owner, _who, _name in (("query_id", "user_id", "gig_tags"), ("doc_id", "event_id % 97", "provider_tags")):
    fragment(_name, f"""SELECT {_owner}, tag_id, row_number() OVER (PARTITION BY {_owner} ORDER BY score DESC, tag_id) AS rank FROM (
      SELECT {_who} AS {_owner}, (floor(value)::BIGINT % {TAGS} + {TAGS}) % {TAGS} AS tag_id, round(sum(value), 6) AS score FROM events WHERE {_LIVE} GROUP BY 1, 2)""")


def sql_grid(tags, ms_doc, ms_query, bs):
    """Scores of cells, cut by cut."""
    values = lambda xs: ", ".join(f"({x})" for x in xs)
    return f"""SELECT m_doc, m_query, b, query_id, doc_id, round(2.2::DOUBLE / (1 + 1.2::DOUBLE * (1 - b + b * dl / avg)) * s, 9) AS score FROM (
      SELECT m_doc, m_query, q.query_id, p.doc_id, dl, avg, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS s
      FROM (SELECT m_doc, x.* FROM provider_tags x, {ms_doc} WHERE rank <= m_doc) p JOIN (SELECT m_query, x.* FROM {tags} x, {ms_query} WHERE rank <= m_query) q USING (tag_id)
      JOIN (SELECT m_doc, tag_id, count(*) AS df FROM provider_tags, {ms_doc} WHERE rank <= m_doc GROUP BY 1, 2) f USING (m_doc, tag_id)
      JOIN (SELECT m_doc, doc_id, count(*) AS dl FROM provider_tags, {ms_doc} WHERE rank <= m_doc GROUP BY 1, 2) l USING (m_doc, doc_id)
      JOIN (SELECT m_doc, count(*)::DOUBLE / (SELECT count(DISTINCT doc_id) FROM provider_tags) AS avg FROM provider_tags, {ms_doc} WHERE rank <= m_doc GROUP BY 1) a USING (m_doc),
      (SELECT count(DISTINCT doc_id) AS n FROM provider_tags) GROUP BY m_doc, m_query, q.query_id, p.doc_id, dl, avg), {bs}"""


_MS = "(VALUES " + ", ".join(f"({m})" for m in MS) + ")"
_BS = "(VALUES " + ", ".join(f"({b}::DOUBLE)" for b in BS) + ") bb(b)"
fragment("dev_q", "SELECT query_id FROM split WHERE split = 'dev'", ("split",))
fragment("tag_grid", sql_grid("(SELECT * FROM gig_tags SEMI JOIN dev_q USING (query_id))", f"{_MS} md(m_doc)", f"{_MS} mq(m_query)", _BS), ("gig_tags", "provider_tags", "dev_q"))
fragment("tag_grid_values", f"""SELECT m_doc, m_query, b, avg(coalesce(h, 0)::DOUBLE / n_rel) AS value FROM (SELECT m_doc, m_query, b, query_id FROM dev_q, {_MS} md(m_doc), {_MS} mq(m_query), {_BS}) f
  JOIN (SELECT query_id, count(*) AS n_rel FROM ev_gains WHERE gain >= 40 GROUP BY 1) r USING (query_id)
  LEFT JOIN (SELECT m_doc, m_query, b, query_id, count(*) AS h FROM (SELECT *, row_number() OVER (PARTITION BY m_doc, m_query, b, query_id ORDER BY score DESC, doc_id) AS rank FROM tag_grid)
    JOIN ev_gains USING (query_id, doc_id) WHERE rank <= 50 AND gain >= 40 GROUP BY 1, 2, 3, 4) USING (m_doc, m_query, b, query_id) GROUP BY 1, 2, 3""", ("tag_grid", "dev_q", "ev_gains"))
fragment("tag_cell", "SELECT m_doc, m_query, b, value FROM tag_grid_values ORDER BY round(value, 9) DESC, m_doc, m_query, abs(b - 0.75), b LIMIT 1", ("tag_grid_values",))
_CELL = [f"(SELECT {c} FROM tag_cell)" for c in ("m_doc", "m_query", "b")]
_RANKED = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM"
fragment("tuned_tag", f"{_RANKED} ({sql_grid('gig_tags', *_CELL)})", ("gig_tags", "provider_tags", "tag_cell"))
fragment("swapped_tags", f"""WITH i AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS a, row_number() OVER (ORDER BY {sql_key(7, 'permute', 'query_id')}) AS b FROM (SELECT DISTINCT query_id FROM gig_tags))
  SELECT x.query_id, q.tag_id, q.rank FROM i x JOIN i y ON x.a = y.b JOIN gig_tags q ON q.query_id = y.query_id""", ("gig_tags",))
fragment("control_tag", f"{_RANKED} ({sql_grid('swapped_tags', *_CELL)})", ("swapped_tags", "provider_tags", "tag_cell"))
fragment("sat_lists", """SELECT 'bm25' AS system, query_id, doc_id, rank FROM ev_click UNION ALL SELECT 'dense', query_id, doc_id, rank FROM ev_view UNION ALL SELECT 'rrf2', query_id, doc_id, rank FROM rrf2
  UNION ALL SELECT 'tag', query_id, doc_id, rank FROM tuned_tag UNION ALL SELECT 'control', query_id, doc_id, rank FROM control_tag""", ("ev_click", "ev_view", "rrf2", "tuned_tag", "control_tag"))
fragment("sat_metrics", sql_metrics("(SELECT * FROM sat_lists SEMI JOIN test_q USING (query_id))", "ev_gains", PKS, PRK, "system", "(SELECT DISTINCT system, q.query_id FROM sat_lists, test_q q)"), ("sat_lists", "test_q", "ev_gains"))
_PC = columns(PKS, PRK)
fragment("sat_long", f"SELECT system, query_id, unnest([{', '.join(chr(39) + c + chr(39) for c in _PC)}]) AS metric, unnest([{', '.join(_PC)}]) AS value FROM sat_metrics", ("sat_metrics",))
fragment("sat_draws", f"""SELECT boot, query_id, count(*) AS times FROM (SELECT boot, ('0x' || substr(md5(concat_ws('|', '7', 'sat/boot', boot::VARCHAR, slot::VARCHAR)), 1, 15))::UBIGINT::BIGINT % n + 1 AS pos FROM (SELECT count(*) AS n FROM test_q), unnest(range(1, {N_BOOT + 1})) b(boot), unnest(range(1, n + 1)) s(slot))
  JOIN (SELECT query_id, row_number() OVER (ORDER BY query_id) AS pos FROM test_q) USING (pos) GROUP BY 1, 2""", ("test_q",))

TUNED = {}


def parts(spark, d):
    """Split halves, tuned channel, control and the other channels, once per session and folder."""
    key = spark.sparkContext.applicationId, d
    if key not in TUNED:
        halves = checkpoint(split(spark, d))
        docs = ranked_tags(spark, d, "doc_id")
        grid, selected, tag, control = pr.tuned_tag_channel(docs, ranked_tags(spark, d, "query_id"), docs.select("doc_id").distinct(), t.ev_gains(spark, d), halves.where("split = 'dev'"), MS, BS)
        channels = {"bm25": checkpoint(t.ev_list(spark, d, "click")), "dense": checkpoint(t.ev_list(spark, d, "view")), "rrf2": checkpoint(rrf2(spark, d)), "tag": tag}
        TUNED[key] = halves.where("split = 'test'").select("query_id"), grid, selected, channels, control
    return TUNED[key]


@query("provider_tag_grid", "SELECT m_doc, m_query, b, round(value, 6) AS value FROM tag_grid_values", ("tag_grid_values",))
def tag_grid(spark, d):
    """Recall at 50 on the dev half of every cut of both sides' tags and every b."""
    return parts(spark, d)[1].select(*pr.CELL, F.round("value", 6).alias("value"))


@query("provider_tag_selected", "SELECT m_doc, m_query, b, round(value, 6) AS value FROM tag_cell", ("tag_cell",))
def tag_selected(spark, d):
    return parts(spark, d)[2].select(*pr.CELL, F.round("value", 6).alias("value"))


@query("provider_channels", sql_ci("sat_long", "system, metric").replace("JOIN draws", "JOIN sat_draws"), ("sat_long", "sat_draws"))
def channels_alone(spark, d):
    """Every channel alone on the test half with intervals, the permuted control among them."""
    test, _, _, channels, control = parts(spark, d)
    return plus0(pr.channel_report(channels | {"control": control}, t.ev_gains(spark, d), test, N_BOOT), "mean", "lo", "hi")


_ALONE = "(SELECT * FROM sat_lists SEMI JOIN test_q USING (query_id) WHERE system IN ('bm25', 'dense', 'tag'))"


@query("provider_marginal_recall", f"""WITH l AS (SELECT * FROM {_ALONE}), pos AS (SELECT query_id, doc_id FROM ev_pos SEMI JOIN test_q USING (query_id)), h AS (SELECT k, a.system, a.query_id, a.doc_id FROM l a SEMI JOIN pos USING (query_id, doc_id), (VALUES (10), (20), (50)) ks(k)
    WHERE a.rank <= k AND NOT EXISTS (SELECT 1 FROM l o WHERE o.system <> a.system AND o.query_id = a.query_id AND o.doc_id = a.doc_id AND o.rank <= k))
  SELECT f.k, f.system AS channel, count(h.query_id) AS n_unique_hits, round(count(DISTINCT h.query_id)::DOUBLE / (SELECT count(*) FROM test_q), 6) AS query_share, round(count(h.query_id)::DOUBLE / (SELECT count(*) FROM pos), 6) AS positive_share
  FROM (SELECT * FROM (SELECT DISTINCT system FROM l), (VALUES (10), (20), (50)) ks(k)) f LEFT JOIN h ON h.k = f.k AND h.system = f.system GROUP BY 1, 2""", ("sat_lists", "test_q", "ev_pos"))
def marginal(spark, d):
    test, _, _, channels, _ = parts(spark, d)
    return pr.marginal_report({n: channels[n] for n in ("bm25", "dense", "tag")}, t.ev_grades(spark, d).where("grade >= 2"), test)


@query("provider_ungraded", """SELECT k, count(*) FILTER (only_t) AS only_pairs, count(*) FILTER (only_t AND g IS NULL) AS only_unjudged, count(*) FILTER (g IS NULL) AS top_k_unjudged FROM (
  SELECT k, p.query_id, p.doc_id, g.grade AS g, NOT EXISTS (SELECT 1 FROM sat_lists o WHERE o.system IN ('bm25', 'dense') AND o.query_id = p.query_id AND o.doc_id = p.doc_id AND o.rank <= k) AS only_t
  FROM (SELECT * FROM tuned_tag, (VALUES (10), (20), (50)) ks(k) WHERE rank <= k) p LEFT JOIN ev_grades g USING (query_id, doc_id)) GROUP BY 1""", ("sat_lists", "tuned_tag", "ev_grades"))
def ungraded(spark, d):
    _, _, _, channels, _ = parts(spark, d)
    return pr.label_gaps(channels, t.ev_grades(spark, d), t.ev_grades(spark, d).where("grade >= 2"))[0]


@query("provider_outside_pool", """SELECT count(*) AS n_outside, count(DISTINCT query_id) AS n_queries, count(p.rank) AS n_found FROM (SELECT * FROM ev_pos ANTI JOIN (SELECT * FROM rrf2 WHERE rank <= 50) USING (query_id, doc_id))
  LEFT JOIN (SELECT * FROM tuned_tag WHERE rank <= 50) p USING (query_id, doc_id)""", ("ev_pos", "rrf2", "tuned_tag"))
def outside(spark, d):
    _, _, _, channels, _ = parts(spark, d)
    return pr.label_gaps(channels, t.ev_grades(spark, d), t.ev_grades(spark, d).where("grade >= 2"))[1]


def _fused_sql():
    names = [f"{m}_{k}" for m, ks in (("p", (10,)), ("r", (10, 50, 100)), ("ndcg", (10,))) for k in ks] + ["mrr"]
    lists = " UNION ALL ".join([f"""SELECT '{w}' AS system, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen) AS rank FROM (
      SELECT query_id, doc_id, round(sum(CASE no WHEN 3 THEN {w}::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)), 12) AS score, min(no * 1000000 + rank) AS first_seen FROM (
        SELECT CASE system WHEN 'bm25' THEN 1 WHEN 'dense' THEN 2 ELSE 3 END AS no, * FROM sat_lists WHERE system IN ('bm25', 'dense', 'tag')) GROUP BY 1, 2)""" for w in ("1.0", "0.5")] + ["SELECT 'rrf2', query_id, doc_id, rank FROM rrf2"])
    fragment("sat_fused", f"SELECT * FROM ({lists}) SEMI JOIN test_q USING (query_id)", ("sat_lists", "rrf2", "test_q"))
    condensed = "(SELECT system, query_id, doc_id, row_number() OVER (PARTITION BY system, query_id ORDER BY rank) AS rank FROM sat_fused SEMI JOIN ev_grades USING (query_id, doc_id))"
    frame = "(SELECT DISTINCT system, q.query_id FROM sat_fused, test_q q)"
    parts_ = [f"SELECT '{tr}' AS treatment, * FROM ({sql_metrics(lst, 'ev_gains', (10,), (10, 50, 100), 'system', frame)})" for tr, lst in (("standard", "sat_fused"), ("condensed", condensed))]
    fragment("sat_fused_long", f"SELECT treatment, system, query_id, unnest([{', '.join(chr(39) + c + chr(39) for c in names)}]) AS metric, unnest([{', '.join(names)}]) AS value FROM ({' UNION ALL '.join(parts_)})", ("sat_fused", "ev_gains", "ev_grades", "test_q"))
    fragment("sat_fused_diff", """SELECT x.system::DOUBLE AS weight, x.treatment, x.metric, x.query_id, x.value - y.value AS value FROM sat_fused_long x JOIN sat_fused_long y ON y.system = 'rrf2' AND x.system <> 'rrf2' AND y.treatment = x.treatment AND y.metric = x.metric AND y.query_id = x.query_id""", ("sat_fused_long",))
    return sql_ci("sat_fused_diff", "weight, treatment, metric").replace("JOIN draws", "JOIN sat_draws")


@query("provider_fused_differences", _fused_sql(), ("sat_fused_diff", "sat_draws"))
def fused(spark, d):
    test, _, _, channels, _ = parts(spark, d)
    return plus0(pr.fused_differences(channels, t.ev_grades(spark, d), t.ev_gains(spark, d), test, n_boot=N_BOOT), "mean", "lo", "hi")
