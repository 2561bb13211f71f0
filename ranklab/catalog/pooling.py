"""Pools, samples and splits."""

from pyspark.sql import functions as F

from ranklab.catalog import tables as t
from ranklab.catalog.lists import rrf2, rrf3
from ranklab.catalog.registry import fragment, query
from ranklab.catalog.taxonomies import market
from ranklab.operators import fusion as fu
from ranklab.operators import pools as po
from ranklab.session import checkpoint


def sql_key(seed, purpose, *cols):
    return f"md5(concat_ws('|', '{seed}', '{purpose}', " + ", ".join(f"{c}::VARCHAR" for c in cols) + "))"


def sql_long(key):
    return f"('0x' || substr({key}, 1, 15))::UBIGINT::BIGINT"


def pool(spark, d):
    return po.judging_pool([("rrf", rrf2(spark, d), 6), ("click", t.ev_list(spark, d, "click"), 4), ("view", t.ev_list(spark, d, "view"), 4)])


fragment("pool_rows", """SELECT 0 AS no, 'rrf' AS source, query_id, doc_id FROM rrf2 WHERE rank <= 6 UNION ALL SELECT 1, 'click', query_id, doc_id FROM ev_click WHERE rank <= 4
  UNION ALL SELECT 2, 'view', query_id, doc_id FROM ev_view WHERE rank <= 4""", ("rrf2", "ev_click", "ev_view"))
fragment("pool", "SELECT query_id, doc_id, list(source ORDER BY no) AS sources FROM pool_rows GROUP BY 1, 2", ("pool_rows",))
fragment("ev_docs", "SELECT DISTINCT event_id % 97 AS doc_id FROM events")


def ev_docs(spark, d):
    return t.table(spark, d, "events").select((F.col("event_id") % 97).alias("doc_id")).distinct()


@query("judging_pool", "SELECT * FROM pool", ("pool",))
def judging_pool(spark, d):
    return pool(spark, d)


@query("random_outside_pool", f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_key(7, 'outside/docs', 'doc_id')}) AS position, count(*) OVER () AS n FROM ev_docs),
  s AS (SELECT query_id, {sql_long(sql_key(7, 'outside/start', 'query_id'))} AS start FROM ev_queries),
  w AS (SELECT query_id, doc_id, (position - 1 - start % n + n) % n AS step FROM o, s)
  SELECT query_id, doc_id FROM w ANTI JOIN pool USING (query_id, doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY step) <= 3""", ("pool", "ev_docs", "ev_queries"))
def random_outside(spark, d):
    return po.random_outside_pool(t.ev_queries(spark, d), ev_docs(spark, d), pool(spark, d), 3)


@query("pool_additions", "SELECT query_id, doc_id FROM ev_purchase ANTI JOIN pool USING (query_id, doc_id) WHERE rank <= 4", ("pool", "ev_purchase"))
def additions(spark, d):
    return po.pool_additions(t.ev_list(spark, d, "purchase"), pool(spark, d), 4)


@query("pool_cover_k", "SELECT DISTINCT query_id, doc_id FROM ev_lists ANTI JOIN pool USING (query_id, doc_id) WHERE rank <= 8", ("pool", "ev_lists"))
def cover(spark, d):
    return po.pool_cover_k([t.ev_list(spark, d, c) for c in t.CHANNELS], pool(spark, d), 8)


@query("pool_stats", "SELECT min(n) AS min_size, round(avg(n), 6) AS mean_size, max(n) AS max_size, sum(n)::BIGINT AS total_pairs FROM (SELECT query_id, count(*) AS n FROM pool GROUP BY 1)", ("pool",))
def pool_stats(spark, d):
    return po.pool_stats(pool(spark, d))


fragment("split", f"""SELECT query_id, CASE WHEN row_number() OVER (ORDER BY {sql_key(7, 'sat/split', 'query_id')}) <= count(*) OVER () // 2 THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT DISTINCT query_id FROM ev_gains WHERE gain >= 40)""", ("ev_gains",))


def split(spark, d):
    return po.dev_test_split(t.ev_queries(spark, d), t.ev_gains(spark, d))


@query("compared_pool", """SELECT DISTINCT query_id, doc_id FROM (SELECT * FROM rrf2 UNION ALL SELECT * FROM rrf3 UNION ALL SELECT * FROM ev_purchase) WHERE rank <= 10 AND query_id IN (SELECT query_id FROM split WHERE split = 'test')""",
       ("rrf2", "rrf3", "ev_purchase", "split"))
def compared(spark, d):
    chosen = split(spark, d).where("split = 'test'")
    return po.compared_pool([rrf2(spark, d), rrf3(spark, d), t.ev_list(spark, d, "purchase")], chosen)


@query("dev_test_split", "SELECT * FROM split", ("split",))
def dev_test(spark, d):
    return split(spark, d)


fragment("classes", "SELECT role_id, min(role_id) OVER (PARTITION BY tagset) AS class_id FROM tagsets", ("tagsets",))


@query("class_split", f"""SELECT role_id, class_id, split FROM classes JOIN (SELECT class_id, CASE WHEN row_number() OVER (ORDER BY {sql_key(7, 'split', 'class_id')}) <= count(*) OVER () // 2 THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT DISTINCT class_id FROM classes)) USING (class_id)""", ("classes",))
def class_split(spark, d):
    from ranklab.operators.taxonomy import equivalence_classes
    return po.class_split(equivalence_classes(t.roles(spark, d), t.order_tags(spark, d)))


_COND = ", ".join(f"('{n}', {s}, '{m}', {w}, {k}, '{src}')" for n, s, m, w, k, src in po.CONDITIONS)
fragment("sampled", f"""SELECT condition, class_id, draw, tag_id, 0 AS wrong FROM (
    SELECT condition, role_id AS class_id, draw, tag_id, size - n_wrong AS take, row_number() OVER (PARTITION BY condition, role_id, draw ORDER BY
      CASE mode WHEN 'specific' THEN df WHEN 'generic' THEN -df ELSE 0 END, CASE mode WHEN 'specific' THEN tag_id WHEN 'generic' THEN -tag_id ELSE 0 END, {sql_key(7, 'queries', 'condition', 'role_id', 'draw', 'tag_id')}) AS pos
    FROM cond_draws JOIN market_bridge USING (role_id) JOIN (SELECT tag_id, count(*) AS df FROM market_bridge GROUP BY 1) USING (tag_id)) WHERE pos <= take
  UNION ALL SELECT condition, class_id, draw, tag_id, 1 FROM (
    SELECT condition, role_id AS class_id, draw, tag_id, n_wrong, row_number() OVER (PARTITION BY condition, role_id, draw ORDER BY {sql_key(7, 'wrong', 'condition', 'role_id', 'draw', 'tag_id')}) AS pos
    FROM cond_draws JOIN siblings USING (role_id) WHERE near) WHERE pos <= n_wrong
  UNION ALL SELECT condition, class_id, draw, tag_id, 1 FROM (
    SELECT condition, role_id AS class_id, draw, tag_id, n_wrong, row_number() OVER (PARTITION BY condition, role_id, draw ORDER BY (position - 1 - {sql_long(sql_key(7, 'wrong/start', 'condition', 'role_id', 'draw'))} % n + n) % n) AS pos
    FROM cond_draws, (SELECT tag_id, row_number() OVER (ORDER BY {sql_key(7, 'vocab', 'tag_id')}) AS position, count(*) OVER () AS n FROM vocab) v
    WHERE n_wrong > 0 AND NOT near AND NOT EXISTS (SELECT 1 FROM market_bridge b WHERE b.role_id = cond_draws.role_id AND b.tag_id = v.tag_id)) WHERE pos <= n_wrong""",
         ("cond_draws", "market_bridge", "siblings", "vocab"))
fragment("siblings", """SELECT r.role_id, x.tag_id FROM market_roles r JOIN (SELECT DISTINCT track_id, tag_id FROM market_bridge JOIN market_roles USING (role_id)) x USING (track_id)
  ANTI JOIN market_bridge b ON b.role_id = r.role_id AND b.tag_id = x.tag_id""", ("market_roles", "market_bridge"))
fragment("cond_draws", f"""SELECT role_id, condition, size, mode, n_wrong, draw, source = 'track' AND coalesce(n_sib, 0) >= n_wrong AND n_wrong > 0 AS near FROM market_roles
  LEFT JOIN (SELECT role_id, count(*) AS n_sib FROM siblings GROUP BY 1) USING (role_id), (SELECT *, unnest(range(1, draws + 1)) AS draw FROM (VALUES {_COND}) c(condition, size, mode, n_wrong, draws, source))""",
         ("market_roles", "siblings"))


def sampler(spark, d, conditions=po.CONDITIONS, made=None):
    from ranklab.operators.taxonomy import track_union_docs
    roles, bridge = (checkpoint(x) for x in market(spark, d)) if made is None else made
    classes = roles.select(F.col("role_id").alias("class_id"), "track_id")
    tags = bridge.select(F.col("role_id").alias("class_id"), "tag_id")
    return po.query_sampler(classes, tags, track_union_docs(bridge, roles), t.tag_vocab(spark, d), conditions)


@query("query_sampler", "SELECT condition, class_id, draw::BIGINT AS draw, tag_id, wrong FROM sampled", ("sampled",))
def query_sampler(spark, d):
    return sampler(spark, d).withColumn("draw", F.col("draw").cast("bigint"))


@query("permuted_control", f"""WITH i AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS a, row_number() OVER (ORDER BY {sql_key(7, 'permute', 'query_id')}) AS b FROM (SELECT DISTINCT query_id FROM nation_queries))
  SELECT x.query_id, q.tag_id FROM i x JOIN i y ON x.a = y.b JOIN nation_queries q ON q.query_id = y.query_id""", ("nation_queries",))
def permuted(spark, d):
    return po.permuted_control(t.nation_queries(spark, d))


@query("stratified_calibration_sample", f"""SELECT query_id, doc_id, grade FROM ev_grades QUALIFY row_number() OVER (PARTITION BY grade ORDER BY {sql_key(7, 'calibration', 'query_id', 'doc_id')}) <= 75""", ("ev_grades",))
def calibration_sample(spark, d):
    return po.stratified_calibration_sample(t.ev_grades(spark, d), 75)


def _audit_sql():
    """The serial draw, stratum by stratum."""
    strata = (("borderline", "score BETWEEN 0.35 AND 0.65", "n * 2 // 15"), ("confident_pos", "score > 0.9", "n // 10"), ("confident_neg", "score < 0.05", "n // 10"))
    head = f"""r AS (SELECT *, {sql_key(8, 'audit', 'query_id', 'doc_id')} AS key FROM (SELECT query_id, doc_id, arg_max(grade, seq) AS grade, arg_max(score, seq) AS score FROM ev_log WHERE status = 'ok' GROUP BY 1, 2)
      ANTI JOIN (SELECT query_id, doc_id FROM ev_grades QUALIFY row_number() OVER (PARTITION BY grade ORDER BY {sql_key(7, 'calibration', 'query_id', 'doc_id')}) <= 20) USING (query_id, doc_id)),
    c AS (SELECT count(DISTINCT query_id) AS n FROM ev_log)"""
    steps = []
    for i, (name, keep, quota) in enumerate(strata):
        free = "".join(f" AND query_id NOT IN (SELECT query_id FROM s{j})" for j in range(i))
        steps.append(f"""s{i} AS (SELECT query_id, doc_id, grade, '{name}' AS stratum FROM (SELECT *, row_number() OVER (ORDER BY key) AS pos FROM (SELECT * FROM r WHERE {keep}{free} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY key) = 1)), c WHERE pos <= {quota})""")
    picked = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(strata)))
    return f"WITH {', '.join([head, *steps])} SELECT printf('A%03d', row_number() OVER (ORDER BY {sql_key(8, 'audit/items', 'query_id', 'doc_id')})) AS item, query_id, doc_id, stratum, grade FROM ({picked})"


@query("stratified_audit_sample", _audit_sql(), ("ev_log", "ev_grades"))
def audit_sample(spark, d):
    """Borderline and confident grades, quotas in proportion to the queries of the log; a short stratum is an error."""
    from ranklab.operators.labels import latest_ok
    log = t.ev_log(spark, d)
    n = log.agg(F.count_distinct("query_id")).first()[0]
    strata = (("borderline", F.col("score").between(0.35, 0.65), n * 2 // 15), ("confident_pos", F.col("score") > 0.9, n // 10), ("confident_neg", F.col("score") < 0.05, n // 10))
    used = po.stratified_calibration_sample(t.ev_grades(spark, d), 20)
    return po.stratified_audit_sample(latest_ok(log, "grade", "score"), strata, used, seed=8)


@query("matched_pair_sample", f"""WITH rows2 AS (SELECT query_id, doc_id, side, grade, {sql_key(10, 'matched', 'query_id', 'doc_id')} AS key FROM diff JOIN ev_grades USING (query_id, doc_id)),
  one AS (SELECT * FROM rows2 QUALIFY row_number() OVER (PARTITION BY query_id, side ORDER BY key) = 1),
  chosen AS (SELECT query_id FROM one GROUP BY 1 HAVING count(*) = 2 ORDER BY {sql_key(10, 'matched/query', 'query_id')} LIMIT 40)
  SELECT query_id, doc_id, side, grade FROM one WHERE query_id IN (SELECT query_id FROM chosen)""", ("diff", "ev_grades"))
def matched(spark, d):
    diff = fu.list_diff(rrf3(spark, d, top=10), rrf2(spark, d, top=10))
    return po.matched_pair_sample(diff, t.ev_grades(spark, d), 40)


@query("hard_negative_triplets", f"""WITH q AS (SELECT query_id, mode(source ORDER BY source) AS x FROM text_grades JOIN docs USING (doc_id) GROUP BY 1),
  best AS (SELECT query_id, doc_id AS positive_id FROM text_gains QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) = 1),
  cat AS (SELECT query_id, positive_id, source AS category FROM best JOIN docs ON doc_id = positive_id),
  o AS (SELECT doc_id, source AS category, row_number() OVER (PARTITION BY source ORDER BY {sql_key(7, 'negatives', 'doc_id')}) AS position, count(*) OVER (PARTITION BY source) AS n FROM docs)
  SELECT query_id, positive_id, doc_id AS negative_id FROM cat JOIN o USING (category) ANTI JOIN (SELECT query_id, doc_id FROM text_gains WHERE gain >= 70) h USING (query_id, doc_id) WHERE doc_id <> positive_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (position - 1 - {sql_long(sql_key(7, 'negatives/start', 'query_id'))} % n + n) % n) = 1""", ("text_grades", "text_gains", "docs"))
def triplets(spark, d):
    """The category of a gig is the source of its best document."""
    from ranklab.operators.labels import gains_from_grades
    gains = checkpoint(gains_from_grades(t.text_grades(spark, d)))
    docs = t.docs(spark, d).select("doc_id", F.col("source").alias("category"))
    best = gains.groupBy("query_id").agg(F.max_by("doc_id", F.struct(F.col("gain"), -F.col("doc_id"))).alias("doc_id"))
    queries = best.join(docs, "doc_id").select("query_id", "category")
    return po.hard_negative_triplets(queries, docs, gains)


@query("train_eval_split", f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {sql_key(7, 'train/eval', 'doc_id')}) <= greatest(floor(count(*) OVER () * 0.15::DOUBLE), 1) THEN 'eval' ELSE 'train' END AS split FROM documents""")
def train_eval(spark, d):
    return po.train_eval_split(t.table(spark, d, "documents"), "doc_id")
