"""How the driver's tables play the roles of the data model (DataFrame side and SQL side, written separately).

gigs = benchmark items, providers = documents; vectors = embeddings; taxonomy = orders and their parts;
judgments, channels and the grade log = events; structured terms = lineitem, orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ranklab.catalog.registry import fragment
from ranklab.functions.lexicon import STOPWORDS, SUFFIX_RULES, SYNONYMS, MIN_STEM
from ranklab.functions.text import token_table, tokenize_corpus
from ranklab.operators.agreement import band_grade
from ranklab.operators.labels import gains_from_grades
from ranklab.operators.ordering import rank_list
from ranklab.session import tasks_for

#: Bytes of lines, by the optimizer's estimate, that one task groups: about 350,000.
LINE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text -----------------------------------------------------------------------------------------------------

def docs(spark: SparkSession, d: str) -> DataFrame:
    """documents as providers: title = first line, body = the rest."""
    t = table(spark, d, "documents")
    title = F.substring_index("text", "\n", 1)
    return t.select("doc_id", title.alias("title"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("body"),
                    "text", "source", "lang", "n_chars")


def gigs(spark: SparkSession, d: str) -> DataFrame:
    """benchmark items as gigs: title = first five words, body = the rest."""
    t = table(spark, d, "benchmark")
    return t.select(F.col("item_id").alias("query_id"), F.regexp_extract("text", r"^(\S+(?:\s+\S+){0,4})", 1).alias("title"),
                    F.expr(r"substring(text, length(regexp_extract(text, '^(\\S+(?:\\s+\\S+){0,4})', 1)) + 1)").alias("body"), "text")


fragment("docs", r"""SELECT doc_id, split_part(text, chr(10), 1) AS title,
  substr(text, length(split_part(text, chr(10), 1)) + 2) AS body, text, source, lang, n_chars FROM documents""")
fragment("gigs", r"""SELECT item_id AS query_id, regexp_extract(text, '^(\S+(?:\s+\S+){0,4})', 1) AS title,
  substr(text, length(regexp_extract(text, '^(\S+(?:\s+\S+){0,4})', 1)) + 1) AS body, text FROM benchmark""")

_STOP = ", ".join("'" + w + "'" for w in STOPWORDS)


def sql_words(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9'']+'), lambda w: w NOT IN ({_STOP}))"


def sql_stem(w: str) -> str:
    cases = " ".join(f"WHEN suffix({w}, '{s}') AND length({w}) - {len(s)} + {len(r)} >= {MIN_STEM} "
                     f"THEN substr({w}, 1, length({w}) - {len(s)}) || '{r}'" for s, r in SUFFIX_RULES)
    return f"CASE {cases} ELSE {w} END"


_SYN_VALUES = ", ".join(f"('{k}', '{v}')" for k, vs in SYNONYMS.items() for v in vs)
fragment("syn", f"""SELECT {sql_stem('k')} AS key, {sql_stem('v')} AS synonym FROM (VALUES {_SYN_VALUES}) t(k, v)""")
fragment("doc_terms", f"""SELECT doc_id, {sql_stem('w')} AS term, sum(wt) AS tf FROM (
  SELECT doc_id, 3.0::DOUBLE AS wt, unnest({sql_words('title')}) AS w FROM docs
  UNION ALL SELECT doc_id, 1.0::DOUBLE, unnest({sql_words('body')}) FROM docs) GROUP BY ALL""", ("docs",))
fragment("doc_len", """SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM docs d LEFT JOIN doc_terms USING (doc_id) GROUP BY 1""", ("docs", "doc_terms"))
fragment("gig_base_terms", f"""SELECT query_id, {sql_stem('w')} AS term, sum(wt) AS tf FROM (
  SELECT query_id, 3.0::DOUBLE AS wt, unnest({sql_words('title')}) AS w FROM gigs
  UNION ALL SELECT query_id, 1.0::DOUBLE, unnest({sql_words("title || ' ' || body")}) FROM gigs) GROUP BY ALL""", ("gigs",))
fragment("gig_terms", f"""SELECT query_id, term, sum(tf) AS tf FROM (
  SELECT query_id, term, tf FROM gig_base_terms
  UNION ALL SELECT query_id, synonym, tf FROM gig_base_terms JOIN syn ON key = {sql_stem('term')}) GROUP BY ALL""",
         ("gig_base_terms", "syn"))
fragment("plain_doc_terms", f"""SELECT doc_id, w AS term, count(*)::DOUBLE AS tf FROM (
  SELECT doc_id, unnest({sql_words("title || ' ' || body")}) AS w FROM docs) GROUP BY ALL""", ("docs",))
fragment("plain_doc_len", """SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM docs d LEFT JOIN plain_doc_terms USING (doc_id) GROUP BY 1""",
         ("docs", "plain_doc_terms"))
fragment("plain_gig_terms", f"""SELECT query_id, w AS term, count(*)::DOUBLE AS tf FROM (
  SELECT query_id, unnest({sql_words("title || ' ' || body")}) AS w FROM gigs) GROUP BY ALL""", ("gigs",))


def sql_idf(terms: str) -> str:
    return f"""SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER () ELSE raw END AS idf FROM (
      SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (
        SELECT term, count(*) AS df FROM {terms} GROUP BY 1), (SELECT count(*) AS n FROM docs))"""


def sql_bm25(terms: str, lengths: str, idf: str, q: str) -> str:
    return f"""SELECT query_id, doc_id, round(sum(q.tf * idf * t.tf * 2.5::DOUBLE /
        (t.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
      FROM {q} q JOIN {idf} USING (term) JOIN {terms} t USING (term) JOIN {lengths} USING (doc_id),
        (SELECT avg(dl) AS avgdl FROM {lengths}) GROUP BY 1, 2"""


fragment("idf", sql_idf("doc_terms"), ("doc_terms", "docs"))
fragment("plain_idf", sql_idf("plain_doc_terms"), ("plain_doc_terms", "docs"))
fragment("bm25_scores", sql_bm25("doc_terms", "doc_len", "idf", "gig_terms"), ("doc_terms", "doc_len", "idf", "gig_terms"))
fragment("plain_bm25_scores", sql_bm25("plain_doc_terms", "plain_doc_len", "plain_idf", "plain_gig_terms"),
         ("plain_doc_terms", "plain_doc_len", "plain_idf", "plain_gig_terms"))
for _name in ("bm25", "plain_bm25"):
    fragment(f"{_name}_full", f"""SELECT query_id, doc_id, coalesce(score, 0.0::DOUBLE) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0::DOUBLE) DESC, doc_id) AS rank
      FROM (SELECT query_id, doc_id FROM gigs, docs) LEFT JOIN {_name}_scores USING (query_id, doc_id)""", ("gigs", "docs", f"{_name}_scores"))
    fragment(_name, f"SELECT * FROM {_name}_full WHERE rank <= 50", (f"{_name}_full",))


def text_grades(spark: SparkSession, d: str, tokens: DataFrame | None = None) -> DataFrame:
    """Formula labels of (item, document) pairs sharing a term: the share of the item's distinct terms the document
    has, cut at .95 / .6 / .35."""
    q = tokenize_corpus(gigs(spark, d), "query_id", F.col("text")).select("query_id", "term")
    t = (token_table(docs(spark, d)) if tokens is None else tokens).select("doc_id", F.col("word").alias("term"))
    size = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    common = t.join(q, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("m")).join(size, "query_id")
    share = F.col("m") / F.col("n")
    grade = F.when(share >= 0.95, 3).when(share >= 0.6, 2).when(share >= 0.35, 1).otherwise(0)
    return common.select("query_id", "doc_id", grade.alias("grade"))


fragment("text_grades", f"""SELECT query_id, doc_id, CASE WHEN m / n >= 0.95 THEN 3 WHEN m / n >= 0.6 THEN 2 WHEN m / n >= 0.35 THEN 1 ELSE 0 END AS grade
  FROM (SELECT query_id, doc_id, count(*)::DOUBLE AS m FROM (SELECT query_id, unnest(list_distinct({sql_words('text')})) AS term FROM gigs)
    JOIN (SELECT doc_id, unnest(list_distinct({sql_words('text')})) AS term FROM docs) USING (term) GROUP BY 1, 2)
  JOIN (SELECT query_id, len(list_distinct({sql_words('text')}))::DOUBLE AS n FROM gigs) USING (query_id)""", ("gigs", "docs"))
fragment("text_gains", "SELECT query_id, doc_id, CASE grade WHEN 1 THEN 33.0 WHEN 2 THEN 67.0 ELSE 100.0 END::DOUBLE AS gain FROM text_grades WHERE grade > 0",
         ("text_grades",))


# --- vectors --------------------------------------------------------------------------------------------------

def vectors(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings")
    return t.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def mean_vectors(df: DataFrame, owner: str) -> DataFrame:
    """(owner, vec): component means, combined map-side per (owner, dimension)."""
    parts = df.select(owner, F.posexplode("vec").alias("dim", "x")).groupBy(owner, "dim").agg(F.avg("x").alias("x"))
    return parts.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    return mean_vectors(vectors(spark, d).withColumn("query_id", F.col("label").cast("bigint")), "query_id")


def with_tag_id(df: DataFrame) -> DataFrame:
    """tag_id of a vector: its label and the signs of its first three components (up to 8 tags per label)."""
    sign = lambda i: F.when(F.col("vec")[i] > 0, 1).otherwise(0)
    return df.withColumn("tag_id", (F.col("label") * 8 + sign(0) * 4 + sign(1) * 2 + sign(2)).cast("bigint"))


def tag_titles(spark: SparkSession, d: str) -> DataFrame:
    return mean_vectors(with_tag_id(vectors(spark, d)), "tag_id")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select(F.col("doc_id").alias("text_id"), "vec", "label")


fragment("vecs", "SELECT vec_id AS doc_id, embedding::DOUBLE[] AS vec, label FROM embeddings")
fragment("centroids", """SELECT query_id, list(x ORDER BY dim) AS vec FROM (SELECT label::BIGINT AS query_id, dim, avg(x) AS x
  FROM (SELECT label, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS dim FROM vecs) GROUP BY 1, 2) GROUP BY 1""", ("vecs",))
fragment("tagged_vecs", """SELECT *, (label * 8 + CASE WHEN vec[1] > 0 THEN 4 ELSE 0 END + CASE WHEN vec[2] > 0 THEN 2 ELSE 0 END
  + CASE WHEN vec[3] > 0 THEN 1 ELSE 0 END)::BIGINT AS tag_id FROM vecs""", ("vecs",))
fragment("titles", """SELECT tag_id, list(x ORDER BY dim) AS vec FROM (SELECT tag_id, dim, avg(x) AS x
  FROM (SELECT tag_id, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS dim FROM tagged_vecs) GROUP BY 1, 2) GROUP BY 1""", ("tagged_vecs",))
fragment("sims", """SELECT doc_id AS text_id, tag_id, round(list_cosine_similarity(v.vec, t.vec), 9) + 0.0 AS score
  FROM vecs v, titles t""", ("vecs", "titles"))


def sims(spark: SparkSession, d: str) -> DataFrame:
    from ranklab.operators.hubness import tag_similarities
    return tag_similarities(texts(spark, d), tag_titles(spark, d))


# --- tags and taxonomy ------------------------------------------------------------------------------------------

def order_tags(spark: SparkSession, d: str) -> DataFrame:
    """(role_id = order, tag_id, level): parts hashed to a vocabulary of 300 tags."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("role_id"), (F.col("l_partkey") % 300).alias("tag_id")).agg(
        F.min("l_linenumber").alias("level"))


def customer_tags(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id = customer, tag_id, level). Lines are dealt out by customer over tasks that grow with them: tags, and what is
    summed of them by customer, need no other shuffle, and no task a larger table of groups."""
    lines, o = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), table(spark, d, "orders")
    li, usual, joined = lines, int(spark.conf.get("spark.sql.shuffle.partitions")), tasks_for(lines, 4 * LINE_BYTES, 1)
    if joined > usual:
        li = li.repartition(joined, "l_orderkey")
    rows = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", "l_partkey", "l_linenumber")
    rows = rows.repartition(tasks_for(lines, LINE_BYTES, spark.sparkContext.defaultParallelism), "o_custkey")
    return rows.groupBy(F.col("o_custkey").alias("doc_id"), (F.col("l_partkey") % 300).alias("tag_id")).agg(F.min("l_linenumber").alias("level"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))


def nation_tag_scores(spark: SparkSession, d: str) -> DataFrame:
    """(query_id = nation, tag_id, score = lines of its suppliers, rank): every line counts."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    counts = (li.groupBy("l_suppkey", (F.col("l_partkey") % 300).alias("tag_id")).agg(F.count(F.lit(1)).alias("n"))
              .join(s.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("query_id")), "l_suppkey")
              .groupBy("query_id", "tag_id").agg(F.sum("n").cast("double").alias("score")))
    return rank_list(counts, tie=("tag_id",))


def nation_queries(spark: SparkSession, d: str, m: int = 5) -> DataFrame:
    """(query_id, tag_id): the m tags a nation's suppliers ship most."""
    return nation_tag_scores(spark, d).where(F.col("rank") <= m).select("query_id", "tag_id")


fragment("order_tags", "SELECT l_orderkey AS role_id, l_partkey % 300 AS tag_id, min(l_linenumber) AS level FROM lineitem GROUP BY 1, 2")
fragment("customer_tags", """SELECT o_custkey AS doc_id, l_partkey % 300 AS tag_id, min(l_linenumber) AS level
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
fragment("nation_tags", """SELECT query_id, tag_id, n::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, tag_id) AS rank
  FROM (SELECT s_nationkey::BIGINT AS query_id, l_partkey % 300 AS tag_id, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)""")
fragment("nation_queries", "SELECT query_id, tag_id FROM nation_tags WHERE rank <= 5", ("nation_tags",))
fragment("tag_idf", """SELECT tag_id, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf
  FROM (SELECT tag_id, count(*) AS df FROM customer_tags GROUP BY 1), (SELECT count(*) AS n FROM customer)""", ("customer_tags",))


def roles(spark: SparkSession, d: str) -> DataFrame:
    """(role_id = order, track_id = nation of its customer)."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.select(F.col("o_orderkey").alias("role_id"), "o_custkey").join(
        c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("track_id")), "o_custkey").select("role_id", "track_id")


def tracks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("track_id"), F.col("n_name").alias("name"),
                                            F.col("n_regionkey").cast("bigint").alias("region_id"))


def tag_vocab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select((F.col("p_partkey") % 300).alias("tag_id")).distinct()


fragment("roles", "SELECT o_orderkey AS role_id, c_nationkey::BIGINT AS track_id FROM orders JOIN customer ON o_custkey = c_custkey")
fragment("tracks", "SELECT n_nationkey::BIGINT AS track_id, n_name AS name, n_regionkey::BIGINT AS region_id FROM nation")
fragment("vocab", "SELECT DISTINCT p_partkey % 300 AS tag_id FROM part")
fragment("tagsets", """SELECT role_id, coalesce(string_agg(tag_id::VARCHAR, ',' ORDER BY tag_id), '') AS tagset
  FROM roles LEFT JOIN order_tags USING (role_id) GROUP BY 1""", ("roles", "order_tags"))


def market_roles(spark: SparkSession, d: str) -> DataFrame:
    """(role_id, track_id): one job role per nation and market segment; the track is the nation."""
    segment = F.element_at(F.create_map(*[x for i, s in enumerate(SEGMENTS) for x in (F.lit(s), F.lit(i))]), F.col("c_mktsegment"))
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("track_id"),
                    (F.col("c_nationkey") * 5 + segment).cast("bigint").alias("role_id"))


# The market segments of the customer table, in alphabetical order.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def market_bridge(spark: SparkSession, d: str) -> DataFrame:
    """(role_id, tag_id, level): all tags a role has bought; level = the tag's rank in the role."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    buyers = o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(market_roles(spark, d), "o_custkey").select("l_orderkey", "role_id")
    bought = (li.select("l_orderkey", (F.col("l_partkey") % 300).alias("tag_id")).join(buyers, "l_orderkey")
              .groupBy("role_id", "tag_id").agg(F.count(F.lit(1)).cast("double").alias("score")))
    return rank_list(bought, keys=("role_id",), tie=("tag_id",), out="level").select("role_id", "tag_id", "level")


_SEG_CASE = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEGMENTS))
fragment("market_customers", f"""SELECT c_custkey AS o_custkey, c_nationkey::BIGINT AS track_id,
  (c_nationkey * 5 + CASE c_mktsegment {_SEG_CASE} END)::BIGINT AS role_id FROM customer""")
fragment("market_roles", "SELECT DISTINCT role_id, track_id FROM market_customers", ("market_customers",))
fragment("market_bridge", """SELECT role_id, tag_id, row_number() OVER (PARTITION BY role_id ORDER BY n DESC, tag_id) AS level
  FROM (SELECT role_id, l_partkey % 300 AS tag_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN market_customers USING (o_custkey) GROUP BY 1, 2)""", ("market_customers",))


# --- events: channels, grades, log ------------------------------------------------------------------------------

CHANNELS = ("click", "view", "purchase")


def ev_scores(spark: SparkSession, d: str) -> DataFrame:
    """(channel, query_id = user, doc_id, score): three channels' scores from the event values."""
    e = table(spark, d, "events").where(F.col("event_type").isin(*CHANNELS))
    return e.groupBy(F.col("event_type").alias("channel"), F.col("user_id").alias("query_id"), (F.col("event_id") % 97).alias("doc_id")).agg(
        F.round(F.sum("value"), 6).alias("score"))


def ev_score_queries(spark: SparkSession, d: str) -> DataFrame:
    """The queries of `ev_scores`, each once, without making the scores."""
    return table(spark, d, "events").where(F.col("event_type").isin(*CHANNELS)).select(F.col("user_id").alias("query_id")).distinct()


def ev_lists(spark: SparkSession, d: str) -> DataFrame:
    """(channel, query_id, doc_id, score, rank). A list has at most 97 documents."""
    return rank_list(ev_scores(spark, d), keys=("channel", "query_id"))


def ev_list(spark: SparkSession, d: str, channel: str) -> DataFrame:
    return ev_lists(spark, d).where(F.col("channel") == channel).drop("channel")


def ev_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("query_id")).distinct()


def ev_grades(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, doc_id, grade): the judged pairs, from the signup and error events."""
    e = table(spark, d, "events").where(F.col("event_type").isin("signup", "error"))
    best = e.groupBy(F.col("user_id").alias("query_id"), (F.col("event_id") % 97).alias("doc_id")).agg(F.max("value").alias("v"))
    return best.select("query_id", "doc_id", F.when(F.col("v") >= 100, 3).when(F.col("v") >= 60, 2).when(F.col("v") >= 25, 1).otherwise(0).alias("grade"))


def ev_gains(spark: SparkSession, d: str) -> DataFrame:
    return gains_from_grades(ev_grades(spark, d))


fragment("ev_scores", """SELECT event_type AS channel, user_id AS query_id, event_id % 97 AS doc_id, round(sum(value), 6) AS score
  FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2, 3""")
fragment("ev_lists", "SELECT *, row_number() OVER (PARTITION BY channel, query_id ORDER BY score DESC, doc_id) AS rank FROM ev_scores", ("ev_scores",))
for _c in CHANNELS:
    fragment(f"ev_{_c}", f"SELECT query_id, doc_id, score, rank FROM ev_lists WHERE channel = '{_c}'", ("ev_lists",))
fragment("ev_queries", "SELECT DISTINCT user_id AS query_id FROM events")
fragment("ev_grades", """SELECT query_id, doc_id, CASE WHEN v >= 100 THEN 3 WHEN v >= 60 THEN 2 WHEN v >= 25 THEN 1 ELSE 0 END AS grade
  FROM (SELECT user_id AS query_id, event_id % 97 AS doc_id, max(value) AS v FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1, 2)""")
fragment("ev_gains", "SELECT query_id, doc_id, CASE grade WHEN 1 THEN 33.0 WHEN 2 THEN 67.0 ELSE 100.0 END::DOUBLE AS gain FROM ev_grades WHERE grade > 0", ("ev_grades",))


def ev_log(spark: SparkSession, d: str) -> DataFrame:
    """events as the append-only judgment log: error events failed, the others carry a 0-1 score, its band grade and
    a grade distribution whose P(>= 2) equals the score."""
    e = table(spark, d, "events")
    s = F.least(F.lit(1.0), F.round(F.col("value") / 150.0 + 1e-9, 2))
    rows = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("query_id"), (F.col("event_id") % 97).alias("doc_id"),
                    F.when(F.col("event_type") == "error", "error: timeout").otherwise("ok").alias("status"), s.alias("score"), "event_type", "ts")
    one = F.lit(1.0) - F.col("score")
    return rows.select("seq", "query_id", "doc_id", "status", "score", band_grade(F.col("score")).alias("grade"),
                       F.array(one * one, F.col("score") * one, F.col("score") * one, F.col("score") * F.col("score")).alias("probs"),
                       F.lit("rubric_0_3.v2-repro").alias("prompt_version"), "event_type", "ts")


def ev_log_half(spark: SparkSession, d: str, first: bool) -> DataFrame:
    """The log of one of two graders: click, view and error events, or purchase and signup events."""
    kinds = ("click", "view", "error") if first else ("purchase", "signup")
    return ev_log(spark, d).where(F.col("event_type").isin(*kinds))


fragment("ev_log", """SELECT event_id AS seq, user_id AS query_id, event_id % 97 AS doc_id,
  CASE WHEN event_type = 'error' THEN 'error: timeout' ELSE 'ok' END AS status, s AS score,
  (s >= 0.175)::INT + (s >= 0.5)::INT + (s >= 0.825)::INT AS grade, s * (1 - s) + s * s AS p_ge2, event_type, ts
  FROM (SELECT *, least(1.0::DOUBLE, round(value / 150.0::DOUBLE + 1e-9, 2)) AS s FROM events)""")
fragment("log_a", "SELECT * FROM ev_log WHERE event_type IN ('click', 'view', 'error')", ("ev_log",))
fragment("log_b", "SELECT * FROM ev_log WHERE event_type IN ('purchase', 'signup')", ("ev_log",))
fragment("latest_a", "SELECT query_id, doc_id, arg_max(grade, seq) AS grade, arg_max(score, seq) AS score FROM log_a WHERE status = 'ok' GROUP BY 1, 2", ("log_a",))
fragment("latest_b", "SELECT query_id, doc_id, arg_max(grade, seq) AS grade, arg_max(score, seq) AS score FROM log_b WHERE status = 'ok' GROUP BY 1, 2", ("log_b",))


# --- structured terms -------------------------------------------------------------------------------------------

def gig_struct(spark: SparkSession, d: str) -> DataFrame:
    """orders as gigs with structured terms."""
    o = table(spark, d, "orders")
    mid = F.col("o_totalprice") / 250.0
    p = F.col("o_orderpriority")
    return o.select(F.col("o_orderkey").alias("query_id"), (mid * 0.8).alias("budget_lo"), (mid * 1.2).alias("budget_hi"),
                    F.when(p.isin("1-URGENT", "2-HIGH"), "expert").when(p == "3-MEDIUM", "senior").when(p == "4-NOT SPECIFIED", "mid").alias("seniority_needed"),
                    F.when(p == "1-URGENT", "asap").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("start_by"),
                    (F.col("o_orderkey") % 5 + 1).cast("int").alias("commitment"), F.col("o_custkey").alias("custkey"))


def provider_struct(spark: SparkSession, d: str) -> DataFrame:
    """parts as providers with structured terms (the date comes from the line that pairs them)."""
    p = table(spark, d, "part")
    kind = F.col("p_type")
    phrase = (F.when(F.col("p_size") <= 10, "Free immediately").when(F.col("p_size") <= 20, "Weekday evenings")
              .when(F.col("p_size") <= 30, "2 weeks' notice").otherwise("By arrangement"))
    return p.select(F.col("p_partkey").alias("doc_id"), F.col("p_retailprice").alias("rate_per_hour"),
                    F.when(kind.isin("STANDARD", "SMALL"), "mid").when(kind.isin("MEDIUM", "ECONOMY"), "senior").when(kind == "LARGE", "expert").alias("seniority"),
                    (F.col("p_size") % 5 + 1).cast("int").alias("capacity"), phrase.alias("availability"), F.col("p_brand").alias("brand"), kind.alias("kind"))


def term_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every line as a (gig, provider) pair with both sides' terms."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "R", "now").when(F.col("l_returnflag") == "A", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("available_from"))
    return li.join(gig_struct(spark, d), "query_id").join(provider_struct(spark, d), "doc_id")


fragment("gig_struct", """SELECT o_orderkey AS query_id, o_totalprice / 250.0::DOUBLE * 0.8::DOUBLE AS budget_lo, o_totalprice / 250.0::DOUBLE * 1.2::DOUBLE AS budget_hi,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'expert' WHEN o_orderpriority = '3-MEDIUM' THEN 'senior' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'mid' END AS seniority_needed,
  CASE WHEN o_orderpriority = '1-URGENT' THEN DATE '2000-01-01' ELSE o_orderdate::DATE END AS start_date,
  (o_orderkey % 5 + 1)::INT AS commitment, o_custkey AS custkey FROM orders""")
fragment("provider_struct", """SELECT p_partkey AS doc_id, p_retailprice AS rate_per_hour,
  CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN 'mid' WHEN p_type IN ('MEDIUM', 'ECONOMY') THEN 'senior' WHEN p_type = 'LARGE' THEN 'expert' END AS seniority,
  (p_size % 5 + 1)::INT AS capacity, CASE WHEN p_size <= 10 THEN 1.0 WHEN p_size <= 20 THEN 0.6 WHEN p_size <= 30 THEN 0.2 ELSE 0.5 END::DOUBLE AS phrase_score,
  p_brand AS brand, p_type AS kind FROM part""")
fragment("term_pairs", """SELECT l_orderkey AS query_id, l_partkey AS doc_id, l_linenumber AS line,
  CASE WHEN l_returnflag = 'R' THEN DATE '2000-01-01' WHEN l_returnflag = 'A' THEN l_shipdate::DATE END AS avail_date, g.* EXCLUDE (query_id), p.* EXCLUDE (doc_id)
  FROM lineitem JOIN gig_struct g ON l_orderkey = g.query_id JOIN provider_struct p ON l_partkey = p.doc_id""", ("gig_struct", "provider_struct"))
_LEVEL = "CASE {0} WHEN 'mid' THEN 0 WHEN 'senior' THEN 1 WHEN 'expert' THEN 2 END"
NEED, HAVE = _LEVEL.format("seniority_needed"), _LEVEL.format("seniority")
fragment("mismatch_pairs", f"""SELECT query_id, doc_id, line, list_filter([CASE WHEN rate_per_hour > 1.4::DOUBLE * budget_hi THEN 'budget' END,
  CASE WHEN abs({NEED} - {HAVE}) = 2 THEN 'seniority' END, CASE WHEN date_diff('day', start_date, avail_date) > 30 THEN 'start' END,
  CASE WHEN commitment - capacity >= 2 THEN 'days' END], lambda k: k IS NOT NULL) AS kinds FROM term_pairs""", ("term_pairs",))


def as_of():
    """The anchor date of the stand-in data."""
    return F.lit("2000-01-01").cast("date")


# Synonyms of frequent syllable words of the conversation texts.
TEST_SYNONYMS = {"les": ("articles", "pluriels"), "des": ("articles",), "que": ("pronoms", "querying"), "und": ("verbindung",),
                 "onesen": ("fund",), "the": ("articles",)}
_TEST_VALUES = ", ".join(f"('{k}', '{v}')" for k, vs in TEST_SYNONYMS.items() for v in vs)
fragment("syn2", f"""SELECT {sql_stem('k')} AS key, {sql_stem('v')} AS synonym FROM (VALUES {_TEST_VALUES}) t(k, v)""")
fragment("expand_base", f"""SELECT query_id, {sql_stem('w')} AS term, count(*)::DOUBLE AS tf
  FROM (SELECT conv_id AS query_id, unnest({sql_words('text')}) AS w FROM conversations) GROUP BY 1, 2""")
