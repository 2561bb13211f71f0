"""Sources, cleaning, quality filters, incremental embedding and the streaming forms."""

from pyspark.sql import functions as F

from ranklab.catalog import tables as t
from ranklab.catalog.registry import fragment, query
from ranklab.operators import ingest as ig
from ranklab.session import scratch_path
from ranklab.sources import embedding_store as es
from ranklab.sources import readers as rd
from ranklab.sources import schemas
from ranklab.sources import sinks as sk
from ranklab.streaming import judgments as sj


@query("src_entities", "SELECT query_id, round(budget_lo, 6) AS budget_lo, round(budget_hi, 6) AS budget_hi, seniority_needed, strftime(start_date, '%Y-%m-%d') AS start_by, commitment FROM gig_struct", ("gig_struct",))
def entities(spark, d):
    """Written as JSON lines and read back with the schema of the entity."""
    g = t.gig_struct(spark, d).withColumn("start_by", F.when(F.col("start_by") == "asap", "2000-01-01").otherwise(F.col("start_by")))
    path = scratch_path(spark, "gigs")
    g.select(F.col("query_id").alias("hire_id"), "budget_lo", "budget_hi", "seniority_needed", "start_by", "commitment").write.json(path)
    g = rd.read_entities(spark, path, schemas.GIGS).withColumnRenamed("hire_id", "query_id")
    return g.select("query_id", F.round("budget_lo", 6).alias("budget_lo"), F.round("budget_hi", 6).alias("budget_hi"), "seniority_needed", "start_by", "commitment")


@query("src_taxonomy_overlay", """SELECT doc_id, round(coalesce(rate, rate_per_hour), 6) AS rate_per_hour, capacity FROM provider_struct LEFT JOIN (SELECT l_partkey AS doc_id, max(l_extendedprice) AS rate FROM lineitem WHERE l_quantity > 40 GROUP BY 1) USING (doc_id)""", ("provider_struct",))
def overlay(spark, d):
    over = t.table(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.max("l_extendedprice").alias("rate_per_hour"))
    base = t.provider_struct(spark, d).select("doc_id", "rate_per_hour", "capacity")
    return rd.taxonomy_overlay(base, over, "doc_id", ["rate_per_hour"]).withColumn("rate_per_hour", F.round("rate_per_hour", 6))


@query("src_candidates_csv", "SELECT query_id, doc_id, CASE WHEN status = 'ok' THEN grade END AS label, CASE WHEN status = 'ok' THEN score END AS score, NULL::DOUBLE AS tag_score FROM ev_log", ("ev_log",))
def candidates_csv(spark, d):
    ok = F.col("status") == "ok"
    cell = lambda c: F.when(ok, F.col(c).cast("string")).otherwise(F.lit(" "))
    raw = t.ev_log(spark, d).select(F.col("query_id").cast("string").alias("hire_id"), F.col("doc_id").cast("string").alias("provider_id"), cell("grade").alias("label"), cell("score").alias("score"))
    path = scratch_path(spark, "candidates")
    raw.write.option("header", True).csv(path)
    return rd.read_candidates_csv(spark, path, ["score", "tag_score"])


@query("sink_features", "SELECT 'events' AS dataset, 'base' AS variant, label IS NOT NULL AS judged, query_id, doc_id, label FROM candidates", ("candidates",))
def feature_sink(spark, d):
    from ranklab.catalog.pairs import candidates
    rows = candidates(spark, d).select("query_id", "doc_id", "label")
    path = scratch_path(spark, "features")
    sk.sink_features(rows, path, "events")
    return sk.read_features(spark, path, "events").select("dataset", "variant", F.col("judged").cast("boolean").alias("judged"), "query_id", "doc_id", "label")


@query("incremental_embed", """SELECT sha1(text) AS text_key, length(text) AS n_chars FROM (SELECT DISTINCT text FROM conversations) WHERE sha1(text) NOT IN (SELECT sha1(text) FROM conversations WHERE role = 'user')""")
def embed_keys(spark, d):
    """Texts still to be encoded when the store already holds every user turn."""
    c = t.table(spark, d, "conversations")
    store = c.where("role = 'user'").select(es.text_key("text").alias("text_key")).distinct()
    return es.missing_texts(c, store).select("text_key", F.length("text").cast("bigint").alias("n_chars"))


@query("incremental_embed_vectors", """SELECT conv_id, turn, sha1(text) AS text_key, 64::BIGINT AS dim FROM conversations""")
def embed_vectors(spark, d):
    """The whole step: encode what is missing, keep what is stored, return every row with its vector."""
    c = t.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    known = c.where("role = 'user'")
    store = es.encode(es.missing_texts(known, spark.createDataFrame([], "text_key string")), es.hashed_bag_of_words(64))
    out = es.incremental_embed(c, store, es.hashed_bag_of_words(64))
    return out.select("conv_id", "turn", "text_key", F.size("vec").cast("bigint").alias("dim"))


@query("lookup_embeddings_strict", "SELECT vec_id, sha1(vec_id::VARCHAR) AS text_key, len(embedding) AS dim FROM embeddings")
def lookup(spark, d):
    e = t.table(spark, d, "embeddings").withColumn("text", F.col("vec_id").cast("string"))
    store = e.select(es.text_key("text").alias("text_key"), F.col("embedding").alias("vec"))
    return es.lookup_embeddings_strict(e.select("vec_id", "text"), store).select("vec_id", "text_key", F.size("vec").cast("bigint").alias("dim"))


@query("clean_and_type_table", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '=' || c_name WHEN 'MACHINERY' THEN '' ELSE c_name END AS name, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_acctbal END AS budget_lo, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_nationkey END AS commitment FROM customer""")
def clean(spark, d):
    seg = F.col("c_mktsegment")
    raw = t.table(spark, d, "customer").select(
        "c_custkey", F.when(seg == "BUILDING", F.concat(F.lit(" '="), F.col("c_name"))).when(seg == "MACHINERY", F.lit(" null ")).otherwise(F.concat(F.lit("\t"), F.col("c_name"), F.lit("  "))).alias("name"),
        F.when(seg == "FURNITURE", F.lit("")).otherwise(F.col("c_acctbal").cast("string")).alias("budget_lo"),
        F.when(seg == "HOUSEHOLD", F.lit("null")).otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit(".0"))).alias("commitment"))
    return ig.clean_and_type_table(raw, ["name"], ig.GIG_STRUCT)


@query("latest_written_manifest", """SELECT file, arg_max(timestamp, (timestamp, line_no)) AS timestamp, arg_max(line_no, (timestamp, line_no)) AS line_no, arg_max(value > 100, (timestamp, line_no)) AS repaired, arg_max(CASE WHEN value > 20 THEN 'keep' ELSE 'drop' END, (timestamp, line_no)) AS decision
  FROM (SELECT 'f' || user_id::VARCHAR AS file, strftime(ts, '%Y-%m-%d') AS timestamp, event_id AS line_no, value FROM events WHERE event_type IN ('click', 'view'))  GROUP BY 1""")
def manifest(spark, d):
    e = t.table(spark, d, "events")
    log = e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.when(F.col("event_type") == "signup", "PROVIDER").otherwise("HIRER").alias("entity_type"),
                   F.when(F.col("event_type").isin("click", "view", "signup"), "written").otherwise("skipped").alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"),
                   F.col("event_id").alias("line_no"), (F.col("value") > 100).alias("repaired"), F.when(F.col("value") > 20, "keep").otherwise("drop").alias("decision"))
    return ig.latest_written_manifest(log)


@query("quality_filter_gigs", """WITH g AS (SELECT doc_id, trim(split_part(text, chr(10), 1), ' ' || chr(9)) AS title, regexp_replace('Deliverable: ' || text, '^\\s+|\\s+$', '', 'g') AS body, source, lang FROM documents)
  SELECT row_no, hire_title, length(hire_description) AS n_chars, industry FROM (SELECT doc_id AS row_no, title AS hire_title, body AS hire_description, source AS industry, row_number() OVER (PARTITION BY lower(title) ORDER BY doc_id) AS rn FROM g JOIN labels USING (doc_id)
    WHERE quality = 1 AND toxic = 0 AND source <> 'src0' AND lang <> 'de' AND length(body) BETWEEN 300 AND 1200) WHERE rn = 1""")
def gigs_filter(spark, d):
    docs = t.table(spark, d, "documents")
    gigs = docs.select(F.col("doc_id").cast("string").alias("source_file"), F.col("doc_id").alias("row_no"), F.substring_index("text", "\n", 1).alias("hire_title"),
                       F.concat(F.lit("Deliverable: "), F.col("text"), F.lit("\n\nengagement Duration: 3 months")).alias("hire_description"),
                       F.when(F.col("lang") == "de", "notes").otherwise("").alias("hire_description_additional_notes"), F.when(F.col("source") == "src0", "OTHER").otherwise(F.col("source")).alias("industry"))
    review = t.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("file"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("decision"), (F.col("toxic") == 1).alias("repaired"))
    kept = ig.quality_filter_gigs(gigs, review)
    return kept.select("row_no", "hire_title", F.length("hire_description").cast("bigint").alias("n_chars"), "industry")


@query("quality_filter_providers", "SELECT doc_id FROM labels JOIN docs USING (doc_id) WHERE quality = 1 AND trim(title, ' ') <> '' AND regexp_replace(body, '^\\s+|\\s+$', '', 'g') <> ''", ("docs",))
def providers_filter(spark, d):
    rows = t.docs(spark, d).join(t.table(spark, d, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, "PROVIDER").otherwise("UNCERTAIN").alias("classify_label"),
                                                                               F.col("title").alias("about_title"), F.col("body").alias("about_description"))
    return ig.quality_filter_providers(rows).select("doc_id")


@query("stable_surrogate_ids", "SELECT doc_id, source_file, row_number() OVER (ORDER BY source_file) AS provider_id FROM (SELECT doc_id, source || '/' || doc_id::VARCHAR AS source_file FROM documents)")
def surrogate(spark, d):
    rows = t.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_file"))
    return ig.stable_surrogate_ids(rows, "source_file", "provider_id").select("doc_id", "source_file", "provider_id")


@query("fill_rate_report", """SELECT unnest(['seniority_needed', 'seniority', 'available_from']) AS "column", unnest([count(seniority_needed), count(seniority), count(avail_date)]) AS filled, count(*) AS total FROM term_pairs""", ("term_pairs",))
def fill_rate(spark, d):
    return ig.fill_rate_report(t.term_pairs(spark, d), ["seniority_needed", "seniority", "available_from", "not_there"])


@query("uniqueness_check", "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def unique(spark, d):
    return ig.uniqueness_check(t.table(spark, d, "documents").select(F.md5("text").alias("text_md5")), ["text_md5"])


def event_stream(spark, d):
    """events as a file stream, in the shape of the grade log."""
    schema = t.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    s = F.least(F.lit(1.0), F.round(F.col("value") / 150.0 + 1e-9, 2))
    from ranklab.operators.agreement import band_grade
    return raw.select(F.col("event_id").alias("seq"), F.col("user_id").alias("query_id"), (F.col("event_id") % 97).alias("doc_id"),
                      F.when(F.col("event_type") == "error", "error: timeout").otherwise("ok").alias("status"), band_grade(s).alias("grade"), "ts")


def finish(stream):
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


@query("judgment_stream", "SELECT query_id, doc_id, arg_max(grade, seq) AS grade FROM ev_log WHERE status = 'ok' GROUP BY 1, 2", ("ev_log",))
def judgment_stream(spark, d):
    path = scratch_path(spark, "labels")
    finish(sj.judgment_stream(event_stream(spark, d), path, scratch_path(spark, "labels-ckpt"), "last", available_now=True))
    return sj.read_labels(spark, path, "last")


@query("judgment_stream_first_wins", """SELECT query_id, doc_id, grade FROM latest_b UNION ALL SELECT query_id, doc_id, arg_min(grade, seq) FROM ev_log ANTI JOIN latest_b USING (query_id, doc_id) WHERE status = 'ok' GROUP BY 1, 2""", ("ev_log", "latest_b"))
def judgment_stream_first(spark, d):
    from ranklab.operators.labels import latest_ok_grade
    path = scratch_path(spark, "labels")
    finish(sj.judgment_stream(event_stream(spark, d), path, scratch_path(spark, "labels-ckpt"), "first", available_now=True))
    return sj.read_labels(spark, path, "first", latest_ok_grade(t.ev_log_half(spark, d, False)))


fragment("progress", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok') AS n_error,
  round(count(*) FILTER (status <> 'ok')::DOUBLE / count(*), 6) AS error_share FROM ev_log GROUP BY 1, 2""", ("ev_log",))


def as_text(df):
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), F.date_format("window_end", "yyyy-MM-dd HH:mm").alias("window_end"), "n_ok", "n_error", "error_share")


TEXT = "strftime(window_start, '%Y-%m-%d %H:%M') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M') AS window_end, n_ok, n_error, error_share"


@query("grading_progress", f"SELECT {TEXT} FROM progress", ("progress",))
def progress(spark, d):
    return as_text(sj.progress_counts(t.ev_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))))


@query("grading_progress_stream", f"SELECT {TEXT} FROM progress WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)", ("progress",))
def progress_stream(spark, d):
    """Windows the watermark has closed once all files are read."""
    path = scratch_path(spark, "progress")
    finish(sj.grading_progress_stream(event_stream(spark, d), path, scratch_path(spark, "progress-ckpt"), available_now=True))
    return as_text(spark.read.parquet(path))
