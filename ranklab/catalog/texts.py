"""Text preparation over the whole document and item tables."""

from pyspark.sql import functions as F

from ranklab.catalog import tables as t
from ranklab.catalog.registry import query
from ranklab.functions.text import expand_synonyms, field_weighted_terms, match_text, query_terms, synonym_table, tokenize_corpus


@query("match_text", "SELECT doc_id, md5(CASE WHEN title = '' THEN '' ELSE title || CASE WHEN body = '' THEN '' ELSE ' ' END END || body) AS text_md5 FROM docs", ("docs",))
def match_text_query(spark, d):
    return t.docs(spark, d).select("doc_id", F.md5(match_text("title", "body")).alias("text_md5"))


@query("tokenize_corpus", f"""SELECT doc_id, {t.sql_stem('w')} AS term, count(*)::DOUBLE AS tf
  FROM (SELECT doc_id, unnest({t.sql_words('text')}) AS w FROM documents) GROUP BY 1, 2""")
def tokenize(spark, d):
    return tokenize_corpus(t.table(spark, d, "documents"), "doc_id", F.col("text"), stemmed=True)


@query("field_weighted_terms", "SELECT doc_id, term, tf FROM doc_terms", ("doc_terms",))
def field_weighted(spark, d):
    return field_weighted_terms(t.docs(spark, d), "doc_id", F.col("title"), F.col("body"))


@query("expand_synonyms", f"""SELECT query_id, term, sum(tf) AS tf FROM (
    SELECT query_id, term, tf FROM expand_base
    UNION ALL SELECT query_id, synonym, tf FROM expand_base JOIN syn2 ON key = {t.sql_stem('term')}) GROUP BY 1, 2""",
       ("expand_base", "syn2"))
def expand(spark, d):
    """Synonyms over the conversations: the table's own words are made of synthetic syllables, so a fixed table of
    frequent words with synonyms stands in for the fixed one."""
    c = t.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), "text")
    terms = tokenize_corpus(c, "query_id", F.col("text"), stemmed=True)
    return expand_synonyms(terms, synonym_table(spark, t.TEST_SYNONYMS))


@query("query_terms", "SELECT query_id, term, tf FROM gig_terms", ("gig_terms",))
def query_terms_query(spark, d):
    return query_terms(t.gigs(spark, d), synonym_table(spark))
