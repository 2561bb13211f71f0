"""Shards that all hold the mixture of the whole table: stratified interleaving with DataFrame functions only.

Rows are shuffled within their source by a seeded hash and ranked; rank r of n becomes the fractional rank
(r - u) / n, with a seeded start u in (0, 1) per source, so that sources of a few rows spread out, too. Sorting all rows
by fractional rank interleaves the sources in proportion, and cutting that order into equal runs gives shards whose
counts differ by at most one and whose mixture is that of the table.

Neither rank needs a sort of a whole source or of the whole table in one task. Hashes and fractional ranks are both
spread evenly over their range, so equal steps of the range are buckets of about equal size, however large one source
is: rows are ranked inside a bucket, and the counts of the buckets before it are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ranklab.llm.common import CRC_TABLE_SQL, crc_sql, written

SHARDS = 16
SEED = 7
#: Rows of a bucket, about; copies of one row that share a hash.
BUCKET_ROWS = 1 << 15
CHUNK = 1 << 12
_BITS = 48


def _hash(*parts: Column) -> Column:
    """The first 48 bits of a seeded md5, which every engine can follow."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _BITS // 4), 16, 10).cast("long")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _before(counts: DataFrame, keys: list[str], bucket: str, n: str) -> DataFrame:
    """For every bucket the rows in those before it, per `keys`: one row per bucket goes into the window."""
    return counts.withColumn("_ahead", F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source") -> DataFrame:
    """Every row's id with `size` (bytes of its text and one), `text_crc32`, `source`, `shard` and `slot` (its place in
    the shard, from 0).

    Rows come back one for one, equal rows too, each with a slot of its own; which of several equal rows gets which slot
    makes no difference. A null text has no bytes, a null source is a source of its own, a null id is hashed as empty.
    With fewer rows than shards some shards stay empty; an empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), (F.octet_length(body) + 1).cast("long").alias("_size"),
                       F.crc32(body).alias("_crc"))
    # Equal rows are counted before any of them is moved, then dealt out in chunks with a hash each.
    counted = slim.groupBy("_id", "_source", "_size", "_crc").agg(F.count("*").alias("_m"))
    chunks = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(CHUNK).cast("long"))).alias("_from"))
    rows = chunks.select("_id", "_source", "_size", "_crc", F.least(F.col("_m") - F.col("_from"), F.lit(CHUNK)).alias("_w"), "_from",
                         _hash(F.lit(str(seed)), F.lit("row"), _text(F.col("_id")), F.col("_size").cast("string"), F.col("_crc").cast("string"),
                               F.col("_from").cast("string")).alias("_hash"))
    rows = written(rows, "rows")
    total = rows.agg(F.sum("_w")).first()[0] or 0
    buckets = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ROWS))

    # Places within the source: a bucket is a step of the hash. Joined at every size by the same shuffle.
    rows = rows.withColumn("_b", F.floor(F.col("_hash") * F.lit(buckets / 2.0 ** _BITS)).cast("long")).withColumn("_s", F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")))
    per_bucket = _before(rows.groupBy("_s", "_b").agg(F.sum("_w").alias("_n")), ["_s"], "_b", "_n").select("_s", "_b", "_ahead", F.sum("_n").over(Window.partitionBy("_s")).alias("_all"))
    inside = Window.partitionBy("_s", "_b").orderBy("_hash", F.col("_id").asc_nulls_first(), "_size", "_crc", "_from")
    ranked = rows.withColumn("_upto", F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(per_bucket.hint("merge"), ["_s", "_b"])
    copies = ranked.select("_id", "_source", "_s", "_size", "_crc", "_all", F.explode(F.sequence(
        F.col("_ahead") + F.col("_upto") - F.col("_w") + 1, F.col("_ahead") + F.col("_upto"))).alias("_rank"))
    start = (_hash(F.lit(str(seed)), F.lit("source"), "_s") % (1 << 20) + 0.5) / float(1 << 20)
    laid = copies.withColumn("_frac", (F.col("_rank") - start) / F.col("_all"))
    laid = written(laid.withColumn("_c", F.floor(F.col("_frac") * F.lit(float(buckets))).cast("long")).drop("_all"), "laid")

    # Places within the whole table: a bucket is a step of the fractional rank.
    ahead = _before(laid.groupBy("_c").agg(F.count("*").alias("_n")), [], "_c", "_n").select("_c", "_ahead")
    order = Window.partitionBy("_c").orderBy("_frac", "_s", "_rank")
    placed = laid.withColumn("_at", F.row_number().over(order)).join(ahead.hint("merge"), "_c").withColumn("_at", F.col("_ahead") + F.col("_at") - 1)
    shard = F.expr(f"(_at * {n_shards}) div {max(total, 1)}")
    first = F.expr(f"(_shard * {total} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("_shard", shard).select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                                                    F.col("_source").alias("source"), F.col("_shard").cast("int").alias("shard"), (F.col("_at") - first).alias("slot"))


def digest(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Shard and slot per document under the law `rows`: counts of shards differ by one at most."""
    return assign_shards(docs, n_shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                                F.lit(None).cast("int").alias("grown_shard"), "source")


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
c AS (SELECT doc_id, source, coalesce('=' || source, '') AS s, strlen(coalesce(text, '')) + 1 AS size, {crc_sql("coalesce(text, '')")} AS crc FROM documents, crc_table),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, crc) - 1 AS copy, (count(*) OVER (PARTITION BY doc_id, source, size, crc)) AS m FROM c),
h AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '{SEED}', 'row', coalesce(doc_id::VARCHAR, ''), size, crc, copy // {CHUNK} * {CHUNK})), 1, 12))::BIGINT AS hash FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY hash, doc_id NULLS FIRST, size, crc, copy) AS rank, count(*) OVER (PARTITION BY s) AS n FROM h),
f AS (SELECT *, (rank - ((('0x' || substr(md5('{SEED}|source|' || s), 1, 12))::BIGINT % {1 << 20}) + 0.5::DOUBLE) / {1 << 20}) / n AS frac FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY frac, s, rank) - 1 AS place, count(*) OVER () AS total FROM f)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (place * {SHARDS} // total)::INT AS shard,
       (place - ((place * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, source FROM p
"""
