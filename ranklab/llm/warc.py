"""WARC records of pages, and a fixity audit of their replicas by Merkle trees.

A leaf hashes one record together with its offset range; inner nodes hash up to `FANOUT` neighbours in offset order, so
an archive has one root. The audit compares roots, and only below nodes that differ compares children, down to records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ranklab.llm.common import written

#: Records of consecutive ids in one archive, and the children of an inner node.
ARCHIVE_RECORDS = 8_192
FANOUT = 16
#: Fewest levels above the leaves, so that trees of small archives compare with those of full ones.
LEAST_LEVELS = 4
WARC_DATE = "2020-01-01T00:00:00Z"
END = "\r\n\r\n"


def warc_record(page_id: Column, url: Column, html: Column, date: str = WARC_DATE) -> Column:
    """A resource record as text, without the two line ends behind it. Null parts are empty."""
    body = F.coalesce(html, F.lit(""))
    name = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid,
                    F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body)


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """(page_id, archive, record) of every row. Consecutive ids share an archive, so archives are bounded by design;
    rows with a null id go to archives by a hash."""
    page = F.col(id_col)
    archive = F.coalesce(F.format_string("pages-%08d", F.floor(page / archive_records)),
                         F.format_string("pages-none-%08d", F.pmod(F.xxhash64(url_col, html_col), F.lit(4096))))
    return pages.select(page.alias("page_id"), archive.alias("archive"), warc_record(page, F.col(url_col), F.col(html_col)).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """One gzipped WARC file per archive below `path`, records by page id; written by Spark, so any file system will do."""
    (records.repartition("archive").sortWithinPartitions("archive", "page_id", "record").select("archive", "record")
     .write.partitionBy("archive").option("lineSep", END).option("compression", "gzip").text(path))


def record_spans(content: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of the records in a file, by their Content-Length; without one, a record goes on to the end."""
    at = 0
    while at < len(content):
        head = content.find(END.encode(), at)
        sizes = [line.partition(b":")[2] for line in content[at:max(head, at)].split(b"\r\n") if line[:15].lower() == b"content-length:"]
        known = head >= 0 and sizes and sizes[0].strip().isdigit()
        end = min(len(content), head + len(END) + int(sizes[0])) if known else len(content)
        yield at, end
        at = end + len(END)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, length, record) of all records below `path`, by their Content-Length. One file is one row of its
    reader, so files are bounded by the writer's archive size. A file cut short ends with the bytes that are there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(path)
    name = F.regexp_extract("path", "archive=([^/]*)/", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = list(record_spans(content := zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else content))
                for low in range(0, len(spans), 1024):
                    some = spans[low:low + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array([archive] * len(some), pa.string()), pa.array([a for a, _ in some], pa.int64()), pa.array(
                        [b - a for a, b in some], pa.int64()), pa.array([content[a:b] for a, b in some], pa.binary())], names=["archive", "offset", "length", "record"])

    return files.select(name.alias("archive"), "content").mapInArrow(run, "archive string, offset long, length long, record binary")


def leaves(records: DataFrame) -> DataFrame:
    """Manifest of `records` (page_id, archive, record): (archive, ordinal, page_id, offset, length, sha, digest). Hashes
    are made where the records are; only they are shuffled. Within an archive records stand by page id; equal ids by
    their hash, and equal rows one after the other."""
    from pyspark.sql import Window

    light = records.select("page_id", "archive", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("sha"))
    order = Window.partitionBy("archive").orderBy("page_id", "sha")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = light.select("archive", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "page_id",
                          F.coalesce(F.sum(F.col("length") + len(END)).over(before), F.lit(0)).cast("long").alias("offset"), "length", "sha")
    return placed.withColumn("digest", leaf_digest(F.col("offset"), F.col("length"), F.col("sha")))


def leaf_digest(offset: Column, length: Column, sha: Column) -> Column:
    return F.sha2(F.concat_ws(":", offset.cast("string"), length.cast("string"), sha).cast("binary"), 256)


def merkle_levels(leaf_rows: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes (archive, node, digest) of every level, leaves first; a node hashes the digests of its children in order.
    Levels are written, each from the one below, so none is made twice."""
    out = [leaf_rows.select("archive", F.col("ordinal").alias("node"), "digest")]
    for _ in range(levels):
        children = out[-1].groupBy("archive", F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(
            F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("children"))
        out.append(written(children.select("archive", "node", F.sha2(F.array_join("children.digest", "").cast("binary"), 256).alias("digest")), "nodes"))
    return out


def levels_for(leaf_rows: DataFrame, fanout: int = FANOUT) -> int:
    most = leaf_rows.agg(F.max("ordinal")).first()[0] or 0
    levels = LEAST_LEVELS
    while fanout ** levels <= most:
        levels += 1
    return levels


def audit(manifest: list[DataFrame], replica: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Records that differ, as (archive, ordinal): roots are compared first, and below the nodes that differ their
    children, level by level. A record that one side lacks differs."""
    suspect = None
    for mine, theirs in zip(reversed(manifest), reversed(replica)):
        sides = [mine, theirs]
        if suspect is not None:
            parent = F.floor(F.col("node") / fanout).cast("long")
            sides = [s.withColumn("parent", parent).join(suspect.withColumnRenamed("node", "parent"), ["archive", "parent"], "left_semi").drop("parent") for s in sides]
        other = sides[1].withColumnRenamed("digest", "_theirs")
        suspect = written(sides[0].join(other, ["archive", "node"], "full").filter(~F.col("digest").eqNullSafe(F.col("_theirs"))).select("archive", "node"), "suspects")
    return suspect.withColumnRenamed("node", "ordinal")


def audit_records(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Every record of the manifest of `records` with the state of its copy: (page_id, archive, ordinal, offset, length,
    record_sha256, archive_root, status: `ok`, `corrupt` or `missing`).

    `stored` is (archive, offset, length, record): what a replica holds, at the offsets of the manifest; the ordinal of a
    stored record is that of the manifest's record at its offset, and stored bytes at other offsets count as nothing.
    Empty tables give an empty audit.
    """
    mine = written(leaves(records), "manifest")
    theirs = stored.select("archive", "offset", F.col("length").alias("_l"), F.sha2(F.col("record").cast("binary"), 256).alias("_s"))
    theirs = written(mine.select("archive", "ordinal", "offset").join(theirs, ["archive", "offset"])
                     .select("archive", "ordinal", leaf_digest(F.col("offset"), F.col("_l"), F.col("_s")).alias("digest")), "replica")
    levels = levels_for(mine)
    tree, other = merkle_levels(mine, levels), merkle_levels(theirs, levels)
    bad = audit(tree, other).withColumn("_bad", F.lit(True))
    present = theirs.select("archive", "ordinal", F.lit(True).alias("_there"))
    state = bad.join(present, ["archive", "ordinal"], "left").select(
        "archive", "ordinal", F.when(F.col("_there"), "corrupt").otherwise("missing").alias("status"))
    roots = tree[-1].select("archive", F.col("digest").alias("archive_root"))
    return (mine.join(roots, "archive").join(state, ["archive", "ordinal"], "left")
            .select("page_id", "archive", "ordinal", "offset", "length", F.col("sha").alias("record_sha256"), "archive_root", F.coalesce("status", F.lit("ok")).alias("status")))


def _oracle() -> str:
    """The same in SQL, for tables with at least one page and archives of at most FANOUT ** LEAST_LEVELS records."""
    tree = ""
    for level in range(1, LEAST_LEVELS + 1):
        tree += f""",
n{level} AS (SELECT archive, node // {FANOUT} AS node, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM n{level - 1} GROUP BY ALL)"""
    return f"""
WITH p AS (SELECT page_id, format('pages-{{:08d}}', page_id // {ARCHIVE_RECORDS}) AS archive, coalesce(html, '') AS body, coalesce(url, '') AS url,
             md5(page_id || '|' || coalesce(url, '')) AS name FROM pages),
r AS (SELECT page_id, archive, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' ||
        name[1:8] || '-' || name[9:12] || '-' || name[13:16] || '-' || name[17:20] || '-' || name[21:32] || '>' || chr(13) || chr(10) ||
        'WARC-Date: {WARC_DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) ||
        'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body AS record FROM p),
l AS (SELECT page_id, archive, row_number() OVER w - 1 AS ordinal, strlen(record)::BIGINT AS length, sha256(record) AS sha,
        coalesce(sum(strlen(record) + 4) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
        sha256('warc' || substr(record, 5)) AS damaged FROM r WINDOW w AS (PARTITION BY archive ORDER BY page_id)),
n0 AS (SELECT archive, ordinal AS node, sha256(start || ':' || length || ':' || sha) AS digest FROM l){tree}
SELECT page_id, l.archive, ordinal, start AS "offset", length, sha AS record_sha256, digest AS archive_root,
       CASE WHEN hit THEN 'corrupt' ELSE 'ok' END AS status
FROM l JOIN n{LEAST_LEVELS} t ON t.archive = l.archive JOIN (SELECT page_id, ('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT % 97 = 0 AS hit FROM p) h USING (page_id)
"""


ORACLE = _oracle()
