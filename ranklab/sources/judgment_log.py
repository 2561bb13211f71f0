"""The append-only judgment log with a sequence that lasts.

File times tell nothing about the order of records once an older file is appended to, copied or touched. The log's
folder therefore keeps a ledger: the first time a line is seen it gets the next free number, and the parsed record is
stored under that number. Later reads take stored records as they are and parse only lines that are new.

    <log>/_ledger/records/run=<k>   new records of registration k, Parquet
    <log>/_ledger/files/run=<k>     per file what is registered so far; written last, so a run counts once this is there

Names beginning with an underscore are invisible to the log itself. One registration runs at a time; one that dies leaves
at most a records folder without its files folder, which the next registration writes anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ranklab.session import checkpoint
from ranklab.sources import schemas

FIELDS = [c.strip().split(" ")[0] for c in schemas.JUDGMENTS.replace("STRUCT<prompt_tokens: INT, completion_tokens: INT>", "USAGE").split(",")]
RECORD = f"file STRING, line BIGINT, seq BIGINT, query_id BIGINT, doc_id BIGINT, {schemas.JUDGMENTS}"
FILES = "file STRING, lines BIGINT, digest DECIMAL(38,0), size BIGINT, modified TIMESTAMP, stamped BOOLEAN, next_seq BIGINT"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(target)


def _root(spark: SparkSession, path: str) -> tuple[str | None, str, str]:
    """(the path or None if there is nothing, the folder that names are relative to, the ledger's folder)."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None, "", ""
    if fs.getFileStatus(target).isDirectory():
        return str(target.toString()), target.toUri().getRawPath(), f"{target.toString()}/_ledger"
    return str(target.toString()), target.getParent().toUri().getRawPath(), f"{target.getParent().toString()}/_ledger-{target.getName()}"


def _runs(spark: SparkSession, ledger: str) -> list[int]:
    """Registrations that were finished."""
    fs, folder = _fs(spark, f"{ledger}/files")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [n for n in names if n.startswith("run=") and fs.exists(_fs(spark, f"{ledger}/files/{n}/_SUCCESS")[1])]
    return sorted(int(n.removeprefix("run=")) for n in done)


def _known(spark: SparkSession, ledger: str, runs: list[int]) -> DataFrame:
    """The newest entry of every file."""
    if not runs:
        return spark.createDataFrame([], FILES)
    entries = spark.read.schema(FILES + ", run INT").option("basePath", f"{ledger}/files").parquet(*[f"{ledger}/files/run={k}" for k in runs])
    newest = entries.groupBy("file").agg(F.max_by(F.struct(*[c for c in entries.columns if c not in ("file", "run")]), "run").alias("e"))
    return newest.select("file", "e.*")


def _relative(uri, root: str):
    """A file's name below the log's folder, whatever scheme or host stands before it."""
    return F.substring(F.regexp_replace(uri, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit(len(root.rstrip("/")) + 2), F.lit(1 << 20))


def _numbered(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """(file, line, value, digest): lines of files numbered from 0, blank ones too, and the sum of the hashes of all lines
    up to and with this one. Lines are counted inside the splits of a file and the totals of the splits before are added, so
    numbers do not depend on where the splits are and no task sees a whole file."""
    raw = spark.read.text(paths).select(_relative(F.col("_metadata.file_path"), root).alias("file"), F.col("_metadata.file_block_start").alias("split"),
                                        F.monotonically_increasing_id().alias("at"), "value")
    raw = checkpoint(raw)
    raw = raw.withColumn("hash", F.xxhash64("value").cast("decimal(38,0)"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    totals = raw.groupBy("file", "split").agg(F.count("*").alias("n"), F.sum("hash").alias("h")).select("file", "split", ahead("n").alias("lines"), ahead("h").alias("hashes"))
    within = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lined = raw.select("file", "split", "value", F.row_number().over(within).alias("k"), F.sum("hash").over(within).alias("inside")).join(totals, ["file", "split"])
    return lined.select("file", (F.col("lines") + F.col("k") - 1).alias("line"), "value", (F.col("hashes") + F.col("inside")).cast("decimal(38,0)").alias("digest"))


def register(spark: SparkSession, path: str, ledger: str | None = None) -> int:
    """Give numbers to the lines of the log not seen before, and return the next free number.

    Only files whose size or time has changed are read. Registered lines must still be there as they were, else it is an
    error: the log only grows. A new file that begins with all registered lines of another is a copy or a new name of
    that one; these lines keep their numbers and do not count twice (only for records with timestamps: others may be
    alike by right). Several new files are taken by their first record's timestamp, then file time, then name. A last line
    that is no complete record yet is left for the next time.
    """
    found, root, own = _root(spark, path)
    if found is None:
        return 0
    ledger = ledger or own
    runs = _runs(spark, ledger)
    known = checkpoint(_known(spark, ledger, runs))
    first_free = known.agg(F.max("next_seq")).first()[0] or 0
    # Hidden files, the ledger among them, are not listed.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(found)
    listed = listed.select(F.col("path").alias("uri"), _relative(F.col("_metadata.file_path"), root).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    old = known.select("file", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.col("lines").alias("old_lines"), F.col("digest").alias("old_digest"))
    todo = checkpoint(listed.join(old, "file", "left").filter("size > 0 AND (old_size IS NULL OR size <> old_size OR modified <> old_modified)"))
    paths = [r.uri for r in todo.select("uri").collect()]  # file names, as the scan itself lists them
    if not paths:
        return first_free

    parsed = F.from_json("value", schemas.JUDGMENTS + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    lines = _numbered(spark, paths, root).withColumn("r", parsed).withColumn("whole", F.col("r").isNotNull() & F.col("r._bad").isNull() | (F.trim("value") == ""))
    last = lines.groupBy("file").agg(F.max("line").alias("last"))
    lines = checkpoint(lines.join(last, "file").filter("whole OR line < last"))
    state = todo.select("file", "size", "modified", "old_lines", "old_digest")

    then = state.filter("old_lines > 0").join(lines.select("file", (F.col("line") + 1).alias("old_lines"), F.col("digest").alias("now")), ["file", "old_lines"], "left")
    broken = then.filter("now IS NULL OR now <> old_digest").select("file").limit(5).collect()
    if broken:
        raise ValueError(f"the log only grows, but registered lines have changed in {sorted(r.file for r in broken)}")

    # A new file that begins like a registered one starts behind those lines; the longest such beginning counts.
    same = (lines.join(state.filter("old_lines IS NULL").select("file"), "file").select(F.col("file").alias("new"), (F.col("line") + 1).alias("lines"), "digest")
            .join(known.filter("stamped AND lines > 0").select("lines", "digest").distinct(), ["lines", "digest"]).groupBy("new").agg(F.max("lines").alias("shared")))
    state = checkpoint(state.join(same.withColumnRenamed("new", "file"), "file", "left").withColumn("start", F.coalesce("old_lines", "shared", F.lit(0))))
    fresh = lines.join(state.select("file", "start", "modified"), "file").filter("line >= start")
    per_file = fresh.groupBy("file").agg(F.count("*").alias("n"), F.min_by("r.timestamp", "line").alias("stamp"), F.min("modified").alias("m"))
    order = Window.orderBy("stamp", "m", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = checkpoint(per_file.withColumn("base", F.lit(first_free) + F.coalesce(F.sum("n").over(order), F.lit(0))).select("file", "n", "base"))
    records = fresh.join(placed, "file").filter("r.hire_id IS NOT NULL").select(
        "file", "line", (F.col("base") + F.col("line") - F.col("start")).alias("seq"), F.col("r.hire_id").cast("bigint").alias("query_id"),
        F.col("r.provider_id").cast("bigint").alias("doc_id"), *[F.col(f"r.{c}").alias(c) for c in FIELDS])
    run = (runs[-1] if runs else -1) + 1
    records.write.mode("overwrite").parquet(f"{ledger}/records/run={run}")

    stamped = lines.filter("r.hire_id IS NOT NULL").groupBy("file").agg(F.bool_and(F.col("r.timestamp").isNotNull()).alias("stamped"))
    ends = lines.groupBy("file").agg((F.max("line") + 1).alias("lines"), F.max_by("digest", "line").alias("digest"))
    next_seq = first_free + (placed.agg(F.sum("n")).first()[0] or 0)
    entries = state.select("file", "size", "modified", "old_lines").join(ends, "file", "left").join(stamped, "file", "left").select(
        "file", F.coalesce("lines", "old_lines", F.lit(0)).cast("bigint").alias("lines"), F.coalesce("digest", F.lit(0)).cast("decimal(38,0)").alias("digest"),
        "size", "modified", F.coalesce("stamped", F.lit(False)).alias("stamped"), F.lit(next_seq).cast("bigint").alias("next_seq"))
    entries.write.mode("overwrite").parquet(f"{ledger}/files/run={run}")
    return next_seq


def registered(spark: SparkSession, path: str, ledger: str | None = None) -> DataFrame:
    """(seq, query_id, doc_id, the other fields) of all registered records; a log that is not there is empty."""
    found, _, own = _root(spark, path)
    runs = _runs(spark, ledger or own) if found else []
    rows = spark.read.schema(RECORD).parquet(*[f"{ledger or own}/records/run={k}" for k in runs]) if runs else spark.createDataFrame([], RECORD)
    return rows.select("seq", "query_id", "doc_id", *[c for c in FIELDS if c not in ("hire_id", "provider_id")])
