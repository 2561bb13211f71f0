"""Label and query streams: late records, replays, compaction and renewed tables."""

import os

import pytest

from ranklab.operators.new_query import rank_new_queries
from ranklab.streaming import judgments as sj, new_queries as nq, versions

LOG = "seq bigint, query_id bigint, doc_id bigint, status string, grade int"


def labels(spark, path, rule="last"):
    return {(r.query_id, r.doc_id): r.grade for r in sj.read_labels(spark, path, rule).collect()}


def files(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


@pytest.mark.parametrize("rule,want", [("last", {(1, 1): 3, (2, 2): 2, (3, 3): 0}), ("first", {(1, 1): 0, (2, 2): 2, (3, 3): 0})])
def test_batches_late_records_replay_and_compaction(spark, tmp_path, rule, want):
    path = str(tmp_path / "labels")
    batch = lambda *rows: spark.createDataFrame(rows, LOG)
    assert labels(spark, path, rule) == {}
    one = batch((10, 1, 1, "ok", 1), (11, 2, 2, "ok", 2), (12, 9, 9, "error", None))
    sj.upsert(one, 0, path, rule, 4)
    sj.upsert(batch((20, 1, 1, "ok", 3)), 1, path, rule, 4)
    sj.upsert(one, 0, path, rule, 4)                                          # replays of finished batches
    sj.upsert(batch((99, 1, 1, "ok", 2)), 1, path, rule, 4)
    sj.compact(spark, path, 2)
    opened = sj.read_labels(spark, path, rule)                                # a reader that has begun
    sj.upsert(batch((5, 1, 1, "ok", 0), (21, 3, 3, "ok", 0)), 2, path, rule)  # a late record
    assert labels(spark, path, rule) == want and opened.count() == 2
    assert versions.manifest(spark, path)["n"] == 2
    with pytest.raises(ValueError, match="rule"):
        sj.read_labels(spark, path, "first" if rule == "last" else "last")


def test_files_do_not_grow_with_batches(spark, tmp_path):
    path = str(tmp_path / "labels")
    for b in range(7):
        sj.upsert(spark.createDataFrame([(b * 10 + i, i, i, "ok", b % 4) for i in range(6)], LOG), b, path, "last", 3)
    assert len(labels(spark, path)) == 6 and set(labels(spark, path).values()) == {2}
    assert files(path) <= 2 * 3 and len(os.listdir(tmp_path / "labels" / "data")) <= 2


def test_a_batch_that_died_is_written_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "labels")
    row = lambda seq, grade: spark.createDataFrame([(seq, 1, 1, "ok", grade)], LOG)
    sj.upsert(row(1, 1), 0, path)
    monkeypatch.setattr(versions, "switch", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sj.upsert(row(2, 2), 1, path)
    assert labels(spark, path) == {(1, 1): 1}
    monkeypatch.undo()
    sj.upsert(row(2, 2), 1, path)
    assert labels(spark, path) == {(1, 1): 2}


def test_new_queries_take_the_newest_tables(spark, tmp_path):
    tags = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "tag_id bigint, vec array<double>")
    stats = spark.createDataFrame([(1, 0.1, 1.0), (2, 0.2, 1.0)], "tag_id bigint, mean double, sd double")
    doc_tags = spark.createDataFrame([(5, 1, 1.0), (6, 2, 1.0)], "doc_id bigint, tag_id bigint, score double")
    docs = spark.createDataFrame([(5,), (6,), (7,)], "doc_id bigint")
    tables, inbox, out, ckpt = (str(tmp_path / n) for n in ("tables", "inbox", "out", "ckpt"))
    with pytest.raises(FileNotFoundError):
        nq.published(spark, tables)
    with pytest.raises(Exception, match="another tag list"):
        nq.publish(tables, tags, stats.where("tag_id = 1"), doc_tags, docs)

    def run(*rows):
        spark.createDataFrame(rows, "query_id bigint, vec array<double>").coalesce(1).write.mode("append").parquet(inbox)
        nq.new_query_stream(spark.readStream.schema("query_id bigint, vec array<double>").parquet(inbox), tables, out, ckpt, True, m=1).awaitTermination()
        return {(r.query_id, r.doc_id, r.version) for r in spark.read.parquet(out).collect()}

    assert nq.publish(tables, tags, stats, doc_tags, docs) == 0
    first = run((1, [0.9, 0.1]))
    assert first == {(1, 5, 0)}
    nq.publish(tables, tags, None, doc_tags.withColumn("doc_id", doc_tags.doc_id + 1), docs)
    assert run((2, [0.9, 0.1])) == first | {(2, 6, 1)}
    query = spark.createDataFrame([(2, [0.9, 0.1])], "query_id bigint, vec array<double>")
    _, held = nq.published(spark, tables)
    assert [r.doc_id for r in rank_new_queries(query, held["tags"], held["stats"], held["doc_tags"], held["docs"], m=1).collect()] == [6]
