"""The log's sequence: appends to any file, copies, new names, touches and other splits leave every answer as it was."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from ranklab.operators.labels import first_ok, latest_ok_grade, merge_labels_first_wins, run_stats
from ranklab.sources import judgment_log
from ranklab.sources.readers import read_judgment_log


def line(q, d, grade, stamp=None, status="ok"):
    return json.dumps({"hire_id": str(q), "provider_id": str(d), "status": status, "grade": grade} | ({"timestamp": stamp} if stamp else {})) + "\n"


def put(path, text, mode="a", when=None):
    with open(path, mode, encoding="utf-8") as out:
        out.write(text)
    if when:
        os.utime(path, (when, when))


def grades(spark, path):
    return {(r.query_id, r.doc_id): r.grade for r in latest_ok_grade(read_judgment_log(spark, str(path))).collect()}


def sequence(spark, path):
    return [(r.query_id, r.doc_id, r.grade) for r in read_judgment_log(spark, str(path)).orderBy("seq").collect()]


def test_append_to_an_older_file(spark, tmp_path):
    put(tmp_path / "z.jsonl", line(1, 2, 0), when=1_000_000)
    put(tmp_path / "b.jsonl", line(1, 2, 1), when=2_000_000)
    assert grades(spark, tmp_path) == {(1, 2): 1}
    put(tmp_path / "z.jsonl", line(5, 6, 3))
    assert grades(spark, tmp_path) == {(1, 2): 1, (5, 6): 3}
    assert first_ok(read_judgment_log(spark, str(tmp_path)), "grade").where("query_id = 1").first().grade == 0
    assert sequence(spark, tmp_path) == [(1, 2, 0), (1, 2, 1), (5, 6, 3)]


def test_three_files_in_any_state(spark, tmp_path):
    log = tmp_path / "log"
    (log / "part").mkdir(parents=True)
    put(log / "a b.jsonl", line(1, 1, 0, "t1") + "\n" + line(1, 1, None, "t2", "error"), when=3_000)
    put(log / "part" / "c.jsonl", line(1, 1, 2, "t3") + line(2, 1, 1, "t4"), when=2_000)
    put(log / "empty.jsonl", "")
    want = sequence(spark, log)
    assert want == [(1, 1, 0), (1, 1, None), (1, 1, 2), (2, 1, 1)]
    base = spark.createDataFrame([(2, 1, 3)], "query_id bigint, doc_id bigint, grade int")
    pairs = spark.createDataFrame([(1, 1), (2, 1), (9, 9)], "query_id bigint, doc_id bigint")

    def answers(path):
        rows = read_judgment_log(spark, str(path))
        merged = {(r.query_id, r.doc_id): r.grade for r in merge_labels_first_wins(base, rows).collect()}
        return grades(spark, path), merged, run_stats(pairs, rows, rows).first()

    first = answers(log)
    assert first[0] == {(1, 1): 2, (2, 1): 1} and first[1] == {(1, 1): 0, (2, 1): 3} and (first[2].graded, first[2].errors) == (3, 1)
    os.utime(log / "a b.jsonl")                                               # touched
    assert sequence(spark, log) == want
    shutil.copy(log / "a b.jsonl", log / "0-copy.jsonl")                      # copied beside itself
    os.rename(log / "part" / "c.jsonl", log / "renamed.jsonl")
    assert answers(log) == first
    shutil.copytree(log, tmp_path / "elsewhere")                              # all file times new
    assert sequence(spark, tmp_path / "elsewhere") == want
    put(log / "0-copy.jsonl", line(1, 1, 1, "t5"))                            # the copy goes on by itself
    assert sequence(spark, log) == want + [(1, 1, 1)] and grades(spark, log)[1, 1] == 1


def test_splits_do_not_matter(spark, tmp_path):
    rows = [(q, d, (q + d) % 4) for q in range(12) for d in range(10)]
    text = "".join(line(*r, f"{k:06}") for k, r in enumerate(rows))
    put(tmp_path / "a.jsonl", text)
    shutil.copytree(tmp_path, tmp_path / "other")
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        assert sequence(spark, tmp_path / "a.jsonl") == rows
        put(tmp_path / "a.jsonl", line(77, 77, 3, "999999"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1777")
        assert sequence(spark, tmp_path / "a.jsonl") == rows + [(77, 77, 3)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    assert sequence(spark, tmp_path / "other") == rows


def test_unfinished_lines_and_changed_lines(spark, tmp_path):
    put(tmp_path / "a.jsonl", line(1, 1, 0, "t1") + '{"hire_id": "2", "prov')
    assert sequence(spark, tmp_path) == [(1, 1, 0)]
    put(tmp_path / "a.jsonl", 'ider_id": "2", "status": "ok", "grade": 1}\n' + "no record\n" + line(3, 3, 2))
    assert sequence(spark, tmp_path) == [(1, 1, 0), (2, 2, 1), (3, 3, 2)]
    put(tmp_path / "b.jsonl", "")
    assert judgment_log.register(spark, str(tmp_path)) == judgment_log.register(spark, str(tmp_path)) == 4
    put(tmp_path / "a.jsonl", line(1, 1, 3, "t1"), mode="w")
    with pytest.raises(ValueError, match="only grows"):
        read_judgment_log(spark, str(tmp_path))
    assert read_judgment_log(spark, str(tmp_path), register=False).count() == 3


def test_a_run_that_died_is_written_anew(spark, tmp_path):
    put(tmp_path / "a.jsonl", line(1, 1, 0))
    assert len(sequence(spark, tmp_path)) == 1
    put(tmp_path / "b.jsonl", line(1, 1, 1))
    assert len(sequence(spark, tmp_path)) == 2
    os.remove(tmp_path / "_ledger" / "files" / "run=1" / "_SUCCESS")         # as if the job had been lost there
    assert read_judgment_log(spark, str(tmp_path), register=False).count() == 1
    assert sequence(spark, tmp_path) == [(1, 1, 0), (1, 1, 1)]


def test_equal_records_without_time_are_new_ones(spark, tmp_path):
    for name, grade in (("a", 0), ("b", 1), ("c", 0)):
        put(tmp_path / f"{name}.jsonl", line(1, 1, grade))
        assert grades(spark, tmp_path) == {(1, 1): grade}
    assert read_judgment_log(spark, str(tmp_path / "none")).count() == 0
    assert read_judgment_log(spark, str(tmp_path)).where(F.col("seq").isNull()).count() == 0
