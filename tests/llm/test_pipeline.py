"""The pipeline against a run of its steps in plain Python."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from ranklab.llm import bpe, langid
from ranklab.llm.catalog import VOCABULARY
from tests.llm.test_texts import brute_components, brute_lines, brute_passages, brute_print

SOUNDS = {"aa": ["tha", "ing", "ed", "ou"], "bb": ["sch", "ung", "ei", "öß"]}


def corpus():
    rng = random.Random(12)

    def words(lang, n):
        return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(3)) for _ in range(n))

    rows = []
    for i in range(160):
        lang = rng.choice("ab") * 2
        rows.append([i, "\n".join(words(lang, rng.randint(5, 40)) for _ in range(rng.randint(1, 6))), lang, "s", 0])
    items = [(i, words("aa", 30)) for i in range(3)]
    shared = "\n".join(words("aa", 15) for _ in range(6))
    for i in (20, 40, 60, 61):
        rows[i][1] += "\n" + shared
    rows += [[200, rows[5][1], "aa", "s", 0], [201, rows[5][1] + " more", "aa", "s", 0], [202, rows[7][1].replace("\n", " "), "aa", "s", 0], [203, None, "aa", "s", 0], [204, "12 -- 34", None, "s", 0],
             [205, "你好 世界 " * 40, None, "s", 0], [206, "thaing " + items[1][1] + " ingou", "aa", "s", 0], [207, words("bb", 900) + " " + items[1][1], "bb", "s", 0], [208, "", "bb", "s", 0]]
    return [tuple(r) for r in rows], items


def test_stages_are_registered_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()
    ours = sorted(int(name[2:].split("_")[0]) for name in __spark_entry__.queries() if name.startswith("op"))
    assert ours == list(range(1, 14))


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rejected = langid.fit(docs).predict([r[1] for r in rows])[2]
    kept = [(r[0], r[1]) for r, bad in zip(rows, rejected) if not bad]
    assert {203, 204, 205, 208}.isdisjoint({i for i, _ in kept}) and len(kept) == len(rows) - 4
    cut = brute_lines(kept)
    left = {i: cut[True, i, t] for i, t in kept if cut[True, i, t] or not t}
    assert sum(map(len, left.values())) < sum(len(t) for _, t in kept)
    component = brute_components({i: brute_print(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if component[i] == i}
    assert 201 not in left or component[201] == 201
    for i, text in list(left.items()):
        n, hit, _ = brute_passages(text, items)
        if hit and 20 * hit >= n:
            del left[i]
    assert 206 not in left and 207 in left
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(VOCABULARY)), special_tokens={})
    want = {i: np.array(tik.encode_ordinary(t), "<u4").tobytes() for i, t in left.items()}
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in got.items()} == {
        i: (len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(left[i].encode()).hexdigest()) for i, x in want.items()}


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows[:6], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        if name != "byte_bpe":
            assert empty.dtypes == docs.dtypes, name
    lines = corpus_pipeline.remove_repeated_lines(spark, docs, str(tmp_path)).collect()
    assert all(r.n_chars == len(r.text) for r in lines)
