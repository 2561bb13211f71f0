"""Sharding, fill-in-the-middle and spelling variants against plain Python, with nulls, empty and long texts, ties,
repeated rows, empty tables and columns whose names clash."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from ranklab.llm import fill_middle, sharding, spelling

SCHEMA = "doc_id long, text string, source string, _id string, _m int, word string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 3, "y", 4) for i, t, s in rows], SCHEMA)


def shard_rows():
    rng = random.Random(3)
    rows = [(i, "t" * rng.randint(0, 9), "hot") for i in range(700)]
    rows += [(1000 + i, f"é{i}", rng.choice(["a", "b", None, ""])) for i in range(500)]
    rows += [(5000 + i, "one of its source", f"s{i}") for i in range(160)]
    rows += [(None, None, "a"), (None, "", "a"), (9, None, None)] + [(8, "a copy", "b")] * 300
    return rows


def test_shards_hold_the_mixture(spark):
    rows = shard_rows()
    got = sharding.assign_shards(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.source) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s) for i, t, s in rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k])) for k in sizes)
    for source, n in Counter(s for _, _, s in rows).items():
        here = Counter(r.shard for r in got if r.source == source)
        if n > 50:
            assert all(abs(here[k] - n / 16) <= 0.1 * n / 16 + 3 for k in range(16)), source
    single = Counter(r.shard for r in got if r.source and r.source.startswith("s"))
    assert len(single) == 16 and max(single.values()) < 40


def brute_shards(rows, seed=7, shards=16, chunk=sharding.CHUNK):
    def number(*parts):
        return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:12], 16)

    kinds, by_source = Counter(), {}
    for i, t, s in rows:
        body = (t or "").encode()
        row = (i, len(body) + 1, zlib.crc32(body), s)
        part = kinds[row] // chunk * chunk
        kinds[row] += 1
        key = (number(str(seed), "row", "" if i is None else str(i), str(row[1]), str(row[2]), str(part)), i is not None, i or 0, row[1], row[2])
        by_source.setdefault("" if s is None else "=" + s, []).append((key, row))
    laid = []
    for s, members in by_source.items():
        u = (number(str(seed), "source", s) % (1 << 20) + 0.5) / (1 << 20)
        laid += [((r - u) / len(members), s, r, row) for r, (_, row) in enumerate(sorted(members, key=lambda m: m[0]), 1)]
    total, out, slots = len(laid), Counter(), Counter()
    for place, (*_, row) in enumerate(sorted(laid, key=lambda x: x[:3])):
        k = place * shards // total
        out[(*row, k, slots[k])] += 1
        slots[k] += 1
    return out


def test_shards_equal_a_plain_sort(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    monkeypatch.setattr(sharding, "CHUNK", 7)
    rows = shard_rows()
    got = Counter((r.doc_id, r["size"], r.text_crc32, r.source, r.shard, r.slot) for r in sharding.assign_shards(docs(spark, rows)).collect())
    assert got == brute_shards(rows, chunk=7)
    few = [(1, "x", "a"), (2, "y", None), (3, None, "a")]
    assert sorted(r.shard for r in sharding.assign_shards(docs(spark, few)).collect()) == [0, 5, 10]
    assert {r.shard for r in sharding.assign_shards(docs(spark, rows), n_shards=3).collect()} == {0, 1, 2}
    empty = sharding.digest(docs(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source"]


def test_shards_do_not_depend_on_partitions(spark):
    table = docs(spark, shard_rows())
    one, other = (sorted(map(str, sharding.digest(t).collect())) for t in (table.coalesce(1), table.repartition(13)))
    assert one == other


def brute_fim(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_texts():
    rng = random.Random(4)
    texts = [None, "", "\n", "\n\n\n", "one line", "ends\n", "has <S> inside\nso plain", "<", "<P\n>", "S>\n<M", "é\n🙂🙂\nü", "x\n" * 40_000, "long" * 50_000, "\r\n a\x85b c\n"]
    texts += ["".join(rng.choice(["\n", "ab ", "<", "P>", "é", "<M"]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    return texts + texts[-2:]


def test_fill_middle_equals_brute_force(spark):
    rows = list(enumerate(fim_texts())) + [(None, "a\nb\nc"), (3, "again\nunder\none id")]
    made = fill_middle.fill_in_middle(docs(spark, [(i, t, "s") for i, t in rows]))
    want = Counter((i, *brute_fim(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()) == want
    assert {f for _, _, f, *_ in want} == set(fill_middle.FORMS)
    assert Counter((r.doc_id, r.text) for r in fill_middle.restored(made).collect()) == Counter((i, t or "") for i, t in rows)
    shown = fill_middle.digest(docs(spark, [(7, "a\nb\nc\n", "s"), (8, None, "s")])).orderBy("doc_id").collect()
    assert shown[0].output_sha256 == hashlib.sha256(brute_fim(7, "a\nb\nc\n")[-1].encode()).hexdigest()
    assert shown[0].restored_sha256 == hashlib.sha256(b"a\nb\nc\n").hexdigest() and shown[1].output_sha256 == hashlib.sha256(b"").hexdigest()
    assert fill_middle.digest(docs(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM\nab é", max_size=40), st.integers(0, 10 ** 6), st.sampled_from([(100, 0), (100, 100), (50, 50)]))
def test_rotations_come_back(text, doc_id, rates):
    recipe = fill_middle.Recipe(*rates)
    raw = text.encode()
    cut = fill_middle.plan(raw, doc_id, recipe)
    assert fill_middle.restore(bytes(fill_middle.transform(raw, cut, recipe)), cut.form, recipe) == raw


def test_rotate_and_bad_sentinels():
    buffer = bytearray(b"0aaabb9")
    assert fill_middle.rotate(buffer, 1, 4, 6) == 3 and buffer == b"0bbaaa9"
    for marks in ((b"<P>", b"<P>", b"<M>"), (b"", b"<S>", b"<M>"), (b"ab", b"cab", b"<M>"), (b"ab", b"ba", b"<M>"), (b"aa", b"b", b"c")):
        with pytest.raises(ValueError):
            fill_middle.Recipe(prefix=marks[0], suffix=marks[1], middle=marks[2])
    with pytest.raises(ValueError):
        fill_middle.restore(b"<P>a<M>b<S>c", "psm", fill_middle.Recipe())


def brute_words(rows, typo=97, letters=5, times=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % typo else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= times}


def brute_variants(words, ratio=2):
    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if spelling.one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    rows = set()
    for w, (n, k, form, m) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.add((w, form, root, n, k, m))
    return rows


def naive_edit(a, b):
    letters = set(a) | set(b)
    made = {a[:i] + a[i + 1:] for i in range(len(a))} | {a[:i] + c + a[i + k:] for i in range(len(a) + 1) for c in letters for k in (0, 1)}
    return b in made and a != b


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé", max_size=6), st.text(alphabet="abé", max_size=6))
def test_one_edit(a, b):
    assert spelling.one_edit(a, b) == spelling.one_edit(b, a) == naive_edit(a, b)


def word_texts():
    rng = random.Random(8)
    base = ["colour", "letters", "grüßen", "À" + "bcdé", "aaaaa", "aaaaaa", "abcabc", "wörter", "x" * 300, "x" * 299 + "y", "x" * 301]
    rows = [(None, "null id letters Letters LETTERS"), (1, None), (1, ""), (2, "... 12 345"), (3, "×÷×÷× ×÷×÷× ×÷×÷× ÀÉÎÕÜ àéîõü"), (4, "colour " * 3_000)]
    for i in range(150):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            at = rng.randrange(len(w))
            words.append(rng.choice([w, w, w, w[:at] + w[at + 1:], w[:at] + rng.choice("aeo") + w[at:], w[:at] + rng.choice("aeo") + w[at + 1:]]))
        rows.append((10 + i, rng.choice([" ", ", ", "\n"]).join(words)))
    return rows + rows[-3:]


@pytest.mark.parametrize("block_rows", [spelling.BLOCK_ROWS, 3])
def test_spelling_variants_equal_brute_force(spark, block_rows, monkeypatch):
    if block_rows == 3:
        monkeypatch.setattr(spelling.near_words, "__defaults__", (3,))
        monkeypatch.setattr(spelling, "_SIDE", 5)
    rows = word_texts()
    words = brute_words(rows)
    assert len(words) > 150
    table = docs(spark, [(i, t, "s") for i, t in rows])
    assert {(r.word, r.n) for r in spelling.count_words(table).collect()} == set(words.items())
    got = {tuple(r) for r in spelling.digest(table).collect()}
    want = brute_variants(words)
    assert got == want and any(r[2] not in (r[0], r[1]) for r in want)


def test_spelling_of_few_words(spark):
    words = spark.createDataFrame([("aaaa", 100), ("aaab", 40), ("aabb", 10), ("abbb", 4), ("bbbb", 1), ("zzzz", 5), (None, 9)], "word string, n int")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.spelling_variants(words).collect()}
    assert got == {"aaaa": (None, "aaaa", 1), "aaab": ("aaaa", "aaaa", 2), "aabb": ("aaab", "aaaa", 2), "abbb": ("aabb", "aaaa", 2), "bbbb": ("abbb", "aaaa", 1), "zzzz": (None, "zzzz", 0)}
    tie = spark.createDataFrame([("word", 1), ("worda", 8), ("bword", 8)], "word string, n int")
    assert {r.word: r.form for r in spelling.spelling_variants(tie).collect()}["word"] == "bword"
    assert spelling.digest(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(words, ratio=1)


def test_each_pair_is_met_once(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randint(3, 6))): rng.randint(1, 9) for _ in range(700)}
    near = {r.word: r.n_near for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), 50).collect()}
    want = {w: sum(spelling.one_edit(w, v) for v in words) for w in words}
    assert near == {w: k for w, k in want.items() if k}
