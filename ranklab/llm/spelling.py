"""Spelling variants of the words of a corpus, found with blocked Gram matrices of letter counts.

Words are counted first, so everything after that is over the vocabulary. One inserted or deleted letter moves the
vector of letter counts by 1, one replaced letter by a squared distance of 2 at most: |x|^2 + |y|^2 - 2 x.y from one
NumPy product of two blocks leaves few pairs, which are then compared letter by letter.

Blocks hold words of one length, or of two adjacent ones. As common lengths hold a large share of all words, a block is
cut by how many letters a word has of each of `CLASSES` classes (by code point). For every class a word joins the block
named by its class counts less one letter of that class; a word one letter shorter is in the block of its own counts.
Two words with one edit between them thus meet in exactly one block, where they are compared once. Blocks of over
`BLOCK_ROWS` words are cut into a grid of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ranklab.llm.common import CRC_TABLE_SQL, crc_sql, written
from ranklab.session import union_all

PATTERN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TYPO = 97
MIN_LETTERS = 5
MIN_TIMES = 3
RATIO = 2
CLASSES = 8
BLOCK_ROWS = 8192
#: Rows and columns of one product; letters are told apart by code point modulo DIMS; longer words are compared one by one.
_SIDE = 1024
_DIMS = 160
_WIDE = 48


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, typo: int | None = TYPO,
                min_letters: int = MIN_LETTERS, min_times: int = MIN_TIMES) -> DataFrame:
    """(word, n) of all words of at least `min_letters` code points and `min_times` occurrences in whole texts.

    Words are the matches of `pattern` with A-Z lower-cased. With `typo` a letter goes from every word for which that
    number divides the CRC-32 of `<id>:<word>`: letter CRC modulo length. Null and empty texts have no words, a null id
    counts as empty, equal rows count each. Occurrences are summed before the shuffle.
    """
    run = F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(pattern), F.lit(0))).alias("_run")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), run)
    word = F.col("_run")
    if typo:
        runs = runs.withColumn("_crc", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
        at = (F.col("_crc") % F.char_length("_run")).cast("int")
        cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
        word = F.when(F.col("_crc") % typo == 0, cut).otherwise(word)
    return (runs.select(word.alias("word")).filter(F.char_length("word") >= min_letters)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_times))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of all words, and the words' lengths."""
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64), lens


def _class_counts(words: list[str]) -> np.ndarray:
    flat, lens = _codes(words)
    row = np.repeat(np.arange(len(words)), lens)
    return np.bincount(row * CLASSES + flat % CLASSES, minlength=len(words) * CLASSES).reshape(-1, CLASSES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word the block of its class counts (class -1), and for each class it has the block with one letter less.
    `first` marks the first of these, where words of equal class counts are compared."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        n = batch.column("n").to_pylist()
        block, kind, first, at = [], [], [], []
        for i, counts in enumerate(_class_counts(words).tolist()):
            block.append(".".join(map(str, counts)))
            kind.append(-1)
            first.append(False)
            at.append(i)
            fresh = True
            for k, c in enumerate(counts):
                if c:
                    counts[k] = c - 1
                    block.append(".".join(map(str, counts)))
                    counts[k] = c
                    kind.append(k)
                    first.append(fresh)
                    at.append(i)
                    fresh = False
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(kind, pa.int32()), pa.array(first), pa.array([words[i] for i in at]), pa.array([n[i] for i in at], pa.int64())],
                                         names=["block", "kind", "first", "word", "n"])


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def _verified(words: list[str], short: np.ndarray, lens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of candidates are one edit apart; `short` holds the letters of words up to _WIDE."""
    ok = np.zeros(len(a), dtype=bool)
    wide = (lens[a] > _WIDE) | (lens[b] > _WIDE)
    for i in np.flatnonzero(wide).tolist():
        ok[i] = one_edit(words[a[i]], words[b[i]])
    at = np.flatnonzero(~wide & (lens[a] == lens[b]))
    ok[at] = (short[a[at]] != short[b[at]]).sum(axis=1) == 1
    at = np.flatnonzero(~wide & (lens[a] != lens[b]))
    less = lens[a[at]] < lens[b[at]]
    s, t = short[np.where(less, a[at], b[at])], short[np.where(less, b[at], a[at])]
    head = (s != t).argmax(axis=1)
    off = s[:, :-1] != t[:, 1:]
    tail = np.where(off.any(axis=1), off.shape[1] - 1 - off[:, ::-1].argmax(axis=1), -1)
    ok[at] = tail < head
    return ok


def _near(rows: list) -> pa.RecordBatch:
    """Per word of the sorted rows of some blocks: near words met here, and the one of largest n (the first of several)."""
    block, i, j, own, kind, first, words, n = rows
    n = np.asarray(n)
    new = np.concatenate(([True], (block[1:] != block[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    group = np.cumsum(new) - 1
    stop = np.append(np.flatnonzero(new)[1:], len(words))[group]
    flat, lens = _codes(words)
    row = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    fits = (lens <= _WIDE)[row]
    short = np.zeros((len(words), _WIDE + 1), dtype=np.uint32)
    short[row[fits], place[fits]] = flat[fits]
    pairs = []
    for low in range(0, len(words), _SIDE):
        high = min(low + _SIDE, len(words))
        for left in range(low, int(stop[high - 1]), _SIDE):
            right = min(left + _SIDE, int(stop[high - 1]))
            here = (row >= low) & (row < right) if right - low < len(words) else slice(None)
            counts = np.bincount((row[here] - low) * _DIMS + flat[here] % _DIMS, minlength=(right - low) * _DIMS).reshape(-1, _DIMS).astype(np.float32)
            counts = counts[:, counts.any(axis=0)]
            x, y = counts[:high - low], counts[left - low:right - low]
            far = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
            a, b = np.nonzero(far <= 2)
            a, b = a + low, b + left
            keep = (a < b) & (group[a] == group[b]) & ((i[a] == j[a]) | (own[a] != own[b]))
            keep &= np.where(kind[a] == kind[b], first[a], True) & ((kind[a] >= 0) | (kind[b] >= 0))
            a, b = a[keep], b[keep]
            for k in range(0, len(a), 1 << 16):
                at = slice(k, k + (1 << 16))
                ok = _verified(words, short, lens, a[at], b[at])
                pairs.append(np.stack((a[at][ok], b[at][ok])))
    both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
    a, b = np.concatenate((both[0], both[1])), np.concatenate((both[1], both[0]))
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(head, len(a)))
    return pa.RecordBatch.from_arrays([pa.array([words[x] for x in a[head].tolist()], pa.string()), pa.array(times, pa.int64()), pa.array(n[b[head]], pa.int64()),
                                       pa.array([words[x] for x in b[head].tolist()], pa.string())], names=["word", "near", "best_n", "best"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block and task; whole tasks are compared, those at the end of a batch with the next."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        whole = table.to_batches()[0] if table.num_rows else batch
        key = [whole.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        new = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
        done = int(new[-1]) if len(new) else 0
        if done:
            yield _near(_arrays(whole.slice(0, done)))
        rest = whole.slice(done)
    if rest is not None and rest.num_rows:
        yield _near(_arrays(rest))


def _arrays(batch: pa.RecordBatch) -> list:
    return [c.to_pylist() if name == "word" else c.to_numpy(zero_copy_only=False) for name, c in zip(batch.schema.names, batch.columns)]


def near_words(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, n_near, best, best_n) for the rows (word, n) of distinct `words` that have near words; `best` is the near
    word of largest n, of several the smallest in code-point order. Exact: no block is cut short."""
    blocks = written(words.select("word", "n").mapInArrow(_blocks, "block string, kind int, first boolean, word string, n long"), "blocks")
    large = written(blocks.groupBy("block").agg(F.count("*").alias("rows")).filter(F.col("rows") > block_rows)
                    .select("block", F.ceil(F.col("rows") / block_rows).cast("int").alias("cuts")), "large")
    # Every row asks for its block's cuts, at every size by the same shuffle; most blocks are one task.
    marked = blocks.join(large.hint("merge"), "block", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int"))
    tasks = marked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "block", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "kind", "first", "word", "n")
    met = tasks.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "word").mapInArrow(_compare, "word string, near long, best_n long, best string")
    best = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("_top"))
    return best.select("word", "n_near", F.col("_top.best").alias("best"), (-F.col("_top.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): follow forms to a word that has none. Every round doubles the steps taken, so
    chains of n words take about log2(n) rounds; each is written. Words that have arrived are not looked up again, so a
    root that many words lead to is asked for once by each. `forms` must not lead in a circle."""
    steps = written(forms.select("word", F.col("form").alias("to"), F.lit(False).alias("done")), "steps")
    while not steps.filter("not done").isEmpty():
        on = steps.select(F.col("word").alias("to"), F.col("to").alias("next"), F.col("done").alias("ends"))
        walked = steps.filter("not done").join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.coalesce("ends", F.lit(True)).alias("done"))
        steps = written(union_all([steps.filter("done"), walked]), "steps")
    return steps.select("word", F.col("to").alias("root"))


def spelling_variants(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """For rows (word, n) of distinct words: `n_near` (words one inserted, deleted or replaced code point away), `form`
    and `form_n` (the near word of largest n if that is at least `ratio` times the word's, else null) and `root`.

    Null words go; words of which none is near get 0 and themselves. `ratio` must exceed 1, or forms could lead in a
    circle. No words, no rows; other columns are not carried.
    """
    if ratio <= 1:
        raise ValueError("ratio must exceed 1")
    words = words.filter(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n"))
    near = near_words(words)
    better = F.col("best_n") >= F.col("n") * ratio
    found = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                           F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n")), "variants")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """Variants of all words of the documents."""
    return spelling_variants(written(count_words(docs), "words"))


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}')) AS run FROM documents),
times AS (SELECT id, run, count(*) AS m FROM runs GROUP BY ALL),
crcs AS (SELECT run, m, {crc_sql("id || ':' || run")} AS h FROM times, crc_table),
found AS (SELECT CASE WHEN h % {TYPO} = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, m FROM crcs),
words AS (SELECT word, sum(m)::BIGINT AS n FROM found WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(m) >= {MIN_TIMES}),
less AS (SELECT DISTINCT word, n, p, substring(word, 1, p - 1) AS head, substring(word, p + 1) AS tail FROM words, unnest(range(1, length(word) + 1)) AS u(p)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.p = b.p AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.head || a.tail = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.head || a.tail = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
up(word, top, k) AS (SELECT word, word, 0 FROM words UNION ALL SELECT up.word, f.form, k + 1 FROM up JOIN forms f ON up.top = f.word AND f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN (SELECT word, arg_max(top, k) AS root FROM up GROUP BY word) r ON f.word = r.word
"""
