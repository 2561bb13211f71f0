"""Passages of benchmark items in documents: one Aho-Corasick automaton, one scan of every text.

Texts are normalised byte by byte (A-Z lowered, every ASCII byte that is no letter or digit a separator), so every word
keeps its place in the original. Items are cut into windows of `window` words; all windows are the patterns of a single
automaton. A hit is translated from the normalised text to word numbers and from there to offsets of the original.

Windows are cut and counted by Spark. More of them than WINDOW_BYTES go into several groups, each with an automaton of its
own that is read, used and given up before the next: a pass over the texts per group, and any number of items is exact
within the memory of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from ranklab.llm.common import utf8, written

WINDOW = 13
#: Bytes of distinct windows, with the ids of their items, in one automaton: about 60 times as much memory in a worker.
WINDOW_BYTES = 16 << 20
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def item_windows(text: str | None, window: int = WINDOW) -> list[tuple[bytes, int]]:
    """Distinct windows of one item as (words between single spaces, number of words)."""
    words = (text or "").encode().translate(FOLD).split()
    n = min(window, len(words))
    return list(dict.fromkeys((b" ".join(words[k:k + n]), n) for k in range(len(words) - n + 1))) if n else []


class Passages:
    """The automaton over windows of the benchmark; built once per worker and kept with the broadcast."""

    def __init__(self, windows: list[tuple[bytes, int, tuple[str, ...]]]) -> None:
        self.automaton = ahocorasick.Automaton() if windows else None
        for words, n, items in windows:
            self.automaton.add_word(f" {words.decode('latin-1')} ", (n, items))
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: bytes, runs: list[tuple[int, int]] = (), items: list[str] = ()) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words of a text, the merged runs of hit words (from, to) and the items found, as sorted strings;
        with what earlier automata found."""
        words = text.translate(FOLD).split()
        hits = []
        if words and self.automaton is not None:
            hits = [(end, n, found) for end, (n, found) in self.automaton.iter(f" {b' '.join(words).decode('latin-1')} ")]
        if not hits:
            return len(words), list(runs), list(items)
        ends = np.fromiter(accumulate(len(w) + 1 for w in words), dtype=np.int64, count=len(words))
        last = np.searchsorted(ends, [end for end, _, _ in hits])
        merged: list[tuple[int, int]] = []
        for start, stop in sorted([*((int(k) + 1 - n, int(k) + 1) for k, (_, n, _) in zip(last, hits)), *runs]):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
            else:
                merged.append((start, stop))
        return len(words), merged, sorted({item for _, _, found in hits for item in found}.union(items))


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of word numbers as code-point offsets (start, end exclusive) of the original text."""
    if not runs:
        return []
    word = np.frombuffer(text.translate(FOLD), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    return [(int(points[edge[2 * a]]), int(points[edge[2 * b - 1]])) for a, b in runs]


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The distinct windows of all items: (words, n, items), the items that contain each as strings. An item without id
    has windows, but no name to list."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = item_windows(text, window)
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int32()),
                                                  pa.array([item] * len(found), pa.string())], names=["words", "n", "item"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    return items.mapInArrow(cut, "words binary, n int, item string").groupBy("words", "n").agg(F.collect_set("item").alias("items"))


def _scanned(df: DataFrame, text_col: str, benchmark: DataFrame, window: int, fields: list[StructField],
             finish: Callable[[pa.RecordBatch, list[tuple]], list], keep: list[str]) -> DataFrame:
    """The columns `keep` of `df` and those of `fields`, which `finish` makes from a batch and its scans (number of words,
    runs, items). One pass; with several groups of windows, all but the last write what they found beside the rows."""
    spark = df.sparkSession
    windows = written(benchmark_windows(benchmark, window=window), "benchmark-windows")
    weight = F.length("words") + F.coalesce(F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x) + 8), F.lit(0))
    groups = (windows.agg(F.sum(weight.cast("long"))).first()[0] or 0) // WINDOW_BYTES + 1
    found = "_found"
    while found in df.columns:
        found += "_"
    kind = StructType.fromDDL(f"{found} struct<runs: array<struct<a: long, b: long>>, items: array<string>>")
    for group in range(groups):
        some = windows.filter(F.pmod(F.xxhash64("words"), F.lit(groups)) == group).collect()
        shared = spark.sparkContext.broadcast({"windows": [(bytes(w.words), w.n, tuple(w["items"])) for w in some]})
        last = group == groups - 1
        kept = [df.schema[c] for c in (keep if last else [c for c in df.columns if c != found])]
        schema = StructType([*kept, *(fields if last else kind.fields)])

        def run(batches, shared=shared, arrow=to_arrow_schema(schema), last=last, names=[f.name for f in kept]):
            state = shared.value
            if "passages" not in state:
                state["passages"] = Passages(state.pop("windows"))
            scan = state["passages"].scan
            for batch in batches:
                before = batch.column(found).to_pylist() if found in batch.schema.names else [{"runs": [], "items": []}] * batch.num_rows
                scans = [scan(text, [(r["a"], r["b"]) for r in old["runs"]], old["items"]) for text, old in zip(utf8(batch.column(text_col)), before)]
                new = finish(batch, scans) if last else [[{"runs": [{"a": a, "b": b} for a, b in runs], "items": items} for _, runs, items in scans]]
                columns = [batch.column(n).cast(arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, f.type) for v, f in zip(new, list(arrow)[len(names):]))], schema=arrow)

        df = df.mapInArrow(run, schema)
        if not last:
            df = written(df, "scanned")
            shared.unpersist()
    return df


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id, `n_words`, `n_hit` (words inside any occurrence of a window), `items` (sorted as strings) and `spans`
    (hit runs as code-point offsets of the original text).

    An item of fewer than `window` words is one window; items without words match nothing, those without id are not listed
    in `items`, but their words are hit. A null text has no words. Rows are scanned one by one, so null or repeated ids come back as they are.
    """
    def finish(batch: pa.RecordBatch, scans: list[tuple]) -> list:
        spans = [[{"start": a, "end": b} for a, b in original_spans(text, runs)] for text, (_, runs, _) in zip(utf8(batch.column("_text")), scans)]
        return [[n for n, _, _ in scans], [sum(b - a for a, b in runs) for _, runs, _ in scans], [items for _, _, items in scans], spans]

    fields = StructType.fromDDL("n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>").fields
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return _scanned(rows, "_text", benchmark, window, fields, finish, ["_id"]).withColumnRenamed("_id", id_col)


def is_contaminated(n_hit, n_words):
    """At least one hit word, and one in twenty words hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, all columns, that are not contaminated."""
    flag = "_clean"
    while flag in docs.columns:
        flag += "_"

    def finish(batch: pa.RecordBatch, scans: list[tuple]) -> list:
        return [[not is_contaminated(sum(b - a for a, b in runs), n) for n, runs, _ in scans]]

    return _scanned(docs, text_col, benchmark, window, [StructField(flag, BooleanType())], finish, docs.columns).filter(F.col(flag)).drop(flag)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns per document."""
    found = find_passages(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, n, array_to_string(w[k + 1:k + n], ' ') AS words
      FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(len(w) - n + 1)) AS u(k)),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
g AS (SELECT doc_id, n, k, array_to_string(w[k + 1:k + n], ' ') AS words FROM d, (SELECT DISTINCT n FROM p), unnest(range(greatest(0, len(w) - n + 1))) AS u(k)),
h AS (SELECT doc_id, n, k, item FROM g JOIN p USING (n, words)),
c AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT doc_id, n, k FROM h), unnest(range(n)) AS u(j) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
