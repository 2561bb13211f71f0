"""Repeated passages of several lines, removed with content-defined chunks of lines; DataFrame functions only.

A polynomial hash of the last two line hashes rolls over the lines of a text; where it is a multiple of `DIVISOR` a
chunk ends, and a line of over `LONG_WORDS` words, a passage by itself, has a border on both sides. Borders depend on
nearby lines alone, so an inserted line moves no border farther on, and a passage copied elsewhere is cut into the same
chunks but for its rim. Chunks of two lines or more and long lines that occur again anywhere are removed after their
bytes have been compared; the first occurrence, by id and position, stays. The rim follows: from a removed chunk to both
sides, lines go as long as they equal those beside its first occurrence, over `REACH` chunks on either side.

A passage of few lines may hold no whole chunk. So the two lines under the rolling hash at a border, and any two lines of
over `LONG_WORDS` words together, are compared like chunks; they go if the stretch around them that equals the first
occurrence has over `LONG_WORDS` words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ranklab.llm.common import written

#: Mean number of lines of a chunk, fewest lines of a chunk that may be removed, most words of a line that may not be
#: removed by itself, and the base and modulus of the hash.
DIVISOR = 2
MIN_LINES = 2
LONG_WORDS = 50
#: Chunks on either side of a repeated one over which equal lines are followed.
REACH = 3
BASE = 1_000_003
MODULUS = 2_147_483_647
_SPAN = 1 << 31


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once per row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def n_words(line: Column) -> Column:
    """Words of a line, parted by blanks; one at least."""
    return F.size(F.split(F.trim(line), " +", -1))


def chunk_codes(lines: Column, words: Column) -> Column:
    """Chunks of an array of lines, in order, as numbers: first line (from 1) * 2**31 + number of lines."""
    def spans(ends: Column) -> Column:
        starts = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, F.lit(1), F.size(ends) - 1))
        return F.zip_with(starts, ends, lambda s, e: (s + 1) * _SPAN + (e - s))

    def borders(hashes: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), F.slice(hashes, F.lit(1), F.size(hashes) - 1))
        rolled = F.zip_with(hashes, before, lambda h, b: (h + b * BASE) % MODULUS)
        last = F.size(hashes).cast("long")
        marks = F.transform(rolled, lambda r, i: F.when((r % DIVISOR == 0) | (i + 1 == last) | (F.get(words, i) > LONG_WORDS) | (F.get(words, i + 1) > LONG_WORDS),
                                                        (i + 1).cast("long")))
        return let(F.filter(marks, lambda m: m.isNotNull()), spans)

    line_hash = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))
    return let(line_hash, borders)


def _at(code: Column) -> Column:
    return F.floor(code / _SPAN).cast("int")


def _n(code: Column) -> Column:
    return (code % _SPAN).cast("int")


def _text(lines: Column, code: Column) -> Column:
    return F.array_join(F.slice(lines, _at(code), _n(code)), "\n")


def _digests(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(x))


def _common(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    return let(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int"),
               lambda at: F.when(at == 0, F.size(b)).otherwise(at - 1))


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"), *more)


def _anchors(lines: Column) -> Column:
    """What may be removed: `code`, `hash` of the text (null if blank or too small), `pair` (two lines that are no
    chunk), and the first and last line, `low` and `high`, up to which its surroundings are followed."""
    def around(words: Column, codes: Column) -> Column:
        def of_chunk(c: Column, i: Column) -> Column:
            low = F.when(i >= REACH, _at(F.get(codes, i - REACH))).otherwise(1).alias("low")
            high = F.coalesce(let(F.get(codes, i + REACH), lambda x: _at(x) + _n(x) - 1), F.size(lines)).alias("high")

            def entry(code: Column, asked: Column, pair: bool) -> Column:
                return F.struct(code.alias("code"), F.when(asked, let(_text(lines, code), lambda t: F.when(F.trim(t) != "", F.xxhash64(t)))).alias("hash"),
                                F.lit(pair).alias("pair"), low, high)

            ends = F.filter(F.sequence(_at(c), _at(c) + _n(c) - 1), lambda j: (j > 1) & ((j == _at(c) + _n(c) - 1) | (F.get(words, j - 2) + F.get(words, j - 1) > LONG_WORDS)))
            pairs = F.transform(ends, lambda j: let((j - 1).cast("long") * _SPAN + 2, lambda code: entry(code, code != c, True)))
            return F.concat(F.array(entry(c, (_n(c) >= MIN_LINES) | (F.get(words, _at(c) - 1) > LONG_WORDS), False)), pairs)

        return F.flatten(F.transform(codes, of_chunk))

    return let(F.transform(lines, n_words), lambda words: let(chunk_codes(lines, words), lambda codes: around(words, codes)))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with later occurrences, (`_id`, `_th`: hash of the text) and `found`: code of each such chunk, the
    bytes of the first occurrence, and hashes of 64 bits of the lines before (nearest first) and after that, which are
    compared only beside equal bytes.

    Hashes of all chunks are counted first, which shuffles a few bytes per chunk and combines common ones beforehand.
    Only chunks whose hash repeats have their text compared: the bytes are part of the grouping key.
    """
    rows = _rows(docs, id_col, text_col)
    chunks = rows.select("_id", "_th", F.inline(let(lines_of(F.col("_text")), _anchors))).filter("hash is not null")
    # Written, so that the join below is one of two plain shuffles, of which a common hash may be split.
    again = written(chunks.groupBy("hash").agg(F.count("*").alias("times")).filter("times > 1").select("hash"), "hashes")
    found = written(chunks.join(again, "hash"), "chunks")
    per_doc = found.groupBy("_id", "_th").agg(F.collect_set(F.struct("code", "low", "high")).alias("codes"))
    # Merge joins at every size: texts meet their chunks the same way whether or not the chunks could be broadcast.
    texts = rows.join(per_doc.withColumnRenamed("_id", "_i").withColumnRenamed("_th", "_h").hint("merge"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_h")))
    compared = texts.select("_id", "_th", F.inline(let(lines_of(F.col("_text")), lambda lines: F.transform("codes", lambda c: F.struct(
        c["code"].alias("code"), _text(lines, c["code"]).alias("bytes"),
        _digests(F.reverse(F.slice(lines, c["low"], _at(c["code"]) - c["low"]))).alias("before"),
        let(_at(c["code"]) + _n(c["code"]), lambda end: _digests(F.slice(lines, end, c["high"] + 1 - end))).alias("after"))))))
    first = compared.groupBy("bytes").agg(F.min(F.struct("_id", "_th", "code", "before", "after")).alias("first"))
    first = first.select(F.xxhash64("bytes").alias("hash"), "bytes", F.col("first._id").alias("_i"), F.col("first._th").alias("_h"),
                         F.col("first.code").alias("_c"), "first.before", "first.after")
    later = found.join(first, "hash").filter(~(F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_h")) & (F.col("code") == F.col("_c"))))
    return later.groupBy("_id", "_th").agg(F.collect_set(F.struct("code", "pair", "bytes", "before", "after")).alias("found"))


def _gone(lines: Column, found: Column) -> Column:
    """Numbers (from 1) of the lines to remove: chunks with the bytes of their first occurrence, and their rims."""
    def stretch(at: Column, end: Column, x: Column) -> Column:
        low = F.greatest(F.lit(1), at - F.size(x["before"]))
        up = _common(_digests(F.reverse(F.slice(lines, low, at - low))), x["before"])
        down = _common(_digests(F.slice(lines, end, F.size(x["after"]))), x["after"])
        return F.sequence(at - up, end - 1 + down)

    def enough(numbers: Column, x: Column) -> Column:
        words = F.aggregate(numbers, F.lit(0), lambda n, i: n + n_words(F.get(lines, i - 1)))
        return F.when(~x["pair"] | (words > LONG_WORDS), numbers).otherwise(F.array().cast("array<int>"))

    same = F.filter(found, lambda x: _text(lines, x["code"]) == x["bytes"])
    return F.array_distinct(F.flatten(F.transform(same, lambda x: let(stretch(_at(x["code"]), _at(x["code"]) + _n(x["code"]), x), lambda numbers: enough(numbers, x)))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None,
                lines_col: str | None = None) -> DataFrame:
    """`docs`, all rows and columns, with the repeated chunks and their rims taken out of the text.

    Lines end at \\n. Null and empty texts come back as they are; a text all of whose lines stand elsewhere becomes
    empty. Chunks of white space only go with a neighbour or not at all. Every line removed stands in an earlier place
    that stays. A document is its id together with its text: equal rows count as one document and get the same result;
    documents with a null id come first in order. With `removed_col` the number of removed lines is added, with `lines_col`
    that of the lines before (0 for null).
    """
    found = repeated_chunks(docs, id_col, text_col).withColumnRenamed("found", "_found")
    # Columns of the same form and order as in `repeated_chunks`: of a table of ids and texts one shuffle serves both.
    names = {n: f"_c{i}" for i, n in enumerate(docs.columns) if n not in (id_col, text_col)}
    keyed = _rows(docs, id_col, text_col, *[F.col(n).alias(c) for n, c in names.items()])
    both = keyed.join(found.withColumnRenamed("_id", "_i").withColumnRenamed("_th", "_h").hint("merge"),
                      F.col("_id").eqNullSafe(F.col("_i")) & (keyed["_th"] == F.col("_h")), "left")

    def cut(lines: Column) -> Column:
        return let(_gone(lines, F.col("_found")), lambda gone: F.struct(F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(1), F.size(lines)), gone), lambda i: F.get(lines, i - 1)), "\n").alias("text"), F.size(gone).cast("long").alias("n")))

    both = both.withColumn("_cut", F.when(F.col("_found").isNotNull(), let(lines_of(F.col("_text")), cut)))
    text = F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(F.col("_cut.text"))
    more = []
    if removed_col:
        more.append(F.coalesce(F.col("_cut.n"), F.lit(0).cast("long")).alias(removed_col))
    if lines_col:
        more.append(F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines_of(F.col("_text")))).cast("long").alias(lines_col))
    return both.select(*[text.alias(n) if n == text_col else F.col("_id" if n == id_col else names[n]).alias(n) for n in docs.columns], *more)


def digest(docs: DataFrame) -> DataFrame:
    """Deduplicated text per document with its numbers of lines before and of lines removed."""
    return dedup_lines(docs.select("doc_id", "text"), removed_col="n_removed", lines_col="n_lines").select("doc_id", "text", "n_lines", "n_removed")


ORACLE = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
h AS (SELECT doc_id, i, lines[i] AS line, len(lines) AS n_lines, ('0x' || substr(md5(lines[i]), 1, 8))::BIGINT AS h,
      len(string_split_regex(trim(lines[i]), ' +')) AS words FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
b AS (SELECT *, ((h + {BASE} * coalesce(lag(h) OVER w, 0)) % {MODULUS}) % {DIVISOR} = 0 OR i = n_lines OR words > {LONG_WORDS} OR coalesce(lead(words) OVER w, 0) > {LONG_WORDS} AS ends,
      lag(line) OVER w || chr(10) || line AS two, lag(words) OVER w + words AS two_words FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
l AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b),
k AS (SELECT doc_id, chunk, min(i) AS place, count(*) AS n, max(words) AS words, string_agg(line, chr(10) ORDER BY i) AS bytes FROM l GROUP BY ALL),
s AS (SELECT doc_id, chunk, place, n, bytes, false AS pair FROM k WHERE n >= {MIN_LINES} OR words > {LONG_WORDS}
      UNION ALL SELECT l.doc_id, l.chunk, l.i - 1, 2, two, true FROM l JOIN k USING (doc_id, chunk)
      WHERE l.i > 1 AND (ends OR two_words > {LONG_WORDS}) AND NOT (k.n = 2 AND k.place = l.i - 1)),
f AS (SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(place) OVER w AS first_place, first_value(chunk) OVER w AS first_chunk
      FROM s WHERE trim(bytes) <> '' WINDOW w AS (PARTITION BY bytes ORDER BY doc_id, place)),
m AS (SELECT row_number() OVER () AS id, doc_id, place, n, pair, first_doc, first_place, first_chunk FROM f WHERE (doc_id, place) <> (first_doc, first_place)),
e AS (SELECT m.id, l.i - m.first_place AS step, m.n, m.pair, l.words, l.line IS NOT DISTINCT FROM o.line AS same FROM m
      JOIN l ON l.doc_id = m.first_doc AND (l.chunk BETWEEN m.first_chunk - {REACH} AND m.first_chunk + {REACH} OR l.i BETWEEN m.first_place AND m.first_place + m.n - 1)
      LEFT JOIN l AS o ON o.doc_id = m.doc_id AND o.i = m.place + l.i - m.first_place),
y AS (SELECT id, coalesce(max(step) FILTER (NOT same AND step < 0) + 1, min(step)) AS low, coalesce(min(step) FILTER (NOT same AND step >= n) - 1, max(step)) AS high FROM e GROUP BY id),
x AS (SELECT id, low, high FROM y JOIN e USING (id) WHERE step BETWEEN low AND high GROUP BY ALL HAVING NOT bool_or(pair) OR sum(words) > {LONG_WORDS}),
g AS (SELECT DISTINCT doc_id, place + step AS i FROM m JOIN x USING (id), unnest(range(low, high + 1)) AS u(step)),
t AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(t.n_lines, 0)::BIGINT AS n_lines,
       coalesce(t.n_removed, 0)::BIGINT AS n_removed FROM d LEFT JOIN t USING (doc_id)
"""
