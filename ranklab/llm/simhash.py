"""SimHash near-duplicates with pivot distance tables.

Fingerprints of whole texts are made in one pass; equal fingerprints are one node. A reference fingerprint (pivot) tells
at least |d(x, p) - d(y, p)| about the distance of x and y, so a table of distances to many pivots discards a pair by
its largest coordinate difference, and only survivors are compared bit by bit.

On fingerprints with independent bits one pivot separates no more than 4 pairs of 10 at four bits, so the table alone
would still look at every pair. The pairs that it is asked about therefore come from cells that lose none: 64 bits in
`blocks` blocks, of which two must agree if `bits` < `blocks` - 1. A cell that holds many fingerprints is cut into a
grid of bounded tasks. A task returns links that connect what is connected, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ranklab.llm.common import per_batch, utf8, written
from ranklab.llm.components import connected_components
from ranklab.session import union_all

BITS = 4
SHINGLE = 4
PIVOTS = 32
#: Most fingerprints of one side of a task within a cell.
CELL_ROWS = 4096
_ROWS_AT_ONCE = 4096


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half the XXH64 (seed 42) of the word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    stops = list(accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    starts = [0, *stops[:n - 1]]
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, n, 1 << 16):
        some = [digest(line[a:b - 1], 42) for a, b in zip(starts[low:low + (1 << 16)], stops[min(size, len(words)) - 1 + low:])]
        counts += np.unpackbits(np.array(some, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id and `fp`, the fingerprint as a signed bigint. Null and empty texts and texts of white space have
    fingerprint zero; texts of fewer words than a shingle are one shingle. Rows come back one for one."""
    def work(batch):
        prints = np.array([fingerprint(t) for t in utf8(batch.column("_text"))], dtype=np.uint64)
        return {"fp": prints.view(np.int64)}

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id", "_text"],
                     f"_id {kind}, fp long", work).withColumnRenamed("_id", id_col)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: digests of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i), 42) for i in range(n)], dtype=np.uint64)


def distance_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances [fingerprint, pivot]."""
    return np.bitwise_count(prints[:, None] ^ refs[None, :])


def linked_pairs(x: np.ndarray, tx: np.ndarray, y: np.ndarray, ty: np.ndarray, bits: int) -> np.ndarray:
    """For rows x[i], y[i]: discard by the largest coordinate difference, verify the survivors."""
    near = np.ones(len(x), dtype=bool)
    for low in range(0, tx.shape[1], 8):
        at = np.flatnonzero(near)
        gap = np.abs(tx[at, low:low + 8].astype(np.int8) - ty[at, low:low + 8].astype(np.int8)).max(axis=1)
        near[at] = gap <= bits
    at = np.flatnonzero(near)
    near[at] = np.bitwise_count(x[at] ^ y[at]) <= bits
    return near


def forest(x: np.ndarray, y: np.ndarray | None, refs: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (row, row) that connect the fingerprints of x, or of x and y (rows of y counted on from those of x; pairs
    within one side are then left to other tasks), as all pairs of at most `bits` bits would. Rows reached are taken off
    the rest, and the table of the rest is narrowed pivot by pivot before any fingerprint is compared."""
    both = x if y is None else np.concatenate((x, y))
    table = distance_table(both, refs).astype(np.int8)
    side = np.zeros(len(both), dtype=bool)
    side[len(x):] = True
    open_rows = np.ones(len(both), dtype=bool)
    links = []
    for seed in range(len(both)):
        if not open_rows[seed]:
            continue
        open_rows[seed] = False
        wave = [seed]
        while wave:
            i = wave.pop()
            rest = np.flatnonzero(open_rows if y is None else open_rows & (side != side[i]))
            for k in range(table.shape[1]):
                if len(rest) < 64:
                    break
                rest = rest[np.abs(table[rest, k] - table[i, k]) <= bits]
            rest = rest[np.abs(table[rest] - table[i]).max(axis=1, initial=0) <= bits]
            rest = rest[np.bitwise_count(both[rest] ^ both[i]) <= bits]
            open_rows[rest] = False
            links += [(i, j) for j in rest.tolist()]
            wave += rest.tolist()
    return links


def _cell_keys(fp: Column, blocks: int) -> Column:
    """Cell numbers of a fingerprint: for every two blocks a number of the two and their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1)) for i in range(blocks)]
    pairs = list(combinations(range(blocks), 2))
    return F.array(*[F.lit(k).cast("long") * F.lit(1 << 24) * F.lit(1 << 24) + parts[i] * F.lit(1 << 24) + parts[j] for k, (i, j) in enumerate(pairs)])


def near_links(nodes: DataFrame, bits: int = BITS, n_pivots: int = PIVOTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between rows (node, fp) of distinct fingerprints, enough to connect all fingerprints that pairs of
    at most `bits` differing bits connect. Exact: no cell is cut or skipped."""
    blocks = bits + 2
    refs = pivots(n_pivots)
    cells = nodes.select("node", "fp", F.explode(_cell_keys(F.col("fp"), blocks)).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    # Cells over the bound are rare: only they get a grid of (slice, slice) tasks, each row in every task of its slice.
    large = written(sizes.filter(F.col("n") > cell_rows).select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("cuts")), "cells")
    if large.isEmpty():
        cut = cells.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "node", "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
        marked = cells.join(large, "cell", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("own", own)
        cut = marked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
            "cell", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "node", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            here = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if rest is not None:
                here = [np.concatenate(x) for x in zip(rest, here)]
            n = len(here[0])
            new = np.flatnonzero((here[0][1:] != here[0][:-1]) | (here[1][1:] != here[1][:-1]) | (here[2][1:] != here[2][:-1])) + 1
            done = int(new[-1]) if len(new) else 0
            if done:
                yield _links([x[:done] for x in here], refs, bits)
            rest = [x[done:n].copy() for x in here]
        if rest is not None and len(rest[0]):
            yield _links(rest, refs, bits)

    return (cut.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(run, "a long, b long").distinct())


def _links(rows: list[np.ndarray], refs: np.ndarray, bits: int) -> pa.RecordBatch:
    """Links of the tasks in sorted rows. Small groups are compared all at once, row with row k further on; larger ones
    one by one."""
    cell, i, j, own, node = rows[:5]
    fp = rows[5].view(np.uint64)
    start = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    size = np.diff(np.concatenate((start, [len(cell)])))
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    left = np.repeat(np.where(size <= 32, start + size, 0), size) - np.arange(len(cell))
    for low in range(0, len(cell), _ROWS_AT_ONCE * 16):
        here = slice(low, low + _ROWS_AT_ONCE * 16 + 32)
        table = distance_table(fp[here], refs)
        for k in range(1, 32):
            at = np.flatnonzero(left[low:low + _ROWS_AT_ONCE * 16] > k)
            if not len(at):
                break
            at = at[(i[low + at] == j[low + at]) | (own[low + at] != own[low + at + k])]
            ok = at[linked_pairs(fp[low + at], table[at], fp[low + at + k], table[at + k], bits)]
            a.append(node[low + ok])
            b.append(node[low + ok + k])
    for s, n in zip(start[size > 32].tolist(), size[size > 32].tolist()):
        here = slice(s, s + n)
        if i[s] == j[s]:
            order, split = np.arange(s, s + n), None
        else:
            first = own[here] == i[s]
            order, split = s + np.concatenate((np.flatnonzero(first), np.flatnonzero(~first))), int(first.sum())
        x = fp[order]
        links = forest(x, None, refs, bits) if split is None else forest(x[:split], x[split:], refs, bits)
        if links:
            pairs = node[order[np.array(links)]]
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Per row: id, `fp` (bigint) and `component_id`, the smallest id reachable over links of at most `bits` bits.

    Ids are integers. Equal fingerprints (fingerprint zero of texts without words, too) always link. A row with a null
    id takes part in no component: its `component_id` is null. Rows repeated under one id with different texts connect
    what they link. An empty table gives no rows.
    """
    prints = written(fingerprints(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_t")), id_col, "_t"), "fingerprints")
    known = prints.filter(F.col(id_col).isNotNull())
    nodes = written(known.groupBy("fp").agg(F.min(id_col).alias("node")), "nodes")
    # Different fingerprints under one id are one document: their nodes are linked, too.
    twice = known.groupBy(id_col).agg(F.min("fp").alias("f"), F.max("fp").alias("g")).filter("f != g").select(id_col)
    same = (known.join(twice, id_col).select(F.col(id_col).alias("a"), "fp").join(nodes, "fp").select("a", F.col("node").alias("b")))
    found = connected_components(union_all([near_links(nodes, bits), same]))
    of_print = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    joined = prints.join(of_print, "fp", "left")
    return joined.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprint as 16 hexadecimal digits and component per document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of `docs`, all columns, whose id is the smallest of its component; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, bits)
    gone = found.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct().hint("merge")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
