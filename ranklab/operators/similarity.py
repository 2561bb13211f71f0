"""Exact similarity between two vector tables as a blocked matrix product.

Both sides are packed into blocks (one row = many vectors); blocks meet in an equi-join on a block number, so
no vector-level cross join exists in the plan; each task multiplies two blocks with numpy and emits only what
the caller needs: the best k partners per row, or per-column partial statistics that Spark then sums. The work
is spread over all executors, the numeric core stays in compiled BLAS, and nothing passes through the driver.

The smaller side is copied to every block of the larger one. If it fits the session's broadcast threshold Spark
broadcasts it; beyond that the same join runs as a shuffle, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ranklab.operators.ordering import rank_list

BLOCK_BYTES = 512 * 1024
_PACKED = "ids binary, vectors binary, dim int"


def _packer(unit: bool):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            ids = batch["id"].to_numpy(dtype=np.int64)
            rows = np.stack([np.asarray(v, dtype=np.float64) for v in batch["vec"]])
            if unit:
                length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
                rows = rows / np.where(length == 0, 1.0, length)
            step = max(1, BLOCK_BYTES // (8 * rows.shape[1]))
            for start in range(0, len(ids), step):
                part = rows[start:start + step]
                yield pd.DataFrame({"ids": [ids[start:start + step].tobytes()], "vectors": [part.tobytes()],
                                    "dim": [part.shape[1]]})
    return pack


def pack_blocks(df: DataFrame, id_col: str, vec_col: str, unit: bool = True) -> DataFrame:
    """(id, vector) rows -> blocks, inside each partition: no shuffle."""
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    return slim.mapInPandas(_packer(unit), _PACKED)


def _block_pairs(left: DataFrame, right: DataFrame, right_rows: int, dim: int) -> DataFrame:
    """Every left block beside every right block.

    If the right side's bytes, known from its row count, fit the session's broadcast threshold, it is broadcast.
    Otherwise the two sides meet on a grid: a left block is copied to every grid column, a right block to every
    grid row, and the equi-join on (grid row, grid column) spreads the products over grid x grid tasks."""
    spark = left.sparkSession
    limit = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    size = right_rows * dim * 8
    fits = size <= limit
    grid = 1 if fits else max(2, min(256, -(-size // (64 * 1024 * 1024)) * 8))
    slot = F.pmod(F.xxhash64("ids"), F.lit(grid)).cast("int")
    every = F.sequence(F.lit(0), F.lit(grid - 1))
    lhs = left.withColumn("grid_row", slot)
    rhs = right.withColumn("grid_col", slot)
    lhs = lhs.withColumn("grid_col", F.explode(every) if not fits else slot)
    rhs = rhs.withColumn("grid_row", F.explode(every) if not fits else slot)
    lhs = lhs.select("grid_row", "grid_col", *[F.col(c).alias(f"l_{c}") for c in ("ids", "vectors", "dim")])
    rhs = rhs.select("grid_row", "grid_col", *[F.col(c).alias(f"r_{c}") for c in ("ids", "vectors", "dim")])
    return lhs.join(F.broadcast(rhs) if fits else rhs, ["grid_row", "grid_col"])


def _unpack(row, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}_ids"], dtype=np.int64)
    return ids, np.frombuffer(row[f"{side}_vectors"], dtype=np.float64).reshape(len(ids), int(row[f"{side}_dim"]))


def block_products(left: DataFrame, right: DataFrame, emit, schema: str, left_id: str, right_id: str,
                   left_vec: str = "vec", right_vec: str = "vec", unit: bool = True,
                   right_rows: int | None = None, dim: int | None = None) -> DataFrame:
    """Run `emit(left_ids, right_ids, products)` on every pair of blocks; `emit` returns a pandas frame."""
    if right_rows is None or dim is None:
        head = right.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(right_vec)).alias("d")).first()
        right_rows, dim = head["n"], head["d"] or 1

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                left_ids, a = _unpack(row, "l")
                right_ids, b = _unpack(row, "r")
                yield emit(left_ids, right_ids, a @ b.T)

    pairs = _block_pairs(pack_blocks(left, left_id, left_vec, unit), pack_blocks(right, right_id, right_vec, unit),
                         right_rows, dim)
    return pairs.mapInPandas(multiply, schema)


def top_per_row(left_ids: np.ndarray, right_ids: np.ndarray, products: np.ndarray, k: int, decimals: int = 9):
    """The k best right ids of each left id inside one block pair (ties by right id), as flat arrays."""
    scores = np.round(products, decimals) + 0.0
    by_id = np.argsort(right_ids, kind="stable")
    scores, ids = scores[:, by_id], right_ids[by_id]
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.repeat(left_ids, best.shape[1]), ids[best].ravel(), np.take_along_axis(scores, best, axis=1).ravel()


def top_k_cosine(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, left_vec: str = "vec",
                 right_vec: str = "vec", best_of: str = "right") -> DataFrame:
    """Exact top-k by cosine. `best_of='right'`: the k nearest right rows of each left row (a text's tags).
    `best_of='left'`: the k nearest left rows of each right row (a query's documents, the corpus on the left).
    Returns (left_id, right_id, score, rank); scores are rounded to 9 decimals before ranking so equal cosines
    tie in every engine, and ties go to the smaller id."""
    schema = f"{left_id} long, {right_id} long, score double"
    if best_of == "right":
        def emit(l, r, s):
            a, b, c = top_per_row(l, r, s, k)
            return pd.DataFrame({left_id: a, right_id: b, "score": c})
        owner, partner = left_id, right_id
    else:
        def emit(l, r, s):
            b, a, c = top_per_row(r, l, s.T, k)
            return pd.DataFrame({left_id: a, right_id: b, "score": c})
        owner, partner = right_id, left_id
    partial = block_products(left, right, emit, schema, left_id, right_id, left_vec, right_vec)
    return rank_list(partial, k, keys=(owner,), tie=(partner,))


def carried_products(left: DataFrame, right: DataFrame, carried: DataFrame, emit, schema: str, left_id: str, right_id: str,
                     left_vec: str = "vec", right_vec: str = "vec") -> DataFrame:
    """`emit(left_ids, right_ids, cosines, numbers)` on every pair of blocks: each right row brings the numbers that
    `carried(right_id, p)` has for it (arrays of one length), so what is done to a score is done inside the product.
    Cosines are rounded to 9 decimals."""
    rows = right.select(F.col(right_id).alias("r"), F.col(right_vec).alias("rv")).join(carried.select(F.col(right_id).alias("r"), "p"), "r")
    head = rows.agg(F.max(F.size("rv")).alias("d"), F.max(F.size("p")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    dim, width = head["d"] or 1, head["w"] or 0
    both = rows.select("r", F.concat(F.col("rv").cast("array<double>"), F.col("p").cast("array<double>")).alias("v"))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                left_ids, a = _unpack(row, "l")
                right_ids, b = _unpack(row, "r")
                length = np.sqrt((b[:, :dim] ** 2).sum(axis=1))
                cosines = a @ (b[:, :dim] / np.where(length == 0, 1.0, length)[:, None]).T
                yield emit(left_ids, right_ids, np.round(cosines, 9) + 0.0, b[:, dim:])

    pairs = _block_pairs(pack_blocks(left, left_id, left_vec), pack_blocks(both, "r", "v", False), head["n"], dim + width)
    return pairs.mapInPandas(multiply, schema)


def pair_cosines(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vec: str = "vec",
                 right_vec: str = "vec") -> DataFrame:
    """(left_id, right_id, score) of the given pairs only, by two joins; 9 decimals, 0 if a vector has no direction."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    lhs = left.select(F.col(left_id), F.col(left_vec).cast("array<double>").alias("lv"))
    rhs = right.select(F.col(right_id), F.col(right_vec).cast("array<double>").alias("rv"))
    joined = pairs.select(left_id, right_id).distinct().join(lhs, left_id).join(rhs, right_id)
    length = F.sqrt(dot("lv", "lv")) * F.sqrt(dot("rv", "rv"))
    return joined.select(left_id, right_id, (F.round(F.when(length > 0, dot("lv", "rv") / length).otherwise(F.lit(0.0)), 9) + F.lit(0.0)).alias("score"))


def ranks_of_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, left_id: str, right_id: str, left_vec: str = "vec",
                   right_vec: str = "vec") -> DataFrame:
    """(right_id, left_id, rank): where the given left rows stand in the list of all left rows of a right row, by cosine
    (9 decimals) and then id, without making the lists.

    The scores of a right row's pairs travel with its vector, so one product of blocks counts for all of them what
    stands before; a block returns one count for each pair. A right row has as many pairs as its list is deep."""
    scored = pair_cosines(pairs, left, right, left_id, right_id, left_vec, right_vec)
    marks = scored.groupBy(F.col(right_id).alias("r")).agg(F.collect_list(F.struct(F.col("score").alias("s"), F.col(left_id).cast("double").alias("l"))).alias("marks"))
    width = marks.agg(F.max(F.size("marks"))).first()[0] or 1
    pad = lambda field: F.concat(F.col(f"marks.{field}"), F.array_repeat(F.lit(float("nan")), F.lit(width) - F.size("marks")))
    carried = marks.select(F.col("r").alias(right_id), F.concat(pad("s"), pad("l")).alias("p"))

    def emit(ids, right_ids, scores, numbers):
        out = []
        for j, r in enumerate(right_ids):
            n = int((~np.isnan(numbers[j, :width])).sum())
            wanted, owners = numbers[j, :n], numbers[j, width:width + n]
            order = np.lexsort((ids, -scores[:, j]))
            falling, by_id = -scores[order, j], ids[order]
            low, high = np.searchsorted(falling, -wanted, side="left"), np.searchsorted(falling, -wanted, side="right")
            before = [lo + int(np.searchsorted(by_id[lo:hi], int(o))) for lo, hi, o in zip(low, high, owners)]
            out.append(pd.DataFrame({"r": r, "l": owners.astype(np.int64), "n": before}))
        return pd.concat(out) if out else pd.DataFrame({"r": [], "l": [], "n": []})

    counted = carried_products(left, right, carried, emit, "r long, l long, n long", left_id, right_id, left_vec, right_vec)
    return counted.groupBy("r", "l").agg((F.sum("n") + 1).alias("rank")).select(F.col("r").alias(right_id), F.col("l").alias(left_id), "rank")


def all_cosines(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vec: str = "vec",
                right_vec: str = "vec") -> DataFrame:
    """Every cosine as a long table, for operators whose result is the full texts x tags table. The right side
    must be a vocabulary (tags, roles), not a corpus: the output has |left| x |right| rows by definition."""
    def emit(l, r, s):
        return pd.DataFrame({left_id: np.repeat(l, len(r)), right_id: np.tile(r, len(l)),
                             "score": (np.round(s, 9) + 0.0).ravel()})
    return block_products(left, right, emit, f"{left_id} long, {right_id} long, score double", left_id, right_id,
                          left_vec, right_vec)
