"""Latent ranking of tag sets by truncated SVD of the idf-weighted document x tag matrix.

The matrix stays a table of (document, tag) pairs. Block subspace iteration multiplies it with a tall table of vectors,
one per tag, by a join and a sum per document, and back by a join and a sum per tag. Tall tables are made orthonormal by
their Gram matrix (rank x rank, the only thing that the driver sees), after each half step, so condition numbers are not
squared twice. One basis serves all smaller ranks: its axes come in the order of their singular values.

A vocabulary of at most `DIRECT_TAGS` needs no iteration: one pass counts how often two tags meet in a document, the driver
turns that tags x tags matrix, and documents stay sets of tags. Their vectors are made where a product of blocks reads them
and are neither shuffled nor written, so disk grows with the pairs and not with documents x rank."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ranklab.operators.dense import dense_rank
from ranklab.operators.ordering import rank_list
from ranklab.operators.similarity import top_per_row
from ranklab.operators.tags import tag_idf
from ranklab.session import checkpoint, union_all

#: Directions iterated beyond those asked for, which speeds up convergence of the last ones.
OVERSAMPLE = 10
SEED = 7
#: The largest vocabulary whose matrix of common documents is made whole (8 MB), documents unfolded at once, and bytes of
#: query vectors that every task may hold; more of them meet the documents block by block.
DIRECT_TAGS = 1_000
FOLD_ROWS = 2_048
QUERY_BYTES = 8 * 1024 * 1024


def _start(tags: DataFrame, width: int, seed: int) -> DataFrame:
    """(tag_id, vec): Gaussian vectors drawn from seed and tag alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"tag_id": batch["tag_id"], "vec": [np.random.default_rng((seed, int(t) & (1 << 63) - 1)).standard_normal(width) for t in batch["tag_id"]]})

    return tags.select("tag_id").mapInPandas(run, "tag_id long, vec array<double>")


def _times(pairs: DataFrame, vectors: DataFrame, key: str, to: str) -> DataFrame:
    """(to, vec): per `to` the weighted sum of the vectors of its `key`s, combined before the shuffle."""
    weighted = pairs.join(vectors, key).select(to, array_to_vector(F.transform("vec", lambda x: x * F.col("weight"))).alias("v"))
    return weighted.groupBy(to).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("vec"))


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products of all vectors: every task adds up its own, rows of the sums meet in a shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                block = np.stack(batch["vec"].to_numpy())
                total += block.T @ block
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    rows = vectors.select("vec").mapInPandas(run, "i int, row array<double>")
    summed = rows.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    out = np.zeros((width, width))
    for r in summed.toLocalIterator():
        out[r.i] = r.row
    return (out + out.T) / 2


def _turned(vectors: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Every vector times a rank x rank matrix."""
    kind = vectors.schema[key].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "vec": list(np.stack(batch["vec"].to_numpy()) @ shared.value)})

    return vectors.select(key, "vec").mapInPandas(run, f"{key} {kind}, vec array<double>")


def _whitening(gram: np.ndarray) -> np.ndarray:
    """M so that vectors times M are orthonormal; directions without weight go."""
    values, axes = np.linalg.eigh(gram)
    keep = values > 1e-13 * max(values.max(), 0.0)
    return axes[:, keep] / np.sqrt(values[keep])


def _tag_sets(pairs: DataFrame, owner: str) -> DataFrame:
    """(owner, tags): the distinct tags of each owner; a vocabulary bounds the array."""
    return pairs.select(owner, "tag_id").where(F.col("tag_id").isNotNull()).groupBy(owner).agg(F.collect_set("tag_id").alias("tags"))


def _unfolded(sets: list[np.ndarray], tags: np.ndarray) -> np.ndarray:
    """0/1 matrix of tag sets over the sorted vocabulary `tags`; other tags count nothing."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets).astype(np.int64) if sizes.sum() else np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(tags, flat), len(tags) - 1)
    known = tags[at] == flat
    out = np.zeros((len(sets), len(tags)))
    out[np.repeat(np.arange(len(sets)), sizes)[known], at[known]] = 1.0
    return out


def _blocks(batches: Iterator[pd.DataFrame], owner: str, tags: np.ndarray) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """(owners, 0/1 rows), a bounded number at a time."""
    for batch in batches:
        for start in range(0, len(batch), FOLD_ROWS):
            part = batch.iloc[start:start + FOLD_ROWS]
            yield part[owner], _unfolded(list(part["tags"]), tags)


def _meetings(sets: DataFrame, tags: np.ndarray) -> np.ndarray:
    """Documents that two tags share, tags x tags: whole numbers, so the order of the sum does not matter."""
    shared, width = sets.sparkSession.sparkContext.broadcast(tags), len(tags)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for _, block in _blocks(batches, "doc_id", shared.value):
            total += block.T @ block
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    rows = sets.select("doc_id", "tags").mapInPandas(run, "i int, row array<double>")
    summed = rows.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    out = np.zeros((width, width))
    for r in summed.toLocalIterator():
        out[r.i] = r.row
    return out


def _direct_axes(sets: DataFrame, idf: DataFrame, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tags, idf, axes: tags x rank) of a small vocabulary, exact: the leading eigenvectors of the Gram matrix of its columns."""
    rows = sorted((r.tag_id, r.idf) for r in idf.select("tag_id", "idf").collect())
    tags, weight = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows])
    values, axes = np.linalg.eigh(_meetings(sets, tags) * weight[:, None] * weight)
    keep = values > 1e-13 * max(values.max(), 0.0)
    return tags, weight, axes[:, keep][:, ::-1][:, :rank]


def lsa_basis(doc_tags: DataFrame, docs: DataFrame, rank: int, tolerance: float = 1e-7, max_rounds: int = 60, seed: int = SEED) -> DataFrame:
    """(tag_id, idf, axis): each tag's coordinates on the leading right singular vectors, by descending singular value.

    Rounds go on until no leading squared singular value moves by more than `tolerance` of the largest, or
    `max_rounds`; a rank at or above that of the matrix is exact after one. There are fewer axes than `rank` if the matrix
    has no more. Vocabulary and documents may be of any size; no tags, no rows."""
    pairs = doc_tags.select("doc_id", "tag_id").distinct()
    idf = checkpoint(tag_idf(pairs, docs).where(F.col("tag_id").isNotNull()))
    if 0 < idf.count() <= DIRECT_TAGS:
        tags, weight, axes = _direct_axes(_tag_sets(pairs, "doc_id"), idf, rank)
        found = [(t, w, x) for t, w, x in zip(tags.tolist(), weight.tolist(), axes.tolist())]
        return doc_tags.sparkSession.createDataFrame(found, f"tag_id {idf.schema['tag_id'].dataType.simpleString()}, idf double, axis array<double>")
    pairs = checkpoint(pairs.join(idf, "tag_id").select("doc_id", "tag_id", F.col("idf").alias("weight")))
    n_tags = idf.count()
    width = min(rank + OVERSAMPLE, n_tags)
    basis, settled = checkpoint(_start(idf, max(width, 1), seed)), None
    for _ in range(max_rounds if n_tags else 0):
        image = checkpoint(_times(pairs, basis, "tag_id", "doc_id"))
        gram = _gram(image, width)
        values = np.linalg.eigvalsh(gram)[::-1][:rank]
        if settled is not None and len(values) == len(settled) and np.abs(values - settled).max() <= tolerance * values[0]:
            break
        settled = values
        # From the second round on the basis is orthonormal, so `values` are squared singular values.
        white = _whitening(gram)
        back = checkpoint(_times(pairs, _turned(image, "doc_id", white), "doc_id", "tag_id"))
        white = _whitening(_gram(back, white.shape[1]))
        basis, width = checkpoint(_turned(back, "tag_id", white)), white.shape[1]
    if n_tags:
        # The last image tells how the basis must be turned for its axes to be singular vectors, the largest first.
        _, axes = np.linalg.eigh(_gram(_times(pairs, basis, "tag_id", "doc_id"), width))
        basis = _turned(basis, "tag_id", axes[:, ::-1][:, :rank])
    return checkpoint(basis.join(idf, "tag_id").select("tag_id", "idf", F.col("vec").alias("axis")))


def _project(pairs: DataFrame, owner: str, basis: DataFrame) -> DataFrame:
    """(owner, vec): sum of idf x tag coordinates."""
    return _times(pairs.select(owner, "tag_id").distinct(), basis.select("tag_id", F.col("idf").alias("weight"), F.col("axis").alias("vec")), "tag_id", owner)


def _folded(sets: DataFrame, owner: str, tags: np.ndarray, scaled: np.ndarray) -> DataFrame:
    """(owner, vec): sum of the rows of `scaled` (tags x rank) that belong to the tags of each set."""
    kind = sets.schema[owner].dataType.simpleString()
    shared = sets.sparkSession.sparkContext.broadcast((tags, scaled))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, axes = shared.value
        for owners, block in _blocks(batches, owner, vocabulary):
            known = block.any(axis=1)
            yield pd.DataFrame({owner: owners[known], "vec": list(block[known] @ axes)})

    return sets.select(owner, "tags").mapInPandas(run, f"{owner} {kind}, vec array<double>")


def _best_of_sets(sets: DataFrame, asked: DataFrame, tags: np.ndarray, scaled: np.ndarray, ranks: Sequence[int], k: int) -> DataFrame:
    """(dim, query_id, doc_id, score): per rank the k best documents of each query in each block of documents. A block's
    vectors are made, compared at every rank and dropped inside one task."""
    rows = sorted((r.query_id, r.tags) for r in asked.select("query_id", "tags").collect())
    known = _unfolded([np.asarray(r[1]) for r in rows], tags) if rows else np.zeros((0, len(tags)))
    some = known.any(axis=1)
    owners = np.array([r[0] for r in rows], dtype=np.int64)[some]

    def unit(x: np.ndarray) -> np.ndarray:
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(length == 0, 1.0, length)

    shared = sets.sparkSession.sparkContext.broadcast((tags, scaled, owners, known[some] @ scaled))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, axes, query_ids, vectors = shared.value
        sides = [unit(vectors[:, :r]) for r in ranks]
        for ids, block in _blocks(batches, "doc_id", vocabulary) if len(query_ids) else ():
            found = block.any(axis=1)
            doc_ids, docs = ids.to_numpy(dtype=np.int64)[found], block[found] @ axes
            step = max(1, min(FOLD_ROWS, (1 << 20) // len(query_ids)))
            for start in range(0, len(doc_ids), step):
                part = docs[start:start + step]
                for r, side in zip(ranks, sides):
                    q, d, score = top_per_row(query_ids, doc_ids[start:start + step], side @ unit(part[:, :r]).T, k)
                    yield pd.DataFrame({"dim": np.int32(r), "query_id": q, "doc_id": d, "score": score})

    return sets.select("doc_id", "tags").mapInPandas(run, "dim int, query_id long, doc_id long, score double")


def _indexed(doc_tags: DataFrame, docs: DataFrame, rank: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray] | None]:
    """The documents' tag sets, written once, and, of a small vocabulary, (tags, idf x coordinates)."""
    sets = checkpoint(_tag_sets(doc_tags, "doc_id"))
    idf = checkpoint(tag_idf(sets.select("doc_id", F.explode("tags").alias("tag_id")), docs))
    if not 0 < idf.count() <= DIRECT_TAGS:
        return sets, None
    tags, weight, axes = _direct_axes(sets, idf, rank)
    return sets, (tags, axes * weight[:, None])


def _vectors(sets: DataFrame, docs: DataFrame, query_tags: DataFrame, rank: int, direct: tuple[np.ndarray, np.ndarray] | None) -> tuple[DataFrame, DataFrame]:
    """Vectors of documents and queries at `rank`."""
    if direct is not None:
        return _folded(sets, "doc_id", *direct), checkpoint(_folded(_tag_sets(query_tags, "query_id"), "query_id", *direct))
    pairs = sets.select("doc_id", F.explode("tags").alias("tag_id"))
    basis = lsa_basis(pairs, docs, rank)
    return _project(pairs, "doc_id", basis), _project(query_tags, "query_id", basis)


def lsa_vectors(doc_tags: DataFrame, docs: DataFrame, query_tags: DataFrame, rank: int) -> tuple[DataFrame, DataFrame]:
    sets, direct = _indexed(doc_tags, docs, rank)
    return _vectors(sets, docs, query_tags, rank, direct)


def lsa_rank(doc_tags: DataFrame, docs: DataFrame, query_tags: DataFrame, rank: int = 256, k: int = 50) -> DataFrame:
    """ranked(query_id, doc_id, score, rank) by cosine in the latent space; signs of the axes cancel."""
    return lsa_sweep(doc_tags, docs, query_tags, [rank], k).select("query_id", "doc_id", "score", "rank")


def lsa_sweep(doc_tags: DataFrame, docs: DataFrame, query_tags: DataFrame, ranks: Sequence[int], k: int = 50) -> DataFrame:
    """ranked(dim, query_id, doc_id, score, rank) at several ranks from one basis. A rank beyond that of the matrix
    truncates nothing."""
    sets, direct = _indexed(doc_tags, docs, max(ranks))
    if direct is not None:
        asked = checkpoint(_tag_sets(query_tags, "query_id"))
        if asked.count() * direct[1].shape[1] * 8 <= QUERY_BYTES:
            return rank_list(_best_of_sets(sets, asked, *direct, ranks, k), k, keys=("dim", "query_id")).select("query_id", "doc_id", "score", "rank", "dim")
    d, q = _vectors(sets, docs, query_tags, max(ranks), direct)
    d, q = (d, q) if direct is not None else (checkpoint(d), checkpoint(q))
    return union_all([dense_rank(d, q, k, r).withColumn("dim", F.lit(r)) for r in ranks])
