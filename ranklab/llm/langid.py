"""Language identification by nearest centroid.

A text is the vector of its character n-gram counts, hashed to `DIMS` places, weighted by TF-IDF and scaled to length
one. Every language has several centroids, found by spherical k-means over its training vectors; the nearest centroid by
cosine gives the language, and a text farther from it than any training vector, with a margin, is rejected.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ranklab.llm.common import bounded_rows, keep_rows, per_batch

UNKNOWN = "und"
DIMS = 4096
GRAMS = (1, 2, 3)
CENTROIDS = 3
#: The fit reads about this many different training texts of each language, drawn by a hash of the text; less if there are so
#: many languages that MAX_SAMPLE texts (DIMS floats each on the driver) would not do.
SAMPLE_PER_LANG = 1500
MAX_LANGS = 500
MAX_SAMPLE = 12_000
#: A text is rejected below this share of the smallest cosine that a training text has to its centroid.
MARGIN = 0.5


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Hashed counts of the lower-cased n-grams of a whole text; runs of characters that are no letters are one space."""
    total = np.zeros(DIMS, dtype=np.float32)
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letters = _LETTER[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    codes = np.where(letters, codes, np.uint32(32))
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    codes = np.concatenate((np.array([32], dtype=np.uint32), codes[keep], np.array([32], dtype=np.uint32)))
    mixed = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        mixed = (mixed[:size] ^ codes[n - 1:n - 1 + size]) * np.uint32(0x9E3779B1)
        if n in GRAMS:
            total += np.bincount((mixed ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20), minlength=DIMS)
    return total


_LETTER = np.array([chr(i).isalpha() if not 0xD800 <= i <= 0xDFFF else False for i in range(0x10000)])


@dataclass(frozen=True)
class Model:
    """Weights of the places, centroids (rows of length one), the language of each and the cosine below which its
    texts are rejected."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    floor: np.ndarray

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        """Vectors of length one, made in place of the counts."""
        np.log1p(tf, out=tf)
        tf *= self.idf
        tf /= np.maximum(np.sqrt(np.einsum("ij,ij->i", tf, tf)), 1e-30)[:, None]
        return tf

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine and rejection of each text; of equal cosines the first language wins."""
        langs, scores, rejected = [], [], []
        for low in range(0, len(texts), 256):
            some = texts[low:low + 256]
            alive = [_has_letter(t) for t in some]
            if not self.langs or not any(alive):
                best = cosine = np.zeros(len(some), dtype=np.int64)
            else:
                near = self.vectors(np.stack([counts(t if ok else "") for t, ok in zip(some, alive)])) @ self.centroids.T
                best = near.argmax(axis=1)
                cosine = near[np.arange(len(some)), best]
            for ok, k, c in zip(alive, best.tolist(), cosine.tolist()):
                good = ok and bool(self.langs)
                langs.append(self.langs[k] if good else UNKNOWN)
                scores.append(min(1.0, max(0.0, float(c))) if good else 0.0)
                rejected.append(not good or c < self.floor[k])
        return langs, scores, rejected


def held_out(id_col: str = "doc_id") -> Column:
    """Ids of the fold that is never learned from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Number of the centroid of each row. Starts from rows spread along the order given, so equal input gives equal
    output."""
    k = min(k, len(x))
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        of = (x @ centre.T).argmax(axis=1)
        for c in range(k):
            if (of == c).any():
                mean = x[of == c].mean(axis=0)
                centre[c] = mean / max(np.linalg.norm(mean), 1e-30)
    return (x @ centre.T).argmax(axis=1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", centroids: int = CENTROIDS,
        per_lang: int = SAMPLE_PER_LANG) -> Model:
    """A model of all languages among the labelled rows that are not held out.

    Languages and their numbers of different texts (to a few per cent) come from all rows. Of each language about
    `per_lang` different texts, chosen by a hash, are turned into vectors on the executors; the driver gets DIMS small
    numbers of at most MAX_SAMPLE texts. However often a text is repeated, it counts once. Rows whose text or language is
    null, or whose text has no letter, teach nothing; no rows give a model that knows no language.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = rows.filter(~held_out("_id") & F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (F.col("_lang") != UNKNOWN))
    sizes = {r["_lang"]: r["n"] for r in bounded_rows(rows.groupBy("_lang").agg(F.approx_count_distinct(F.xxhash64("_text")).alias("n")), MAX_LANGS, "languages")}
    empty = Model(np.ones(DIMS, dtype=np.float32), np.zeros((0, DIMS), dtype=np.float32), (), np.zeros(0))
    if not sizes:
        return empty
    draw = F.shiftrightunsigned(F.xxhash64("_lang", "_text"), 11).cast("double") / float(1 << 53)
    per_lang = min(per_lang, 0.8 * MAX_SAMPLE / len(sizes))
    wanted = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_lang / max(n, 1)))])
    sample = rows.withColumn("_draw", draw).filter(F.col("_draw") < wanted[F.col("_lang")])
    # Copies of a drawn text meet inside their partition first, so a hot text is one row per partition in the shuffle.
    sample = sample.groupBy("_lang", "_draw").agg(F.min("_text").alias("_text"))

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column("_text").to_pylist()
        return {"tf": [zlib.compress(counts(t).astype("<f4").tobytes(), 1) if _has_letter(t) else None for t in texts]}

    vectors = per_batch(sample, ["_lang", "_draw", "_text"], "_lang string, _draw double, tf binary", work, keep=["_lang", "_draw"])
    got = bounded_rows(vectors.filter("tf is not null"), MAX_SAMPLE, "training sample")
    got.sort(key=lambda r: (r["_lang"], r["_draw"]))
    if not got:
        return empty
    label = np.array([r["_lang"] for r in got], dtype=object)
    tf = np.zeros((len(got), DIMS), dtype=np.float32)
    for i, row in enumerate(got):
        tf[i] = np.frombuffer(zlib.decompress(row["tf"]), dtype="<f4")
    del got
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x = Model(idf, empty.centroids, (), empty.floor).vectors(tf)
    found, names, floor = [], [], []
    for lang in sorted(set(label.tolist())):
        own = x[label == lang]
        of = spherical_kmeans(own.copy(), centroids)
        for c in range(of.max() + 1):
            if (of == c).any():
                mean = own[of == c].mean(axis=0)
                found.append(mean / max(np.linalg.norm(mean), 1e-30))
                names.append(lang)
                floor.append(MARGIN * float((own[of == c] @ found[-1]).min()))
    return Model(idf, np.stack(found).astype(np.float32), tuple(names), np.array(floor))


def _shared(docs: DataFrame, model: Model):
    """The model by way of a broadcast of plain values (a few centroids of DIMS numbers per language), so that workers
    need not have this package to read it."""
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.centroids, model.langs, model.floor))
    return lambda: Model(*shared.value)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, `held_out`, `lang_pred` (a learned language, or `und` if the text is null or has no letter), `score`
    (cosine to the nearest centroid, 0 to 1) and `rejected` (`und`, or too far from every centroid). Only the text is
    read for a prediction; null or repeated ids come back row by row."""
    predictor = _shared(docs, model)

    def work(batch: pa.RecordBatch) -> dict:
        langs, scores, rejected = predictor().predict(batch.column("_text").to_pylist())
        return {"lang_pred": langs, "score": scores, "rejected": rejected}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = per_batch(rows, ["_id", "_text"], f"_id {kind}, lang_pred string, score double, rejected boolean", work)
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "lang_pred", "score", "rejected")


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose language is known."""
    predictor = _shared(docs, model)
    return keep_rows(docs, text_col, lambda batch: [not r for r in predictor().predict(batch.column(text_col).to_pylist())[2]])


def digest(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, by a model of those that are not held out."""
    return identify(docs, fit(docs))
