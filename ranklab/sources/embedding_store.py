"""Incremental embeddings: vectors are stored per text key, and only missing texts are computed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ranklab.session import checkpoint, union_all

Compute = Callable[[pd.Series], list]


def text_key(text) -> Column:
    return F.sha1(F.col(text) if isinstance(text, str) else text)


def hashed_bag_of_words(dim: int = 64) -> Compute:
    """A stand-in encoder: word counts hashed to `dim` signed buckets."""
    import zlib

    def encode(texts: pd.Series) -> list:
        out = []
        for text in texts:
            vec = np.zeros(dim)
            for word in text.lower().split():
                code = zlib.crc32(word.encode("utf-8"))
                vec[code % dim] += 1.0 if code & 0x10000 else -1.0
            out.append(vec.astype(np.float32).tolist())
        return out
    return encode


def missing_texts(texts: DataFrame, store: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, text): distinct texts the store has no vector for. Equal texts are one row before the anti join,
    so a text copied on a third of all rows is encoded once."""
    wanted = texts.select(text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    distinct = wanted.groupBy("text_key").agg(F.min("text").alias("text"))
    return distinct.join(store.select("text_key"), "text_key", "left_anti")


def encode(todo: DataFrame, compute: Compute) -> DataFrame:
    """(text_key, vec) through an Arrow-batched encoder."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"text_key": batch["text_key"], "vec": compute(batch["text"])})
    return todo.mapInPandas(run, "text_key string, vec array<float>")


def incremental_embed(texts: DataFrame, store: DataFrame, compute: Compute, store_path: str | None = None,
                      text_col: str = "text") -> DataFrame:
    """`texts` with a `vec` column. New vectors are appended to the store folder (or checkpointed when there is
    none), so a later failure does not encode them again."""
    new = encode(missing_texts(texts, store, text_col), compute)
    if store_path:
        # Only the vectors that these texts need are kept from the store before it is appended to.
        wanted = texts.select(text_key(text_col).alias("text_key")).distinct()
        known = checkpoint(store.select("text_key", F.col("vec").alias("old")).join(wanted, "text_key", "left_semi"))
        new = checkpoint(new)
        new.write.mode("append").parquet(store_path)
        vectors = union_all([known.select("text_key", F.col("old").alias("vec")), new])
    else:
        vectors = union_all([store.select("text_key", "vec"), checkpoint(new)])
    return texts.withColumn("text_key", text_key(text_col)).join(vectors, "text_key", "left")


def lookup_embeddings_strict(texts: DataFrame, store: DataFrame, text_col: str = "text") -> DataFrame:
    """`texts` with vectors; missing keys stop the job with their count. The count is one aggregate row the rows
    are checked against, so the guard costs one extra pass and no collect."""
    joined = texts.withColumn("text_key", text_key(text_col)).join(store.select("text_key", "vec"), "text_key", "left")
    missing = joined.agg(F.count_if(F.col("vec").isNull())).scalar()
    guarded = joined.withColumn("_missing", missing)
    fail = F.raise_error(F.concat(F.col("_missing").cast("string"), F.lit(" texts have no stored vector")))
    return guarded.where(F.when(F.col("_missing") > 0, fail.cast("boolean")).otherwise(F.lit(True))).drop("_missing")
