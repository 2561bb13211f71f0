"""Byte-level BPE over whole texts with a public vocabulary of merge ranks.

Merges are found with a hierarchical-bitmap rank queue: every rank that waits has a bucket of positions of a linked
list of parts, two levels of 256-bit words mark the buckets in use, and find-first-set leads to the lowest rank.
Positions whose pair has changed meanwhile are stale and skipped when they come up. A pre-token of n bytes takes
O(n log n) steps, so very long ones need no special case.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from ranklab.llm.common import per_batch, utf8

CACHE_ITEMS = 200_000
CACHE_CHARS = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


WORD = 8
_BIT = [1 << i for i in range(1 << WORD)]


class Codec:
    """Encoder and decoder of one vocabulary; made once per worker. It remembers short pre-tokens in two generations of
    at most CACHE_ITEMS: what is in use moves to the younger one, and the older one is forgotten when that is full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        n_ranks = max(ranks.values(), default=0) + 1
        self.buckets: list[list[int]] = [[] for _ in range(n_ranks)]
        self.words = [0] * ((n_ranks >> WORD) + 1)
        self.tokens = dict(map(reversed, ranks.items()))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token. The queue's operations are written out here, since all time goes there: `top` marks
        the words in use, a word its ranks, and a bucket holds the positions of a rank, leftmost first."""
        ranks, buckets, words, top = self.ranks, self.buckets, self.words, 0
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, rank_of = len(piece), ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [rank_of(piece[i:i + 2]) for i in range(n - 1)]
        pair.append(None)
        for i, rank in enumerate(pair):
            if rank is not None:
                bucket = buckets[rank]
                if not bucket:
                    words[rank >> WORD] |= _BIT[rank & 255]
                    top |= 1 << (rank >> WORD)
                bucket.append(i)
        while top:
            at = (top & -top).bit_length() - 1
            word = words[at]
            bit = word & -word
            lowest = at << WORD | bit.bit_length() - 1
            bucket = buckets[lowest]
            i = heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if not bucket:
                words[at] = word = word ^ bit
                if not word:
                    top &= top - 1
            if pair[i] != lowest:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = None
            if end < n:
                before[end] = i
                pair[i] = rank = rank_of(piece[i:after[end]])
                if rank is not None:
                    bucket = buckets[rank]
                    if not bucket:
                        words[rank >> WORD] |= _BIT[rank & 255]
                        top |= 1 << (rank >> WORD)
                    heappush(bucket, i)
            else:
                pair[i] = None
            i = before[i]
            if i >= 0:
                rank = rank_of(piece[i:end])
                if rank != pair[i]:
                    pair[i] = rank
                    if rank is not None:
                        bucket = buckets[rank]
                        if not bucket:
                            words[rank >> WORD] |= _BIT[rank & 255]
                            top |= 1 << (rank >> WORD)
                        heappush(bucket, i)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def _packed(self, piece: str) -> bytes:
        ids = self.known.get(piece) or self.older.get(piece)
        if ids is None:
            merged = self.merge(piece.encode())
            ids = pack(f"<{len(merged)}I", *merged)
        if len(piece) <= CACHE_CHARS:
            if len(self.known) >= CACHE_ITEMS:
                self.older, self.known = self.known, {}
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        known, packed = self.known.get, self._packed
        return b"".join([known(piece) or packed(piece) for piece in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _shared(df: DataFrame, ranks: dict[bytes, int], pattern: str):
    """Workers build the codec once and keep it with the broadcast; a vocabulary is bounded by its file (a few MB)."""
    shared = df.sparkSession.sparkContext.broadcast({"ranks": ranks, "pattern": pattern})

    def codec() -> Codec:
        state = shared.value
        if "codec" not in state:
            state["codec"] = Codec(state["ranks"], state["pattern"])
        return state["codec"]

    return codec


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id and `ids`: the token ids of the whole text as packed little-endian unsigned 32-bit integers.

    Each match of `pattern` is merged separately; special tokens are plain text. Null and empty texts give empty ids.
    Ids may be null or repeated: rows are encoded one by one and all come back.
    """
    codec = _shared(docs, ranks, pattern)

    def work(batch):
        encode_one = codec().encode
        return {"ids": [encode_one(t) if t else b"" for t in batch.column("_text").to_pylist()]}

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id", "_text"],
                     f"_id {kind}, ids binary", work).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`encoded` as id, `ids` and `decoded`: the bytes the packed ids stand for. Null ids decode to no bytes."""
    codec = _shared(encoded, ranks, pattern)

    def work(batch):
        decode_one = codec().decode
        return {"decoded": [decode_one(x) for x in utf8(batch.column("ids"))]}

    kind = encoded.schema[id_col].dataType.simpleString()
    return per_batch(encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("ids")), ["_id", "ids"],
                     f"_id {kind}, ids binary, decoded binary", work, keep=["_id", "ids"]).withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`decode(encode(docs))` in one pass: id, `ids` and `decoded`."""
    codec = _shared(docs, ranks, pattern)

    def work(batch):
        one = codec()
        ids = [one.encode(t) if t else b"" for t in batch.column("_text").to_pylist()]
        return {"ids": ids, "decoded": [one.decode(x) for x in ids]}

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id", "_text"],
                     f"_id {kind}, ids binary, decoded binary", work).withColumnRenamed("_id", id_col)


def round_trip_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts and digests of ids and decoded bytes per row."""
    return round_trip(docs, ranks, pattern, id_col, text_col).select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
