"""Seeded, engine-independent random keys.

`rand()` and `xxhash64` differ between engines and versions; an md5 over `seed|purpose|ids` does not, survives
task retries, and gives every sampling operator its own stream through `purpose`."""

from __future__ import annotations

from hashlib import md5
from math import sin

import numpy as np
from pyspark.sql import Column, functions as F


def seeded_key(seed: int, purpose: str, *cols) -> Column:
    """32 hex digits, uniform, one per combination of `cols`."""
    parts = [F.lit(str(seed)), F.lit(purpose)] + [_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def key_to_long(key: Column) -> Column:
    """The first 15 hex digits as a non-negative BIGINT."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: MD5 (RFC 1321): its constants, its rotations, the word a step reads, and the numbers that are hashed at once.
_SINES = [int(abs(sin(i + 1)) * 2 ** 32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
HASHED_AT_ONCE = 1 << 14


def _md5_head(words: list[np.ndarray]) -> np.ndarray:
    """The first 8 bytes, as a big-endian number, of the MD5 of messages of one block: 16 arrays of 32-bit words."""
    a, b, c, d = (np.full(1, x, dtype=np.uint32) for x in _START)
    for i in range(64):
        mixed = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
        mixed = mixed + (a + np.uint32(_SINES[i]) + words[_WORDS[i]])
        a, d, c, b = d, c, b, b + ((mixed << np.uint32(_TURNS[i])) | (mixed >> np.uint32(32 - _TURNS[i])))
    first, second = ((x + np.uint32(y)).byteswap().astype(np.uint64) for x, y in zip((a, b), _START))
    return first << np.uint64(32) | second


def numbered_keys(prefix: str, first: int, last: int) -> np.ndarray:
    """`key_to_long` of the MD5 of `prefix` followed by each of the numbers first..last (from 0), many at a time: what
    `seeded_key(seed, purpose, boot, slot)` makes of the slots of one resample."""
    head, out, low = prefix.encode(), np.empty(max(last - first + 1, 0), dtype=np.int64), first
    while low <= last:
        digits = len(str(low))
        high = min(last, 10 ** digits - 1, low + HASHED_AT_ONCE - 1)
        size = len(head) + digits
        place = slice(low - first, high - first + 1)
        if size > 55:                                  # more than one block
            out[place] = [int(md5(head + str(x).encode()).hexdigest()[:15], 16) for x in range(low, high + 1)]
        else:
            message = np.zeros((1, 64), dtype=np.uint8)
            message[0, :len(head)] = np.frombuffer(head, dtype=np.uint8)
            message[0, size] = 0x80
            message[0, 56:58] = 8 * size % 256, 8 * size // 256
            words = list(message.view("<u4").astype(np.uint32).T.copy())
            start, stop = len(head) // 4, (size - 1) // 4 + 1
            varying = np.repeat(message[:, 4 * start:4 * stop], high - low + 1, axis=0)
            rest = np.arange(low, high + 1)
            for at in range(size - 1, len(head) - 1, -1):
                rest, digit = np.divmod(rest, 10)
                varying[:, at - 4 * start] = digit + 48
            words[start:stop] = varying.view("<u4").astype(np.uint32).T.copy()
            out[place] = (_md5_head(words) >> np.uint64(4)).astype(np.int64)
        low = high + 1
    return out
