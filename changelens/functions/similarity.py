"""Body similarity. The subsequence length has no built-in, so it is an Arrow UDF over whole batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from changelens.functions.text import column, non_whitespace_bytes, strip_whitespace


def _subsequence_function() -> Callable[[bytes, bytes], int]:
    # Nested, so that workers get the code itself and need no copy of this package.
    def subsequence_length(a: bytes, b: bytes, least: int = 0) -> int:
        """Length of the longest common subsequence by the bit-vector method (one big-integer step per byte).

        -1 as soon as it is known to be below ``least``.
        """
        if len(a) > len(b):
            a, b = b, a
        # What both begin and end with belongs to some longest one.
        ends = 0
        for turned in (False, True):
            x, y = (a[::-1], b[::-1]) if turned else (a, b)
            low, high = 0, len(x)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
            ends += low
            a, b = (a[: len(a) - low], b[: len(b) - low]) if turned else (a[low:], b[low:])
        if not a:
            return ends
        where: dict[int, int] = {}
        for i, byte in enumerate(a):
            where[byte] = where.get(byte, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for at in range(0, len(b), 256):
            for byte in b[at : at + 256]:
                hit = row & where.get(byte, 0)
                row = ((row + hit) | (row - hit)) & full
            length = ends + len(a) - row.bit_count()
            if length + max(0, len(b) - at - 256) < least:
                return -1
        return length

    return subsequence_length


subsequence_length = _subsequence_function()


# Words of 64 bits up to which texts are worked on together; longer ones take one big integer each.
BATCH_WORDS = 16
BATCH_PAIRS = 4096


def _batch_function() -> Callable[[list[bytes], list[bytes]], np.ndarray]:
    single, most_words, most_pairs = subsequence_length, BATCH_WORDS, BATCH_PAIRS

    def subsequence_lengths(left: list[bytes], right: list[bytes]) -> np.ndarray:
        """``subsequence_length`` of many pairs at once.

        Pairs whose shorter text fills equally many words form a matrix of bit vectors, one row each,
        and take a step together for each byte of the longer texts. Sorted by these texts' length,
        the rows that still have a byte are the first ones.
        """
        pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right)]
        out = np.zeros(len(pairs), np.int64)
        words = np.array([(len(a) + 63) // 64 for a, _ in pairs], np.int64)
        for w in np.unique(words).tolist():
            chosen = np.flatnonzero(words == w).tolist()
            if w == 0:
                continue
            if w > most_words:
                for i in chosen:
                    out[i] = single(*pairs[i])
                continue
            chosen.sort(key=lambda i: -len(pairs[i][1]))
            per = max(1, most_pairs // w)
            for at in range(0, len(chosen), per):
                part = chosen[at : at + per]
                out[part] = step_through([pairs[i][0] for i in part], [pairs[i][1] for i in part], w)
        return out

    def step_through(short: list[bytes], long: list[bytes], w: int) -> np.ndarray:
        n = len(short)
        size, reach = np.array([len(a) for a in short]), np.array([len(b) for b in long])
        # Where each byte stands in the shorter texts, as bits.
        row = np.repeat(np.arange(n), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        letters = np.frombuffer(b"".join(short), np.uint8).astype(np.int64)
        masks = np.zeros((n * 256, w), np.uint64)
        np.bitwise_or.at(masks, (row * 256 + letters, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        grid = np.zeros((n, int(reach[0])), np.uint8)
        grid[np.arange(grid.shape[1]) < reach[:, None]] = np.frombuffer(b"".join(long), np.uint8)
        grid = np.ascontiguousarray(grid.T)
        active = np.searchsorted(-reach, -np.arange(len(grid)), side="left")
        base = np.arange(n) * 256
        vector = np.full((n, w), np.uint64(0xFFFFFFFFFFFFFFFF))
        for t, live in enumerate(active.tolist()):
            v = vector[:live]
            hit = v & masks[base[:live] + grid[t, :live]]
            rest = v - hit  # the hits are part of the vector, so no word borrows
            added = v + hit
            carry = added < v
            for k in range(1, w):
                more = added[:, k] + carry[:, k - 1]
                carry[:, k] |= more < added[:, k]
                added[:, k] = more
            vector[:live] = added | rest
        # The bits that were cleared within the shorter text.
        inside = np.clip(size[:, None] - 64 * np.arange(w), 0, 64)
        full = np.where(inside == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (inside & 63).astype(np.uint64)) - np.uint64(1))
        return size - np.bitwise_count(vector & full).sum(axis=1).astype(np.int64)

    return subsequence_lengths


subsequence_lengths = _batch_function()


def _subsequence_udf(left: Column, right: Column) -> Column:
    lengths_of = subsequence_lengths

    def lengths(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(lengths_of([x.encode() for x in left], [y.encode() for y in right]))

    return F.pandas_udf(lengths, LongType())(left, right)


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Common subsequence length of the whole whitespace-free texts."""
    return _subsequence_udf(strip_whitespace(a), strip_whitespace(b))


def similarity_fast_path(a: Column | str, b: Column | str) -> Column:
    """The similarity where no subsequence is needed: equal bodies, or one without any text; else null."""
    size_a, size_b = non_whitespace_bytes(a), non_whitespace_bytes(b)
    return F.when(strip_whitespace(a) == strip_whitespace(b), F.lit(1.0)).when(
        (size_a == 0) | (size_b == 0), F.lit(0.0)
    )


def body_similarity(a: Column | str, b: Column | str) -> Column:
    """Similarity of two bodies in [0, 1].

    A UDF inside a CASE runs for every row, so rows settled by the fast path hand it empty texts.
    """
    a, b = column(a), column(b)
    fast = similarity_fast_path(a, b)
    slow_a = F.when(fast.isNull(), a).otherwise(F.lit(""))
    slow_b = F.when(fast.isNull(), b).otherwise(F.lit(""))
    longest = F.greatest(non_whitespace_bytes(a), non_whitespace_bytes(b))
    return F.coalesce(fast, lcs_length(slow_a, slow_b) / F.nullif(longest, F.lit(0)))
