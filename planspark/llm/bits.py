"""Bit sets of fixed size built from distributed rows: a cheap test in every task for what may matter later.

A test never misses a member; a false hit only lets a row through that a later exact step drops. The size is the same for
every input, so what is sent to the tasks has a fixed bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 26  # 8 MB


class BitSet:
    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash (64 bits, the lower ones count) may be a member."""
        at = hashes.view(np.uint64) & np.uint64(64 * len(self.words) - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bit_set(rows: DataFrame, hashes: Column, bits: int = BITS) -> BitSet:
    """The set of a column of 64-bit hashes; at most ``bits / 64`` words reach the driver."""
    at = hashes.bitwiseAND(F.lit(bits - 1))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    found = rows.select(at.alias("at")).filter("at IS NOT NULL").select(F.shiftright("at", 6).alias("word"), one.alias("bit"))
    words = np.zeros(bits // 64, np.uint64)
    table = found.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow().to_pandas()
    words[table["word"].to_numpy(np.int64)] = table["bit"].to_numpy(np.int64).view(np.uint64)
    return BitSet(words)
