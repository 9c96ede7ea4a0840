"""A table of bits that says which keys may be among a chosen set, sent to every task in place of a join."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sieve has 2 to this power bits at most (128 MB), else about 64 for each chosen key, which are counted.
SIEVE_BITS = 30


@dataclass(frozen=True)
class Sieve:
    """Bits set for chosen 64-bit keys. It never denies one; the fuller it is, the more others it lets through."""

    words: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(6)) & np.uint64(len(self.words) - 1)
        return (self.words[slot.astype(np.int64)] >> (keys & np.uint64(63))) & np.uint64(1) > 0


def sieve_of(chosen: DataFrame, bits: int = SIEVE_BITS) -> Sieve:
    """A sieve of the column ``key`` of a written table. What comes to the driver is words of bits, 2^(bits - 6) rows at
    most, whatever the table."""
    size = 1 << min(bits - 6, max(1, chosen.count().bit_length()))
    slot = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(size - 1).cast("long"))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    rows = chosen.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("word")).toArrow()
    words = np.zeros(size, np.uint64)
    words[rows.column("slot").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
    return Sieve(words)
