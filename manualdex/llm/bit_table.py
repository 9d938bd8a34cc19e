"""A table of bits of fixed size that says which 64-bit keys may be in a set of any size.

A bit that is set wrongly only lets a row through that a later join or count removes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manualdex.llm.grams import U

#: Bits, 16 MB.
SIZE = 1 << 27
#: Bits of a key that has two places, and the factor that gives its second one without passing 63 bits.
KEY_BITS, _SECOND = 40, 0x2545F5


def bit_table(keys: DataFrame, key: Column, twice: bool = False) -> np.ndarray:
    """Bits of all keys; the driver gets ``SIZE / 64`` rows of 64 bits at most.

    ``twice`` sets two bits for each key of ``KEY_BITS`` bits, so that far fewer other keys seem to be there.
    """
    place = key.bitwiseAND(F.lit(SIZE - 1))
    if twice:
        second = F.shiftrightunsigned(key * F.lit(_SECOND), KEY_BITS - 27).bitwiseAND(F.lit(SIZE - 1))
        keys = keys.select(F.explode(F.array(place, second)).alias("place"))
        place = F.col("place")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = (
        keys.select(F.shiftright(place, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    )
    out = np.zeros(SIZE // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def is_set(table: np.ndarray, keys: np.ndarray, twice: bool = False) -> np.ndarray:
    p = keys & U(SIZE - 1)
    out = (table[p >> U(6)] >> (p & U(63))) & U(1) == 1
    if twice:
        at = np.flatnonzero(out)
        p = (keys[at] * U(_SECOND) >> U(KEY_BITS - 27)) & U(SIZE - 1)
        out[at] = (table[p >> U(6)] >> (p & U(63))) & U(1) == 1
    return out
