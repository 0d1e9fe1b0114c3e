"""Bloom filters built and probed inside the JVM.

A filter is an array of ``bits / 64`` longs, so its size is fixed by a parameter, whatever the number of
keys: more keys than it was made for only let more pass.  Keys must be well-mixed 64-bit hashes
(``xxhash64`` of whatever the key is); two positions are read off one hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 128 KB.
DEFAULT_BITS = 1 << 20
#: 16 MB: no filter is larger.
MOST_BITS = 1 << 27


def bits_for(keys: int) -> int:
    """A power of two with at least 16 bits a key, between 2**16 and the upper limit."""
    return min(MOST_BITS, 1 << max(16, (16 * max(keys, 1) - 1).bit_length()))


def _positions(hash_: Column, bits: int) -> list[Column]:
    mask = F.lit(bits - 1).cast("bigint")
    return [hash_.bitwiseAND(mask), F.shiftright(hash_, 32).bitwiseAND(mask)]


def build(keys: DataFrame, hash_: Column, bits: int = DEFAULT_BITS) -> DataFrame:
    """The words with a bit in them, ``word INT, bits BIGINT``: at most ``bits / 64`` rows. Null keys add
    nothing. Partial aggregation folds equal words before the shuffle."""
    at = F.explode(F.array(*_positions(hash_, bits)))
    return (
        keys.where(hash_.isNotNull())
        .select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS INT))")).alias("bits"))
    )


def dense(words: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """One row, one column ``bloom ARRAY<BIGINT>`` of exactly ``bits / 64`` longs."""
    return words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("p")).select(_fill(F.col("p"), bits).alias("bloom"))


def _fill(pairs: Column, bits: int) -> Column:
    """Zeros between the words present: runs from one word to the next are concatenated."""
    lead = F.transform(
        pairs,
        lambda x, i: F.concat(
            F.array_repeat(F.lit(0).cast("bigint"), x["word"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at(pairs, i)["word"] + 1)),
            F.array(x["bits"]),
        ),
    )
    tail = F.array_repeat(
        F.lit(0).cast("bigint"),
        F.lit(bits >> 6) - F.when(F.size(pairs) == 0, F.lit(0)).otherwise(F.element_at(pairs, F.greatest(F.size(pairs), F.lit(1)))["word"] + 1),
    )
    return F.concat(F.flatten(lead), tail)


def might_contain(bloom: Column, hash_: Column, bits: int = DEFAULT_BITS) -> Column:
    """False: certainly no such key. True: perhaps. Null for a null key."""

    def hit(at: Column) -> Column:
        word = F.get(bloom, F.shiftright(at, 6).cast("int"))
        return F.expr("1L") == F.call_function("getbit", word, at.bitwiseAND(F.lit(63)).cast("int")).cast("bigint")

    first, second = _positions(hash_, bits)
    return hit(first) & hit(second)


def collect(words: DataFrame, bits: int) -> np.ndarray:
    """The filter as numpy words, for stages that run in Python; at most ``MOST_BITS`` bits reach the driver."""
    out = np.zeros(bits >> 6, np.uint64)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def hits(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes might be in it."""
    mask, x = np.uint64(len(bloom) * 64 - 1), hashes.astype(np.int64)
    out = np.ones(len(x), bool)
    for at in (x.view(np.uint64) & mask, (x >> 32).view(np.uint64) & mask):
        out &= (bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out
