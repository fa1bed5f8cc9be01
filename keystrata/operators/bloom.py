"""Bloom filters as tables of 64-bit words: sizing, building and membership.

A key's bits are hashes of the key and the number of the hash function: the first
15 hexadecimal digits of an MD5 sum, which every SQL engine can compute.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.operators import bitmap


def sizing(counts: DataFrame, n_col: str, fpp: float) -> DataFrame:
    bits = -F.col(n_col) * F.lit(math.log(fpp)) / F.lit(math.log(2) ** 2)
    return counts.withColumns({
        "n_bits": F.floor(bits),
        "n_bytes": 8 * F.ceil(F.floor(bits) / 64),
        "n_hashes": F.ceil(bits / F.col(n_col) * F.lit(math.log(2))),
    })


@dataclass(frozen=True)
class Shape:
    n_bits: int
    n_hashes: int

    @classmethod
    def of(cls, capacity: int, fpp: float) -> Shape:
        if capacity < 1 or not 0 < fpp < 1:
            raise ValueError("a filter needs a capacity above 0 and a rate between 0 and 1")
        bits = -capacity * math.log(fpp) / math.log(2) ** 2
        return cls(int(bits), math.ceil(bits / capacity * math.log(2)))


def bits_of(key: str, shape: Shape):
    """The places of a key's bits."""
    one = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(i)))), 1, 15), 16, 10).cast("long") % shape.n_bits
    return F.array(*[one(i) for i in range(shape.n_hashes)])


def build(keys: DataFrame, key: str, shape: Shape) -> DataFrame:
    """(word, bits) of all keys: words are summed up in each task before they are shuffled.  Null keys are left out."""
    return bitmap.build(keys.where(F.col(key).isNotNull()).select(F.explode(bits_of(key, shape)).alias("place")), "place")


def contains(probes: DataFrame, key: str, filter_words: DataFrame, shape: Shape) -> DataFrame:
    """(key, maybe) of each distinct probe: False is certain."""
    asked = probes.select(key).where(F.col(key).isNotNull()).distinct().select(key, F.explode(F.array_distinct(bits_of(key, shape))).alias("place"))
    return bitmap.is_set(asked, "place", filter_words).groupBy(key).agg(F.bool_and("is_set").alias("maybe"))
