"""Bloom filters with Kirsch-Mitzenmacher double hashing: sizing, bits, probes and prefiltered lookups."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import MASK32, hash32, let, rotr32
from ..options import FILTER_NAME

#: Ln 2 as the filter format rounds it, limits of the hash count, least bits.
LN2, LEAST_HASHES, MOST_HASHES, LEAST_BITS = 0.69314718056, 1, 30, 64


def bits_per_key(rate: Column) -> Column:
    """For a false-positive rate."""
    return F.ceil(-F.log(rate) / (LN2 * LN2)).cast("int")


def hashes(bits: Column) -> Column:
    return F.greatest(F.lit(LEAST_HASHES), F.least(F.lit(MOST_HASHES), (bits * LN2).cast("int")))


def hash_count(bits: int) -> int:
    return min(MOST_HASHES, max(LEAST_HASHES, int(bits * LN2)))


def size_bits(keys: int, bits: int) -> int:
    """Bits of a filter, in whole bytes."""
    return -(-max(LEAST_BITS, keys * bits) // 8) * 8


def positions(key: Column, size: int, k: int) -> Column:
    """The k bits of a key."""
    return let(hash32(key), lambda h: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (h + j * rotr32(h, 17)).bitwiseAND(MASK32) % size))


def build(keys: DataFrame, bits: int, column: str = "key") -> tuple[DataFrame, int, int]:
    """The set bits (column bit) of a filter of the distinct keys, its size in bits and hash count. A fresh one for each table."""
    distinct = keys.select(F.col(column).alias("key")).filter(F.octet_length("key") > 0).distinct()
    size, k = size_bits(distinct.count(), bits), hash_count(bits)
    return distinct.select(F.explode(positions(F.col("key"), size, k)).alias("bit")).distinct(), size, k


def as_hex(set_bits: DataFrame, size: int) -> DataFrame:
    """filter: the filter's bytes as one hex string (of one table's filter, which is of bounded size)."""
    by_byte = set_bits.groupBy(F.floor(F.col("bit") / 8).alias("byte")).agg(F.sum(F.expr("shiftleft(1, cast(bit % 8 AS int))")).alias("value"))
    return by_byte.agg(F.map_from_entries(F.collect_list(F.struct("byte", "value"))).alias("m")).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size // 8 - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0).cast("long"))), 2, "0")), "").alias("filter"))


def probe(probes: DataFrame, set_bits: DataFrame, size: int, k: int, column: str = "key") -> DataFrame:
    """probes with may_match: all bits of the key are set (an empty or null key: false). A join on bits, so no filter has to fit in a task."""
    if k > MOST_HASHES:
        return probes.withColumn("may_match", F.lit(True))
    keys = probes.select(F.col(column).alias("probe_key")).filter(F.octet_length("probe_key") > 0).distinct()
    needed = keys.select("probe_key", F.explode(F.array_distinct(positions(F.col("probe_key"), size, k))).alias("bit"))
    missing = needed.join(set_bits, "bit", "left_anti").select("probe_key").distinct()
    fine = keys.join(missing, "probe_key", "left_anti").withColumn("hit", F.lit(True))
    return probes.join(fine, probes[column] == fine["probe_key"], "left").withColumn("may_match", F.coalesce("hit", F.lit(False))).drop("probe_key", "hit")


def prefiltered_semi_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Rows of left whose key right holds. Right's distinct keys are broadcast if they are small; else both sides
    are shuffled, and Spark's runtime filter (a Bloom filter of right's keys, pushed to left's scan) drops most others before."""
    keys = right.select(F.col(right_on).alias("key")).filter(F.col(right_on).isNotNull()).distinct()
    return left.join(keys, left[left_on] == keys["key"], "left_semi")


class FilterPolicy(ABC):
    """A filter of a table's keys, stored under its name: it may match keys that are not there, and matches all that are."""

    name: str

    @abstractmethod
    def build(self, keys: DataFrame): ...

    @abstractmethod
    def probe(self, probes: DataFrame, built, column: str = "key") -> DataFrame:
        """probes with may_match."""


class BloomPolicy(FilterPolicy):
    name = FILTER_NAME

    def __init__(self, bits: int):
        self.bits = bits

    @classmethod
    def of_rate(cls, rate: float) -> BloomPolicy:
        return cls(math.ceil(-math.log(rate) / (LN2 * LN2)))

    def build(self, keys: DataFrame):
        return build(keys, self.bits)

    def probe(self, probes: DataFrame, built, column: str = "key") -> DataFrame:
        return probe(probes, *built, column)
