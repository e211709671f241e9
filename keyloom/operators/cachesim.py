"""A sharded cache with least-recently-used eviction, simulated over an ordered log of accesses.

Shards are independent, and a shard's log is cut at sampled places of the order (Buckets), so tasks grow
with the log. What a cut needs of the accesses before it is the cache's content there: with least-recently-used
eviction, the last `capacity` different keys, which one pass finds for each cut by itself and the driver puts
together (capacity keys a cut). A second pass folds each cut from its content on. Other policies have
no such short state: their shards are folded whole.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import Options
from ..session import ship
from .ordered import Buckets


def shard(key: Column, shards: int) -> Column:
    return F.pmod(key, F.lit(shards)).cast("int")


class CachePolicy(ABC):
    """What a shard keeps. Another policy can be given to accesses()."""

    evicted = 0

    @abstractmethod
    def get(self, key):
        """The value, or None."""

    @abstractmethod
    def insert(self, key, value=True):
        """The key that had to go, or None."""

    @abstractmethod
    def erase(self, key) -> bool: ...

    @abstractmethod
    def prune(self) -> None: ...


class LruCache(CachePolicy):
    """Keys and values; an insert of a key that is there replaces its value and makes it the newest."""

    def __init__(self, capacity: int, on_removal: Callable[[object, object], None] | None = None):
        """on_removal(key, value) is called with each entry that leaves, whether evicted, erased, pruned or replaced."""
        self.capacity, self.items, self.evicted, self.on_removal = capacity, OrderedDict(), 0, on_removal

    def _gone(self, key, value) -> None:
        if self.on_removal:
            self.on_removal(key, value)

    def get(self, key):
        if key in self.items:
            self.items.move_to_end(key)
            return self.items[key]
        return None

    def insert(self, key, value=True):
        """The key that had to go, or None."""
        if key in self.items:
            self._gone(key, self.items.pop(key))
        self.items[key] = value
        if len(self.items) > self.capacity:
            self.evicted += 1
            old, was = self.items.popitem(last=False)
            self._gone(old, was)
            return old
        return None

    def erase(self, key) -> bool:
        if key not in self.items:
            return False
        self._gone(key, self.items.pop(key))
        return True

    def prune(self) -> None:
        while self.items:
            self._gone(*self.items.popitem(last=False))


def accesses(log: DataFrame, options: Options = Options(), policy: type[CachePolicy] = LruCache, order: tuple[str, ...] = ("seq",), buckets: Buckets | None = None) -> DataFrame:
    """log (key and the columns of order: integers) with shard, hit (it was cached) and evicted (the key that made room, or null)."""
    columns = [F.col(c).cast("long").alias(c) for c in order]
    own = log.select(*columns, F.col("key").cast("long").alias("key")).withColumn("shard", shard(F.col("key"), options.cache_shards))
    ship(log.sparkSession)
    # equal values of the first column are in one cut
    buckets = buckets or Buckets(own, order[0])
    short = issubclass(policy, LruCache)
    own = own.withColumn("cut", buckets.of(F.col(order[0])) if short else F.lit(0))
    starts: dict[tuple[int, int], list[int]] = {}
    if short and buckets.bounds:
        seen = own.groupBy("shard", "cut", "key").agg(F.max(F.struct(*order)).alias("last"))
        newest = Window.partitionBy("shard", "cut").orderBy(F.desc("last"))
        recent = seen.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= options.cache_capacity)
        lists = recent.groupBy("shard", "cut").agg(F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("keys")).orderBy("shard", "cut").collect()
        for s in {r["shard"] for r in lists}:
            content: list[int] = []  # newest first
            for r in (r for r in lists if r["shard"] == s):
                starts[s, r["cut"]] = content[::-1]
                own_keys = [x["key"] for x in r["keys"]]
                content = (own_keys + [k for k in content if k not in set(own_keys)])[: options.cache_capacity]

    ordered = own.repartition("shard", "cut").sortWithinPartitions("shard", "cut", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cache = None, None
        for pdf in batches:
            hits, gone = [], []
            for s, cut, key in zip(pdf["shard"].tolist(), pdf["cut"].tolist(), pdf["key"].tolist()):
                if (s, cut) != at:
                    at, cache = (s, cut), policy(options.cache_capacity)
                    for held in starts.get(at, ()):
                        cache.insert(held)
                hits.append(cache.get(key) is not None)
                gone.append(None if hits[-1] else cache.insert(key))
            yield pdf.drop(columns="cut").assign(hit=hits, evicted=pd.array(gone, dtype="Int64"))

    return ordered.mapInPandas(run, ", ".join(f"{c} long" for c in order) + ", key long, shard int, hit boolean, evicted long")
