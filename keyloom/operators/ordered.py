"""Seeks, cursors and scans in key order, without a task that holds all rows.

A global order is cut into buckets at sampled keys (Buckets); windows run inside the buckets, and
what a bucket needs of the others (rows before it, the nearest key after or before it) comes from
one summary row a bucket, at most MOST of them. Small tables have one bucket.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, MOST, SAMPLE = 1_000_000, 4096, 64


class Buckets:
    """Ranges of keys with about `rows` rows each."""

    def __init__(self, df: DataFrame, key: str = "key", rows: int = ROWS, most: int = MOST):
        n = self.rows = df.count()
        count = min(most, n // rows + 1)
        self.bounds: list = []
        if count > 1:
            sample = sorted(r[0] for r in df.select(key).filter(F.col(key).isNotNull()).sample(min(1.0, SAMPLE * count / n), seed=7).collect())
            self.bounds = sorted({sample[i * len(sample) // count] for i in range(1, count)}) if sample else []

    def of(self, key: Column) -> Column:
        """The bucket: how many bounds are not above the key, by binary search."""
        if not self.bounds:
            return F.lit(0)
        bounds = F.array(*map(F.lit, self.bounds))
        start = F.struct(F.lit(0).alias("a"), F.lit(len(self.bounds)).alias("b"))

        def step(s, _):
            middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
            right = F.get(bounds, middle) <= key
            return F.when(s["a"] >= s["b"], s).otherwise(F.struct(F.when(right, middle + 1).otherwise(s["a"]).alias("a"), F.when(right, s["b"]).otherwise(middle).alias("b")))

        rounds = len(self.bounds).bit_length() + 1
        return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["a"]), F.lit(0))

    def index(self, key) -> int:
        return bisect_right(self.bounds, key)


def _summaries(df: DataFrame) -> list:
    """One row a bucket: rows, first and last key and value."""
    entry = F.struct("key", "value")
    return df.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by(entry, "key").alias("first"), F.max_by(entry, "key").alias("last")).orderBy("bucket").collect()


def _kv(df: DataFrame) -> DataFrame:
    return df.select("key", "value")


def walked(df: DataFrame, buckets: Buckets | None = None) -> DataFrame:
    """key, value, position (from 1, in key order) and the entries beside each: next_key, next_value, previous_key, previous_value (null past the ends). One sort."""
    buckets = buckets or Buckets(df)
    own = _kv(df).withColumn("bucket", buckets.of(F.col("key")))
    w = Window.partitionBy("bucket").orderBy("key")
    entry = F.struct("key", "value")
    beside = own.withColumns({"position": F.row_number().over(w).cast("long"), "after": F.lead(entry).over(w), "before": F.lag(entry).over(w)})
    if buckets.bounds:
        rows, edges, seen = _summaries(own), [], 0
        for i, r in enumerate(rows):
            edges.append((r["bucket"], seen, rows[i + 1]["first"] if i + 1 < len(rows) else None, rows[i - 1]["last"] if i else None))
            seen += r["n"]
        kind = own.select(entry.alias("x")).schema["x"].dataType.simpleString()
        beside = beside.join(F.broadcast(df.sparkSession.createDataFrame(edges, f"bucket int, earlier long, edge_after {kind}, edge_before {kind}")), "bucket")
        beside = beside.withColumns({"position": F.col("position") + F.col("earlier"), "after": F.coalesce("after", "edge_after"), "before": F.coalesce("before", "edge_before")})
    return beside.select("key", "value", "position", F.col("after.key").alias("next_key"), F.col("after.value").alias("next_value"), F.col("before.key").alias("previous_key"), F.col("before.value").alias("previous_value"))


def numbered(df: DataFrame, descending: bool = False, buckets: Buckets | None = None) -> DataFrame:
    """key, value, position (from 1) in key order, or in reverse."""
    buckets = buckets or Buckets(df)
    position = F.lit(buckets.rows + 1) - F.col("position") if descending else F.col("position")
    return walked(df, buckets).select("key", "value", position.cast("long").alias("position"))


def neighbours(df: DataFrame, buckets: Buckets | None = None) -> DataFrame:
    """key, value, next_key, next_value, previous_key, previous_value."""
    return walked(df, buckets).drop("position")


def seek_ge(df: DataFrame, target) -> DataFrame:
    """The first entry whose key is not below target (no row past the end)."""
    return _kv(df).filter(F.col("key") >= target).orderBy("key").limit(1)


def seek_lt(df: DataFrame, target) -> DataFrame:
    """The last entry whose key is below target."""
    return _kv(df).filter(F.col("key") < target).orderBy(F.desc("key")).limit(1)


def seek_first(df: DataFrame) -> DataFrame:
    return df.agg(F.min("key").alias("key"), F.min_by("value", "key").alias("value"))


def seek_last(df: DataFrame) -> DataFrame:
    return df.agg(F.max("key").alias("key"), F.max_by("value", "key").alias("value"))


def _seek_batch(df: DataFrame, targets: DataFrame, forward: bool, buckets: Buckets | None) -> DataFrame:
    buckets = buckets or Buckets(df)
    kind = df.select(F.struct("key", "value").alias("x")).schema["x"].dataType.simpleString()
    entries = _kv(df).select(F.col("key").alias("at"), F.struct("key", "value").alias("entry"))
    wanted = targets.select("target").distinct()
    both = entries.unionByName(wanted.select(F.col("target").alias("at"), F.lit(None).cast(kind).alias("entry"))).withColumn("bucket", buckets.of(F.col("at")))
    # a target meets an entry of its own key when it looks forward (>=), and not when it looks back (<); frames
    # that end at the current row take linear time, those that start there do not: forward is backward in reverse
    is_target = F.col("entry").isNull().cast("int")
    order = (F.desc("at"), F.asc(is_target)) if forward else (F.asc("at"), F.desc(is_target))
    w = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last("entry", ignorenulls=True).over(w)
    hits = both.withColumn("found", found).filter(is_target == 1)
    if buckets.bounds:
        rows = {r["bucket"]: r for r in _summaries(_kv(df).withColumn("bucket", buckets.of(F.col("key"))))}
        order = sorted(rows)
        edges = []
        for b in range(len(buckets.bounds) + 1):
            beyond = [x for x in order if x > b] if forward else [x for x in order if x < b][::-1]
            edges.append((b, rows[beyond[0]]["first" if forward else "last"] if beyond else None))
        hits = hits.join(F.broadcast(df.sparkSession.createDataFrame(edges, f"bucket int, edge {kind}")), "bucket").withColumn("found", F.coalesce("found", "edge"))
    hits = hits.select(F.col("at").alias("target"), F.col("found.key").alias("key"), F.col("found.value").alias("value"))
    return targets.select("target").join(hits, "target", "left")


def seek_ge_batch(df: DataFrame, targets: DataFrame, buckets: Buckets | None = None) -> DataFrame:
    """For each row of targets (target): the first entry not below it; key and value are null past the end."""
    return _seek_batch(df, targets, True, buckets)


def seek_lt_batch(df: DataFrame, targets: DataFrame, buckets: Buckets | None = None) -> DataFrame:
    """For each row of targets (target): the last entry below it, or nulls."""
    return _seek_batch(df, targets, False, buckets)


def range_scan(df: DataFrame, low=None, high=None) -> DataFrame:
    """Entries with low <= key < high; the bounds reach the scan."""
    out = _kv(df)
    if low is not None:
        out = out.filter(F.col("key") >= low)
    return out if high is None else out.filter(F.col("key") < high)


def empty(df: DataFrame) -> DataFrame:
    return _kv(df).filter(F.lit(False))
