"""The memtable: an ordered set of unique keys; of equal keys the first (least seq) stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_if_absent(df: DataFrame) -> DataFrame:
    """The row of least seq of each key. An aggregate, combined before the shuffle, so a hot key stays cheap."""
    rest = [c for c in df.columns if c != "key"]
    return df.groupBy("key").agg(F.min_by(F.struct(*rest), "seq").alias("row")).select("key", *(F.col("row")[c].alias(c) for c in rest))


def contains(df: DataFrame, probes: DataFrame) -> DataFrame:
    """probes with `found`: whether the table holds its key (false for null)."""
    keys = df.select("key").distinct().withColumn("here", F.lit(True))
    return probes.join(keys, "key", "left").withColumn("found", F.coalesce("here", F.lit(False))).drop("here")
