"""Sorted tables as range-partitioned Parquet with Bloom filters on the key.

A write is one range shuffle: files hold disjoint key ranges, sorted inside, so min/max statistics
work as the block index and row groups as blocks. Empty keys are dropped, as the format has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite", page_checksums: bool = True, row_group_bytes: int = 32 << 20) -> None:
    kept = df.select("key", "value").filter(F.octet_length("key") > 0)
    ranged = kept.repartitionByRange(files, "key") if files else kept.repartitionByRange("key")
    (
        ranged.sortWithinPartitions("key")
        .write.mode(mode)
        .option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.page.write-checksum.enabled", str(page_checksums).lower())
        .option("parquet.block.size", str(row_group_bytes))
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, value; filters on key reach statistics and Bloom filters."""
    return spark.read.parquet(path).select("key", "value")


def stats(df: DataFrame) -> DataFrame:
    """entries, key_bytes, value_bytes."""
    size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long").alias(f"{c}_bytes")
    return df.agg(F.count("*").alias("entries"), size("key"), size("value"))
