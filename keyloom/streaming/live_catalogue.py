"""The catalogue kept up to date from a stream of changes: an extension of the batch replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.change_log import SCHEMA


def changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def latest(stream: DataFrame) -> DataFrame:
    """id, level, op: the last change of each id so far (state: one row an id)."""
    return stream.groupBy("id").agg(F.max_by(F.struct("level", "op"), "seq").alias("last")).select("id", F.col("last.level").alias("level"), F.col("last.op").alias("op"))


def run(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps `latest` of all changes available now in the in-memory table `name`."""
    return latest(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
