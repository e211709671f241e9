"""The table catalogue: replay of an ordered change log, levels, counters, snapshots and reconciliation.

A log has seq (total order), id, level and op (0 create, 1 delete). The last change of an id wins,
so an id is at one level; deleting an unknown id changes nothing, and the changes after it count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import varint_encode, varint_length, varints

CREATE, DELETE = 0, 1
#: A rewrite needs more deletions than this, and more than this many times the live tables.
THRESHOLD, RATIO = 10_000, 10


def replay(log: DataFrame) -> DataFrame:
    """id, level of the live tables: one aggregate, combined before the shuffle."""
    last = log.groupBy("id").agg(F.max_by(F.struct("op", "level"), "seq").alias("last"))
    return last.filter(F.col("last.op") == CREATE).select("id", F.col("last.level").alias("level"))


def levels(state: DataFrame) -> DataFrame:
    """level, n_tables, ids (sorted, comma-joined)."""
    found = state.groupBy("level").agg(F.count("*").alias("n_tables"), F.array_sort(F.collect_set("id")).alias("ids"))
    return found.select("level", "n_tables", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def lookup(state: DataFrame, ids: DataFrame) -> DataFrame:
    """ids with the level of each (null: not live)."""
    return ids.join(state.select("id", "level"), "id", "left")


def counters(log: DataFrame) -> DataFrame:
    """creations and deletions (deletions of unknown ids too are changes in the log, and don't count)."""
    before = F.lag("op").over(Window.partitionBy("id").orderBy("seq"))
    changes = log.withColumn("before", before)
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return changes.agg(count(F.col("op") == CREATE, "creations"), count((F.col("op") == DELETE) & (F.col("before") == CREATE), "deletions"))


def rewrite_due(creations: Column, deletions: Column, threshold: int = THRESHOLD, ratio: int = RATIO) -> Column:
    return (deletions > threshold) & (deletions > ratio * (creations - deletions))


def snapshot(log: DataFrame) -> DataFrame:
    """A log of creates alone that replays to the same state."""
    return replay(log).select(F.col("id").alias("seq"), "id", "level", F.lit(CREATE).alias("op"))


def encoded_size(log: DataFrame) -> DataFrame:
    """seq and bytes of each change as a batch of its own: count, id, level, op as varints."""
    return log.select("seq", (1 + varint_length(F.col("id")) + varint_length(F.col("level")) + varint_length(F.col("op"))).cast("long").alias("bytes"))


def encoded(log: DataFrame, batch: Column) -> DataFrame:
    """batch_id and bytes of each batch's changes in order of seq: their count, then id, level and op of each, all as varints."""
    one = F.concat(*(varint_encode(F.col(c)) for c in ("id", "level", "op")))
    batches = log.select(batch.alias("batch_id"), "seq", F.hex(one).alias("one")).groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("seq", "one"))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["one"]), "")
    return batches.select("batch_id", F.unhex(F.concat(F.hex(varint_encode(F.size("all"))), body)).alias("bytes"))


def decoded(batches: DataFrame) -> DataFrame:
    """batch_id, at (from 0), id, level and op of encoded batches (batch_id, bytes); of a damaged batch one row with a null `at`."""
    numbers = varints(F.col("bytes"))
    whole = (F.size(numbers) > 0) & (F.size(numbers) == 1 + 3 * F.get(numbers, F.lit(0)))
    found = F.transform(F.sequence(F.lit(0), ((F.size("numbers") - 1) / 3).cast("int") - 1), lambda i: F.struct(i.cast("long").alias("at"), *(F.get("numbers", 3 * i + k + 1).alias(c) for k, c in enumerate(("id", "level", "op")))))
    read = batches.select("batch_id", F.when(whole, numbers).alias("numbers"))
    rows = read.select("batch_id", F.inline_outer(F.when(F.size("numbers") > 1, found)))
    return rows.select("batch_id", "at", "id", F.col("level").cast("int").alias("level"), F.col("op").cast("int").alias("op"))


def missing(state: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Ids of the catalogue that are not on disk; must be empty before a catalogue is used."""
    return state.select("id").join(on_disk.select("id"), "id", "left_anti")


def orphans(state: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Ids on disk that the catalogue doesn't know: files to delete."""
    return on_disk.select("id").distinct().join(state.select("id"), "id", "left_anti")
