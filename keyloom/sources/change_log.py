"""The catalogue's change log: appended Parquet batches, and snapshots that replace them.

Each batch claims its number by creating a file beside the log, which only one writer can do; its rows'
seqs lie between those of the batches before and after it, so two writers never share a seq. A rewrite
renames the log aside and the snapshot in its place: readers take the one that is there, and recover(),
which every write begins with, finishes or undoes what a crash left, so the log is never lost. Only one
process may rewrite, and none append meanwhile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest
from .files import Files

SCHEMA = "seq long, id long, level int, op int"
#: Seqs of a batch.
SPAN = 1 << 32


def _claimed(spark: SparkSession, path: str) -> int:
    """The number of a new batch."""
    files, claims = Files(spark), f"{path}.claims"
    files.make_folder(claims)
    while True:
        taken = files.names(claims)
        if taken:
            number = max(map(int, taken)) + 1
        else:
            number = (read(spark, path).agg(F.max("seq").alias("m")).first()["m"] or 0) // SPAN + 1
        if files.create(f"{claims}/{number:010d}"):
            return number


def recover(spark: SparkSession, path: str) -> None:
    """Finishes a rewrite whose snapshot is in place, and undoes one whose isn't."""
    files = Files(spark)
    if files.exists(f"{path}.old"):
        if files.exists(path):
            files.remove_folder(f"{path}.old")
        elif not files.rename(f"{path}.old", path):
            raise OSError(f"cannot bring back {path}.old")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log; of a new folder, an empty one."""
    at = next((x for x in (path, f"{path}.old") if Files(spark).exists(x)), None)
    return spark.read.schema(SCHEMA).parquet(at) if at else spark.createDataFrame([], SCHEMA)


def append(spark: SparkSession, path: str, changes: list[tuple[int, int, int]]) -> None:
    """One batch of (id, level, op), in order."""
    append_frame(spark, path, spark.createDataFrame([(i, *c) for i, c in enumerate(changes)], SCHEMA).coalesce(1))


def append_frame(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """One batch of rows (seq, id, level, op); seq, below SPAN, orders the rows of the batch."""
    recover(spark, path)
    first = _claimed(spark, path) * SPAN
    changes.select((F.lit(first) + F.col("seq")).alias("seq"), "id", "level", "op").write.mode("append").parquet(path)


def add_table(spark: SparkSession, path: str, level: int, table_id: int) -> None:
    append(spark, path, [(table_id, level, manifest.CREATE)])


def rewrite(spark: SparkSession, path: str) -> None:
    """Replaces the log by a snapshot of its state: written beside it, then renamed. Later batches still come after it."""
    fresh, files = f"{path}.rewrite", Files(spark)
    recover(spark, path)
    number = _claimed(spark, path)
    state = manifest.snapshot(read(spark, path))
    state.select(F.lit(number * SPAN).alias("seq"), "id", F.col("level").cast("int").alias("level"), "op").write.mode("overwrite").parquet(fresh)
    if files.exists(path) and not files.rename(path, f"{path}.old"):
        raise OSError(f"cannot rename {path}")
    if not files.rename(fresh, path):
        raise OSError(f"cannot rename {fresh}")
    files.remove_folder(f"{path}.old")


def maintain(spark: SparkSession, path: str, threshold: int = manifest.THRESHOLD, ratio: int = manifest.RATIO) -> bool:
    """Rewrites where enough of the log is dead; whether it did."""
    c = manifest.counters(read(spark, path)).select(manifest.rewrite_due(F.col("creations"), F.col("deletions"), threshold, ratio).alias("due")).first()
    if c["due"]:
        rewrite(spark, path)
    return c["due"]
