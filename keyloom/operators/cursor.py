"""A cursor over an ordered table, for callers that walk it from the driver.

Each move is one query that Spark answers with a top-1 per partition, and pushes its bound to the
scan; to read many entries use range_scan() or walk(), which streams partitions in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered


class Cursor:
    """Not valid before the first move and past either end; then key and value are None."""

    def __init__(self, df: DataFrame, cache: bool = False):
        self._df = df.select("key", "value")
        self._cleanups: list[Callable[[], None]] = []
        self._row = None
        if cache:
            self._df = self._df.persist()
            self.register_cleanup(self._df.unpersist)

    def register_cleanup(self, run: Callable[[], None]) -> None:
        self._cleanups.append(run)

    def close(self) -> None:
        while self._cleanups:
            self._cleanups.pop(0)()

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _move(self, found: DataFrame) -> bool:
        self._row = found.first()
        return self.valid

    @property
    def valid(self) -> bool:
        return self._row is not None

    @property
    def key(self):
        return self._row["key"] if self._row else None

    @property
    def value(self):
        return self._row["value"] if self._row else None

    def seek(self, target) -> bool:
        return self._move(ordered.seek_ge(self._df, target))

    def seek_first(self) -> bool:
        return self._move(self._df.filter(F.col("key").isNotNull()).orderBy("key").limit(1))

    def seek_last(self) -> bool:
        return self._move(self._df.filter(F.col("key").isNotNull()).orderBy(F.desc("key")).limit(1))

    def next(self) -> bool:
        return self.valid and self._move(self._df.filter(F.col("key") > self.key).orderBy("key").limit(1))

    def previous(self) -> bool:
        return self.valid and self._move(ordered.seek_lt(self._df, self.key))

    def walk(self, low=None, high=None, descending: bool = False) -> Iterator[tuple]:
        """Entries in order, a partition at a time."""
        order = F.desc("key") if descending else F.asc("key")
        yield from map(tuple, ordered.range_scan(self._df, low, high).orderBy(order).toLocalIterator())
