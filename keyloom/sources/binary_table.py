"""The binary sorted-table file: blocks with trailers, filter, meta-filter, index and footer.

encode() and decode() work on one file's bytes; pack() makes one file of each key range of a
DataFrame in parallel, and scan() reads files through Spark's binaryFile source. A wrong checksum,
magic number or length raises ValueError, so the task fails.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import CRC_DELTA, CRC_TABLE, HASH_FACTOR, HASH_SEED
from ..operators.bloom import MOST_HASHES, hash_count, size_bits
from ..operators.ordered import Buckets
from ..options import FILTER_NAME, FOOTER, MAGIC, TRAILER, Options
from ..session import ship

_M = 0xFFFFFFFF


def crc32c(data: bytes) -> int:
    crc = _M
    for b in data:
        crc = crc >> 8 ^ CRC_TABLE[(crc ^ b) & 255]
    return crc ^ _M


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + CRC_DELTA) & _M


def hash32(data: bytes) -> int:
    if not data:
        return 0
    h = HASH_SEED ^ (len(data) * HASH_FACTOR & _M)
    body = len(data) // 4 * 4
    for (word,) in struct.iter_unpack("<I", data[:body]):
        h = (h + word) * HASH_FACTOR & _M
        h ^= h >> 16
    if tail := data[body:]:
        h = (h + int.from_bytes(tail, "little")) * HASH_FACTOR & _M
        h ^= h >> 24
    return h


def bloom(keys: list[bytes], bits_per_key: int) -> bytes:
    size, k = size_bits(len(keys), bits_per_key), hash_count(bits_per_key)
    out = bytearray(size // 8)
    for key in keys:
        h = hash32(key)
        delta = (h >> 17 | h << 15) & _M
        for j in range(k):
            bit = (h + j * delta & _M) % size
            out[bit // 8] |= 1 << bit % 8
    return bytes(out)


def may_match(key: bytes, data: bytes) -> bool:
    """Probe of a stored filter: its bytes, then the hash count (one beyond the limit matches all)."""
    if not key or len(data) <= 4:
        return False
    (k,) = struct.unpack("<I", data[-4:])
    if k > MOST_HASHES:
        return True
    size, h = (len(data) - 4) * 8, hash32(key)
    delta = (h >> 17 | h << 15) & _M
    return all(data[b // 8] >> b % 8 & 1 for j in range(k) for b in [(h + j * delta & _M) % size])


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a varint is cut off")
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


class Block:
    """Entries with shared prefixes, whole at every `interval`th."""

    def __init__(self, interval: int):
        self.interval, self.data, self.restarts, self.n, self.last = interval, bytearray(), [0], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % self.interval:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        elif self.n:
            self.restarts.append(len(self.data))
        self.data += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.n, self.last = self.n + 1, key

    def size(self) -> int:
        return len(self.data) + 4 * len(self.restarts) + 4

    def bytes(self) -> bytes:
        return bytes(self.data) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))


def restarts_of(data: bytes) -> tuple[tuple[int, ...], int]:
    """A block's restarts, and where its entries end."""
    if len(data) < 4:
        raise ValueError("a block is too short")
    (n,) = struct.unpack("<I", data[-4:])
    end = len(data) - 4 - 4 * n
    if end < 0:
        raise ValueError("a block has too many restarts")
    return struct.unpack(f"<{n}I", data[end:-4]), end


def read_block(data: bytes, start: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """The entries of a block, from a restart on."""
    at, end, key = start, restarts_of(data)[1], b""
    while at < end:
        shared, at = read_varint(data, at)
        rest, at = read_varint(data, at)
        size, at = read_varint(data, at)
        if shared > len(key) or at + rest + size > end:
            raise ValueError("an entry leaves its block")
        key = key[:shared] + data[at : at + rest]
        yield key, data[at + rest : at + rest + size]
        at += rest + size


def seek_block(data: bytes, target: bytes) -> tuple[bytes, bytes] | None:
    """The first entry not below target: the last restart with a lesser key by binary search, then on from there."""
    restarts, _ = restarts_of(data)
    first = lambda at: next(read_block(data, at), (b"",))[0]
    before = bisect_left(restarts, target, key=first)
    start = restarts[max(before - 1, 0)] if restarts else 0
    return next((entry for entry in read_block(data, start) if entry[0] >= target), None)


def shortest(start: bytes, limit: bytes) -> bytes:
    for i, (a, b) in enumerate(zip(start, limit)):
        if a != b:
            return start[:i] + bytes([a + 1]) if a + 1 < b else start
    return start


def encode(pairs: Iterable[tuple[bytes, bytes]], options: Options = Options()) -> bytes:
    """A file of sorted pairs; pairs with an empty key are dropped."""
    out, handles = bytearray(), []

    def put(data: bytes, tag: int) -> tuple[int, int]:
        at = len(out)
        out.extend(data + bytes([tag]) + struct.pack("<I", masked(crc32c(data + bytes([tag])))))
        return at, len(data)

    block, index, keys, waiting = Block(options.restart_interval), Block(1), [], None
    for key, value in pairs:
        if not key:
            continue
        if waiting:
            index.add(shortest(waiting[0], key), struct.pack("<QQ", *waiting[1]))
            waiting = None
        keys.append(key)
        block.add(key, value)
        if block.size() >= options.block_size:
            waiting = (key, put(block.bytes(), options.compression_tag))
            handles.append(waiting[1])
            block = Block(options.restart_interval)
    if block.n:
        waiting = (block.last, put(block.bytes(), options.compression_tag))
    meta = Block(options.restart_interval)
    if keys:
        stored = put(bloom(keys, options.bits_per_key) + struct.pack("<I", hash_count(options.bits_per_key)), 0)
        meta.add(FILTER_NAME.encode(), struct.pack("<QQ", *stored))
    meta_at = put(meta.bytes(), options.compression_tag)
    if waiting:
        index.add(waiting[0], struct.pack("<QQ", *waiting[1]))
    index_at = put(index.bytes(), options.compression_tag)
    return bytes(out) + struct.pack("<QQQQ", *meta_at, *index_at) + struct.pack("<II", MAGIC & _M, MAGIC >> 32)


class Table:
    """An opened file: footer, index and filter."""

    def __init__(self, data: bytes):
        if len(data) < FOOTER or struct.unpack("<II", data[-8:]) != (MAGIC & _M, MAGIC >> 32):
            raise ValueError("not a table file")
        self.data = data
        meta_at, meta_n, index_at, index_n = struct.unpack("<QQQQ", data[-FOOTER:-8])
        self.index = [(k, struct.unpack("<QQ", v)) for k, v in read_block(self.block(index_at, index_n))]
        filters = {k.decode(): struct.unpack("<QQ", v) for k, v in read_block(self.block(meta_at, meta_n))}
        self.filter = self.block(*filters[FILTER_NAME]) if FILTER_NAME in filters else None

    def block(self, at: int, size: int) -> bytes:
        raw = self.data[at : at + size + TRAILER]
        if len(raw) < size + TRAILER or struct.unpack("<I", raw[-4:])[0] != masked(crc32c(raw[:-4])):
            raise ValueError(f"checksum of the block at {at}")
        return raw[:size]

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, handle in self.index:
            yield from read_block(self.block(*handle))

    def scan(self, handle: tuple[int, int], cache=None) -> Iterator[tuple[bytes, bytes]]:
        """The entries of the block at a handle (offset, length); a cache (CachePolicy) keeps blocks whose checksum is tested."""
        data = cache.get(handle) if cache else None
        if data is None:
            data = self.block(*handle)
            if cache:
                cache.insert(handle, data)
        return read_block(data)

    def seek(self, target: bytes) -> tuple[bytes, bytes] | None:
        """The first entry not below target: binary searches in the index and in the block."""
        for _, handle in self.index[bisect_left(self.index, target, key=lambda x: x[0]) :]:
            if found := seek_block(self.block(*handle), target):
                return found
        return None

    def get(self, key: bytes) -> bytes | None:
        """The value of a key; the filter spares most reads of absent ones."""
        if self.filter is not None and not may_match(key, self.filter):
            return None
        found = self.seek(key)
        return found[1] if found and found[0] == key else None


def files_of(df: DataFrame, options: Options = Options()) -> DataFrame:
    """table_id, entries, content: one file of the entries (key, value) of each table_id; files are packed in parallel."""
    ship(df.sparkSession)
    own = df.select(F.col("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"), F.col("table_id").cast("int").alias("table_id"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(zip(map(bytes, pdf["key"]), map(bytes, pdf["value"])))
        return pd.DataFrame({"table_id": [pdf["table_id"].iat[0]], "entries": [len(pairs)], "content": [encode(pairs, options)]})

    return own.filter(F.octet_length("key") > 0).groupBy("table_id").applyInPandas(fold, "table_id int, entries long, content binary")


def pack(df: DataFrame, options: Options = Options(), buckets: Buckets | None = None) -> DataFrame:
    """One file of each key range."""
    buckets = buckets or Buckets(df)
    return files_of(df.select("key", "value", buckets.of(F.col("key")).alias("table_id")), options)


def lookup(files: DataFrame, targets: DataFrame, buckets: Buckets) -> DataFrame:
    """target (distinct), may_match (by the stored filter) and value (null: absent): each target goes to the file of its range, whose filter spares most reads of absent keys."""
    own = targets.select(F.col("target").cast("string").alias("target")).distinct().withColumn("table_id", buckets.of(F.col("target")))
    ship(files.sparkSession)

    def find(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        opened = Table(bytes(held["content"].iat[0])) if len(held) else None
        keys = [t.encode() for t in wanted["target"]]
        matched = [opened is not None and opened.filter is not None and may_match(k, opened.filter) for k in keys]
        values = [opened.get(k) if m else None for k, m in zip(keys, matched)]
        return pd.DataFrame({"target": wanted["target"], "may_match": matched, "value": values})

    grouped = files.select("table_id", "content").groupBy("table_id").cogroup(own.filter(F.col("target").isNotNull()).groupBy("table_id"))
    return grouped.applyInPandas(find, "target string, may_match boolean, value binary")


def verified(files: DataFrame) -> DataFrame:
    """table_id and damage: what is wrong with a file, or null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for content in pdf["content"]:
                try:
                    for _ in Table(bytes(content)):
                        pass
                    found.append(None)
                except ValueError as e:
                    found.append(str(e))
            yield pd.DataFrame({"table_id": pdf["table_id"], "damage": pd.array(found, dtype="string")})

    ship(files.sparkSession)
    return files.select("table_id", "content").mapInPandas(run, "table_id int, damage string")


def unpack(files: DataFrame) -> DataFrame:
    """key, value (binary) of files with a column content, checksums tested."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(list(Table(bytes(content))), columns=["key", "value"])

    ship(files.sparkSession)
    return files.select("content").mapInPandas(run, "key binary, value binary")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """key, value of the table files under path."""
    return unpack(spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path))
