"""Block layout of sorted tables: prefix sharing, restarts, greedy packing, index and two-level seeks.

The whole table is packed as one sequence: packing is a fold in key order, run per range of keys
(Buckets of ordered.py) and in parallel. With several ranges a pass before it tells for each range
where its blocks end for every place at which its first block can start (_summary); the driver follows
one range after the other (_states), so that each fold starts with the block that the range before
left open. Entries of one key go by their values' bytes. Bounds do not change the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import separator, shared_length, varint_length
from ..options import TRAILER, Options
from ..session import ship, written
from .ordered import Buckets, seek_ge_batch, walked


#: Restarts that one task sums up.
SPAN = 1 << 20


def entries(df: DataFrame, options: Options = Options()) -> DataFrame:
    """key, value, restart_id, shared, non_shared, entry_size: each entry as one long block would encode it."""
    placed = walked(df)
    at = F.col("position") - 1
    first = at % options.restart_interval == 0
    shared = F.when(first | F.col("previous_key").isNull(), 0).otherwise(shared_length(F.col("previous_key"), F.col("key")))
    sized = placed.withColumns({"restart_id": F.floor(at / options.restart_interval), "shared": shared}).withColumn("non_shared", F.octet_length("key") - F.col("shared"))
    size = varint_length(F.col("shared")) + varint_length(F.col("non_shared")) + varint_length(F.octet_length("value")) + F.col("non_shared") + F.octet_length("value")
    return sized.select("key", "value", "position", "restart_id", "shared", "non_shared", size.alias("entry_size"))


def restart_points(df: DataFrame, options: Options = Options()) -> DataFrame:
    """restart_id, key, offset: where entries with whole keys start in one long block."""
    sizes = entries(df, options).groupBy("restart_id").agg(F.min("key").alias("key"), F.sum("entry_size").alias("bytes"))
    spans = sizes.withColumn("span", F.floor(F.col("restart_id") / SPAN))
    # a running sum inside each span, and what all spans before it hold: one row a span
    before, total = [], 0
    for r in spans.groupBy("span").agg(F.sum("bytes").alias("bytes")).orderBy("span").collect():
        before.append((r["span"], total))
        total += r["bytes"]
    earlier = F.broadcast(df.sparkSession.createDataFrame(before, "span long, before long"))
    inside = F.coalesce(F.sum("bytes").over(Window.partitionBy("span").orderBy("restart_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spans.withColumn("inside", inside).join(earlier, "span").select("restart_id", "key", (F.col("inside") + F.col("before")).cast("long").alias("offset"))


def prefix_rebuilt(df: DataFrame, options: Options = Options()) -> DataFrame:
    """key and rebuilt: each key put together again from its restart's whole key and the suffixes after it."""
    cut = entries(df, options).select("key", "restart_id", "position", "shared", F.substring(F.col("key").cast("binary"), F.col("shared") + 1, F.col("non_shared")).alias("suffix"))
    runs = cut.groupBy("restart_id").agg(F.sort_array(F.collect_list(F.struct("position", "key", "shared", "suffix"))).alias("run"))  # 16 entries at most
    start = F.struct(F.array().cast("array<struct<key:string,rebuilt:string>>").alias("out"), F.lit(b"").alias("last"))

    def step(s, e):
        whole = F.concat(F.substring(s["last"], F.lit(1), e["shared"]), e["suffix"])
        return F.struct(F.array_append(s["out"], F.struct(e["key"].cast("string").alias("key"), whole.cast("string").alias("rebuilt"))).alias("out"), whole.alias("last"))

    return runs.select(F.inline(F.aggregate("run", start, step, lambda s: s["out"])))


def _varint(n: int) -> int:
    return max(1, -(-n.bit_length() // 7))


def _bytes(x) -> bytes:
    return b"" if x is None else x.encode() if isinstance(x, str) else bytes(x)


def _shared(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _size(key: int, value: int, shared: int) -> int:
    """Bytes of an entry, given the lengths of its key, value and shared prefix."""
    return _varint(shared) + _varint(key - shared) + _varint(value) + key - shared + value


def _sorted(pdf: pd.DataFrame) -> tuple[list[int], list[bytes], list[int]]:
    """The order of the rows, and their keys and lengths of values in it."""
    keys, values = [_bytes(k) for k in pdf["key"]], [_bytes(v) for v in pdf["value"]]
    order = sorted(range(len(keys)), key=lambda i: (keys[i], values[i]))
    return order, [keys[i] for i in order], [len(values[i]) for i in order]


#: A block with nothing in it: its restart count and first restart.
EMPTY = 4 + 4
_SUMMARY = "bucket int, rows long, first binary, value long, last binary, whole array<long>, cut array<long>, blocks array<long>, bytes array<long>, n array<long>, size array<long>"


def _summary(pdf: pd.DataFrame, options: Options) -> pd.DataFrame:
    """One row of a range: sizes of its head's entries, with whole and with cut keys, and for a block that starts at each of them (or right after) how many blocks close from there on, their bytes in the file, and entries and size of the block left open.

    The head is as long as a block open before it can reach: it grows with block_size, not with rows.
    """
    _, keys, values = _sorted(pdf)
    rows, every = len(keys), options.restart_interval
    whole = np.array([_size(len(k), v, 0) for k, v in zip(keys, values)], dtype=np.int64)
    # the first entry's cut size depends on the range before: the driver knows it
    cut = np.array([0] + [_size(len(b), v, _shared(a, b)) for a, b, v in zip(keys, keys[1:], values[1:])], dtype=np.int64)
    head = min(int(np.searchsorted(np.cumsum(cut), options.block_size)) + 1, rows)
    after, closed = np.empty(rows, dtype=np.int64), np.empty(rows, dtype=np.int64)
    for r in range(min(every, rows)):
        # bytes before each entry, where restarts are at r, r + every, ...
        step = cut.copy()
        step[r::every] = whole[r::every] + 4
        upto = np.concatenate([[0], np.cumsum(step)])
        starts = np.arange(r, rows, every)
        end = np.maximum(np.searchsorted(upto, upto[starts] + options.block_size - 4), starts + 1)  # entries up to the one that closes the block
        after[starts] = end
        closed[starts] = upto[np.minimum(end, rows)] - upto[starts] + 4
    # from the end: a block that stays open, one that closes with the last entry, and those before
    blocks, total, n, size = (np.zeros(rows + 1, dtype=np.int64) for _ in range(4))
    size[rows] = EMPTY
    for i in range(rows - 1, -1, -1):
        at = after[i]
        if at > rows:
            n[i], size[i] = rows - i, closed[i]
        else:
            blocks[i], total[i], n[i], size[i] = blocks[at] + 1, total[at] + closed[i] + TRAILER, n[at], size[at]
    ends = {k: [x[: head + 1].tolist()] for k, x in (("blocks", blocks), ("bytes", total), ("n", n), ("size", size))}
    return pd.DataFrame({"bucket": [pdf["bucket"].iat[0]], "rows": [rows], "first": [keys[0]], "value": [values[0]], "last": [keys[-1]], "whole": [whole[:head].tolist()], "cut": [cut[:head].tolist()], **ends})


def _states(summaries: list, options: Options) -> dict[int, tuple[int, int, int, int, bytes]]:
    """By bucket: block_id, offset, entries, size and last key of the block that is open where the bucket starts."""
    out, state = {}, (0, 0, 0, EMPTY, b"")
    for r in summaries:
        block, offset, n, size, last = out[r["bucket"]] = state
        start = 0
        while n and start < r["rows"]:
            if n % options.restart_interval == 0:
                size += 4 + r["whole"][start]
            elif start:
                size += r["cut"][start]
            else:
                size += _size(len(r["first"]), r["value"], _shared(last, r["first"]))
            start, n = start + 1, n + 1
            if size >= options.block_size:
                block, offset, n, size = block + 1, offset + size + TRAILER, 0, EMPTY
        if not n:
            block, offset, n, size = block + r["blocks"][start], offset + r["bytes"][start], r["n"][start], r["size"][start]
        state = (block, offset, n, size, bytes(r["last"]))
    return out


def pack(df: DataFrame, options: Options = Options(), buckets: Buckets | None = None) -> DataFrame:
    """key, value, block_id, offset of the block in the file, and size of the block when the entry was added: a block closes at block_size or above."""
    buckets = buckets or Buckets(df)
    kinds = {f.name: f.dataType.simpleString() for f in df.select("key", "value").schema}
    ship(df.sparkSession)
    own = df.select("key", "value").withColumn("bucket", buckets.of(F.col("key"))).filter(F.octet_length("key") > 0)
    states = {}
    if buckets.bounds:
        states = _states(own.groupBy("bucket").applyInPandas(lambda pdf: _summary(pdf, options), _SUMMARY).orderBy("bucket").collect(), options)  # one row a bucket

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        order, keys, values = _sorted(pdf)
        block, offset, n, size, last = states.get(int(pdf["bucket"].iat[0]), (0, 0, 0, EMPTY, b""))
        out = []
        for key, length in zip(keys, values):
            shared = 0
            if n % options.restart_interval:
                shared = _shared(last, key)
            elif n:
                size += 4
            size += _size(len(key), length, shared)
            out.append((block, offset, size))
            n, last = n + 1, key
            if size >= options.block_size:
                block, offset, n, size, last = block + 1, offset + size + TRAILER, 0, EMPTY, b""
        packed = pdf.iloc[order][["key", "value"]].copy()
        packed["block_id"] = [b for b, _, _ in out]
        packed["offset"] = [o for _, o, _ in out]
        packed["size"] = [s for _, _, s in out]
        return packed

    return own.groupBy("bucket").applyInPandas(fold, f"key {kinds['key']}, value {kinds['value']}, block_id long, offset long, size long")


def _blocks(packed: DataFrame) -> DataFrame:
    return packed.groupBy("block_id").agg(F.count("*").alias("n_entries"), F.max("size").alias("size"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min("offset").alias("offset"))


def layout(packed: DataFrame, options: Options = Options()) -> DataFrame:
    """block_id, n_entries, n_restarts, size, first_key, last_key."""
    return _blocks(packed).select("block_id", "n_entries", F.ceil(F.col("n_entries") / options.restart_interval).alias("n_restarts"), "size", "first_key", "last_key")


def first_entries(packed: DataFrame) -> DataFrame:
    """block_id, key, value of each block's first entry: a look at what blocks hold."""
    return packed.groupBy("block_id").agg(F.min(F.struct("key", "value")).alias("x")).select("block_id", "x.key", "x.value")


def index(packed: DataFrame) -> DataFrame:
    """block_id, sep_key, offset, length: the separator is not below the block's keys and below the next block's."""
    # each block also tells the one before where it starts: no window over all blocks
    own = F.struct(F.col("block_id").alias("id"), F.struct("size", "last_key", "offset").alias("own"), F.lit(None).cast(packed.schema["key"].dataType).alias("limit"))
    told = F.struct((F.col("block_id") - 1).alias("id"), F.lit(None).cast(f"struct<size:bigint,last_key:{packed.schema['key'].dataType.simpleString()},offset:bigint>").alias("own"), F.col("first_key").alias("limit"))
    both = _blocks(packed).select(F.inline(F.array(own, told))).groupBy("id").agg(F.max("own").alias("own"), F.max("limit").alias("limit")).filter(F.col("own").isNotNull())
    return both.select(F.col("id").alias("block_id"), separator(F.col("own.last_key"), F.col("limit")).cast("string").alias("sep_key"), F.col("own.offset").alias("offset"), F.col("own.size").alias("length"))


def two_level_seek(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """target, key, value: the index finds the block, whose entries then give the first key not below the target."""
    packed = written(packed, "packed")  # read by the index, for its bounds and by the join
    blocks = index(packed).select(F.col("sep_key").alias("key"), F.col("block_id").alias("value"))
    placed = seek_ge_batch(blocks, targets).select("target", F.col("value").alias("block_id")).distinct()
    inside = placed.join(packed, "block_id").filter(F.col("key") >= F.col("target")).groupBy("target").agg(F.min("key").alias("key"), F.min_by("value", "key").alias("value"))
    return targets.select("target").join(inside, "target", "left")
