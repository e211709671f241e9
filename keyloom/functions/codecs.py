"""Integer codecs, length-prefixed slices and small helpers, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import as_bytes, from_bytes, let


def fixed_encode(value: Column, size: int) -> Column:
    """Little-endian bytes of a non-negative integer; size is 4 or 8."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(size))))


def fixed_decode(data: Column) -> Column:
    """The number of little-endian bytes (below 2^63)."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))  # reverse() of binary would keep UTF-8 sequences together
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("long")


def varint_length(value: Column) -> Column:
    """Bytes of the variable-length form, seven bits in each."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value.cast("long"))) / 7)).cast("int")


def varint_encode(value: Column) -> Column:
    v = value.cast("long")

    def groups(n):
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.expr("0L") + F.call_function("shiftrightunsigned", v, 7 * i).bitwiseAND(127) + F.when(i < n - 1, 128).otherwise(0))

    return from_bytes(let(varint_length(v), groups))


def varint_decode(data: Column, most: int = 10) -> Column:
    """The number at the start of data; null where it is cut off or longer than `most` bytes."""

    def read(b):
        size = F.array_position(F.transform(b, lambda x: x < 128), True).cast("int")
        value = F.aggregate(F.slice(F.zip_with(b, F.sequence(F.lit(0), F.size(b) - 1), lambda x, i: F.call_function("shiftleft", x.bitwiseAND(127), (7 * i).cast("int"))), 1, size), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
        return F.when(size.between(1, most), value)

    return F.when(F.length(data) > 0, let(as_bytes(data), read))


def varints(data: Column) -> Column:
    """All numbers of data, one after the other; null where the last is cut off."""
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"))

    def step(s, x):
        value = s["value"].bitwiseOR(F.call_function("shiftleft", x.bitwiseAND(127).cast("long"), s["shift"]))
        more = x >= 128
        return F.struct(
            F.when(more, s["out"]).otherwise(F.array_append(s["out"], value)).alias("out"),
            F.when(more, value).otherwise(F.lit(0).cast("long")).alias("value"), F.when(more, s["shift"] + 7).otherwise(F.lit(0)).alias("shift"),
        )

    found = F.aggregate(as_bytes(data), start, step, lambda s: F.when(s["shift"] == 0, s["out"]))
    return F.when(F.length(data) > 0, found).when(data.isNotNull(), F.array().cast("array<bigint>"))


def length_prefixed(x: Column) -> Column:
    """varint(bytes) and the bytes."""
    data = x.cast("binary")
    return F.concat(varint_encode(F.octet_length(data)), data)


def length_prefixed_decode(data: Column) -> Column:
    """The slice at the start of data; null where it is cut off."""

    def read(n):
        start = varint_length(n)
        return F.when(F.length(data) >= start + n, F.substring(data, start + 1, n.cast("int")))

    return let(varint_decode(data), read)


def next_pow2(value: Column) -> Column:
    """The least power of two that is not below value (0 for 0)."""
    v = value.cast("long") - 1
    return F.when(value <= 1, value.cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(v)).cast("int")))


def split_fields(x: Column, delimiter: str) -> Column:
    """Fields between single delimiters; '' has none, and one empty field at the end is dropped."""
    parts = F.split(x, re.escape(delimiter), -1)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.when(F.endswith(x, F.lit(delimiter)), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def shared_length(a: Column, b: Column) -> Column:
    """Bytes that a and b have in common at their start."""
    same = F.zip_with(as_bytes(a), as_bytes(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(F.array_position(same, False), lambda p: F.when(p > 0, p - 1).otherwise(F.least(F.octet_length(a), F.octet_length(b)))).cast("int")


def separator(start: Column, limit: Column) -> Column:
    """A short key k with start <= k < limit: cut after the first difference, raised by one, where there is room. Text keys of ASCII; others as binary."""

    def cut(n):
        a = F.conv(F.hex(F.substring(start.cast("binary"), n + 1, F.lit(1))), 16, 10).cast("int")
        b = F.conv(F.hex(F.substring(limit.cast("binary"), n + 1, F.lit(1))), 16, 10).cast("int")
        room = (n < F.least(F.octet_length(start), F.octet_length(limit))) & (a < 255) & (a + 1 < b)
        short = F.concat(F.substring(start.cast("binary"), F.lit(1), n), F.unhex(F.lpad(F.hex(a + 1), 2, "0")))
        return F.when(room, short).otherwise(start.cast("binary"))

    return F.when(limit.isNull() | (F.octet_length(limit) == 0), start.cast("binary")).otherwise(let(shared_length(start, limit), cut))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(F.when(a == b, 0))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def now_millis() -> Column:
    return epoch_millis(F.current_timestamp())


def time_string(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HHmmss")


def sst_file_name(folder: Column | str, number: Column) -> Column:
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return F.concat(folder, F.lit("/"), F.format_string("%06d.sst", number))
