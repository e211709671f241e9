"""Byte strings as arrays of numbers, checksums and the 32-bit hash.

Unsigned 32-bit values are longs in [0, 2^32). Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
#: The reflected Castagnoli polynomial, and the constant that masks stored checksums.
CASTAGNOLI, CRC_DELTA = 0x82F63B78, 0xA282EAD8
#: Seed and multiplier of the hash.
HASH_SEED, HASH_FACTOR = 0xBC9F1D34, 0xC6A4A793


def _crc_table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (CASTAGNOLI if value & 1 else 0)
        out.append(value)
    return out


CRC_TABLE = _crc_table()


def let(value: Column, make) -> Column:
    """make(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def as_bytes(x: Column) -> Column:
    """The bytes of a string (UTF-8) or binary, as array<bigint>."""
    return F.transform(F.regexp_extract_all(F.hex(x), F.lit(".."), F.lit(0)), lambda b: F.conv(b, 16, 10).cast("long"))


def from_bytes(numbers: Column) -> Column:
    """Binary of an array of numbers in 0..255."""
    return F.unhex(F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def mul32(a: Column, factor: int) -> Column:
    """a * factor mod 2^32, by 16-bit halves: ANSI mode raises where a long overflows."""
    low = a.bitwiseAND(0xFFFF) * F.lit(factor)
    high = (F.shiftright(a, 16) * F.lit(factor)).bitwiseAND(0xFFFF)
    return (low + F.shiftleft(high, 16)).bitwiseAND(MASK32)


def rotr32(a: Column, n: int) -> Column:
    return F.shiftright(a, n).bitwiseOR(F.shiftleft(a, 32 - n)).bitwiseAND(MASK32)


def crc32c(x: Column, start: Column | int = 0) -> Column:
    """CRC-32C of a string or binary; `start` continues an earlier one."""
    table = F.array(*(F.lit(v).cast("long") for v in CRC_TABLE))
    first = (start if isinstance(start, Column) else F.lit(start)).cast("long").bitwiseXOR(F.lit(MASK32))

    def step(crc, b):
        return F.shiftright(crc, 8).bitwiseXOR(F.get(table, crc.bitwiseXOR(b).bitwiseAND(255).cast("int")))

    return F.aggregate(as_bytes(x), first, step, lambda crc: crc.bitwiseXOR(F.lit(MASK32)))


def crc_mask(crc: Column) -> Column:
    return (rotr32(crc, 15) + F.lit(CRC_DELTA)).bitwiseAND(MASK32)


def crc_unmask(masked: Column) -> Column:
    return rotr32((masked + F.lit((1 << 32) - CRC_DELTA)).bitwiseAND(MASK32), 17)


def hash32(x: Column) -> Column:
    """The key hash: four bytes at a time, little-endian; the empty string gives 0."""

    def words(b):
        """The numbers to take in: (value, shift, whole word)."""
        whole = F.floor(F.size(b) / 4).cast("int")
        byte = lambda i: F.get(b, i)
        word = lambda w: byte(4 * w) + F.shiftleft(byte(4 * w + 1), 8) + F.shiftleft(byte(4 * w + 2), 16) + F.shiftleft(byte(4 * w + 3), 24)
        left = F.slice(b, 4 * whole + 1, 3)
        tail = F.coalesce(F.get(left, 0), F.lit(0)) + F.shiftleft(F.coalesce(F.get(left, 1), F.lit(0)), 8) + F.shiftleft(F.coalesce(F.get(left, 2), F.lit(0)), 16)
        body = F.transform(F.filter(F.sequence(F.lit(0), whole), lambda w: w < whole), lambda w: F.struct(word(w).alias("v"), F.lit(16).alias("shift")))
        return F.when(F.size(left) > 0, F.array_append(body, F.struct(tail.alias("v"), F.lit(24).alias("shift")))).otherwise(body)

    def step(h, w):
        def end(p):
            return p.bitwiseXOR(F.when(w["shift"] == 16, F.shiftright(p, 16)).otherwise(F.shiftright(p, 24)))

        return let(mul32((h + w["v"]).bitwiseAND(MASK32), HASH_FACTOR), end)

    def whole(b):
        seed = F.lit(HASH_SEED).cast("long").bitwiseXOR(mul32(F.size(b).cast("long"), HASH_FACTOR))
        return F.when(F.size(b) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(words(b), seed, step))

    return let(as_bytes(x), whole)
