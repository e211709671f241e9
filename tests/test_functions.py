"""Golden vectors and round trips of the scalar functions."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import bytes as B
from keyloom.functions import codecs as C
from keyloom.operators import bloom
from keyloom.sources import binary_table as T

GOLDEN = {  # text: (crc32c, hash32)
    "a": (0xC1D04330, 0x286E9DB0), "ab": (0xE2A22936, 0x39ACA330), "abc": (0x364B3FB7, 0x855D012F), "abcd": (0x92C80A31, 0xB9C83353), "abcde": (0xC450D697, 0x41D2C26D),
    "abcdef": (0x53BCEFF1, 0x919EB3E1), "abcdefg": (0xE627F441, 0x8E0B1532), "abcdefgh": (0x0A9421B7, 0xB2CE35DD), "key0": (0xBC306124, 0xF4CF3B96),
    "key1899": (0x4E78C1DA, 0x54EC8BA3), "é": (0x1BAB8DDC, 0xEF2E8EA0), "hardcore": (0x123A8C05, 0x1252F552), "": (0, 0),
}


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_checksum_and_hash(spark):
    texts = [*GOLDEN, "123456789", None]
    assert column(spark, texts, "string", B.crc32c) == [c for c, _ in GOLDEN.values()] + [0xE3069283, None]
    assert column(spark, list(GOLDEN), "string", B.hash32) == [h for _, h in GOLDEN.values()]
    assert [(T.crc32c(t.encode()), T.hash32(t.encode())) for t in GOLDEN] == list(GOLDEN.values())
    assert column(spark, [0xE3069283], "long", B.crc_mask) == [0xC78AB0E5]
    numbers = [0, 1, 0xFFFFFFFF, 0xE3069283, 123456789]
    assert column(spark, numbers, "long", lambda x: B.crc_unmask(B.crc_mask(x))) == numbers


def test_checksum_continues(spark):
    assert column(spark, ["123456789"], "string", lambda x: B.crc32c(F.substring(x, 5, 9), B.crc32c(F.substring(x, 1, 4)))) == [0xE3069283]


def test_expressions_equal_plain_code_on_random_bytes(spark):
    r = random.Random(1)
    data = [bytes(r.randrange(256) for _ in range(n)) for n in range(40)]
    assert column(spark, data, "binary", B.crc32c) == [T.crc32c(x) for x in data]
    assert column(spark, data, "binary", B.hash32) == [T.hash32(x) for x in data]


def test_integer_codecs(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**32 - 1, 2**35, 2**62, 2**63 - 1]
    assert column(spark, [305419896], "long", lambda x: F.hex(C.fixed_encode(x, 4))) == ["78563412"]
    assert column(spark, [127, 128, 300, 2**32 - 1], "long", lambda x: F.hex(C.varint_encode(x))) == ["7F", "8001", "AC02", "FFFFFFFF0F"]
    assert [bytes(x) for x in column(spark, numbers, "long", C.varint_encode)] == [T.varint(n) for n in numbers]
    assert column(spark, numbers, "long", lambda x: C.varint_decode(C.varint_encode(x))) == numbers
    assert column(spark, numbers, "long", C.varint_length) == [len(T.varint(n)) for n in numbers]
    assert column(spark, numbers, "long", lambda x: C.fixed_decode(C.fixed_encode(x, 8))) == numbers
    assert column(spark, [b"", b"\x80", b"\xff" * 11, b"\x01rest"], "binary", C.varint_decode) == [None, None, None, 1]


def test_length_prefixed(spark):
    texts = ["", "a", "é" * 100, "x" * 300]
    assert column(spark, texts, "string", lambda x: C.length_prefixed_decode(C.length_prefixed(x)).cast("string")) == texts
    assert column(spark, [b"\x05abcd", b""], "binary", C.length_prefixed_decode) == [None, None]


def test_next_pow2(spark):
    assert column(spark, [0, 1, 2, 3, 4, 5, 1023, 1024, 1025, 2**40 + 1], "long", C.next_pow2) == [0, 1, 2, 4, 4, 8, 1024, 1024, 2048, 2**41]


def test_split(spark):
    cases = {"": [], "a,b": ["a", "b"], "a,,": ["a", ""], ",": [""], ",a": ["", "a"], "a": ["a"]}
    assert column(spark, list(cases), "string", lambda x: C.split_fields(x, ",")) == list(cases.values())
    assert column(spark, ["a.b|c"], "string", lambda x: C.split_fields(x, ".")) == [["a", "b|c"]]


SEPARATORS = [("abc1", "abf", "abd"), ("abc", "abd", "abc"), ("abc", "abcd", "abc"), ("key10", "key2", "key10"), ("abcd", "zz", "b"), ("abc", "", "abc"), ("abc", None, "abc")]


def test_separator(spark):
    rows = spark.createDataFrame(SEPARATORS, "a string, b string, want string")
    assert all(r.got == r.want for r in rows.select("want", C.separator(F.col("a"), F.col("b")).cast("string").alias("got")).collect())


@given(st.binary(max_size=6), st.binary(max_size=6))
def test_shortest_lies_between(a, b):
    a, b = sorted((a, b))
    if a < b:
        assert a <= T.shortest(a, b) < b and len(T.shortest(a, b)) <= len(a)


def test_separator_equals_plain_code(spark):
    r = random.Random(2)
    pairs = [tuple(sorted(bytes(r.choice(b"\x00ab\x7f\x80\xff") for _ in range(r.randint(1, 5))) for _ in range(2))) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a binary, b binary").select("a", "b", C.separator(F.col("a"), F.col("b")).alias("s"), C.shared_length(F.col("a"), F.col("b")).alias("n")).collect()
    for x in rows:
        assert bytes(x.s) == T.shortest(bytes(x.a), bytes(x.b))
        assert x.n == next((i for i, (p, q) in enumerate(zip(x.a, x.b)) if p != q), min(len(x.a), len(x.b)))


@pytest.mark.parametrize("rate, bits, k", [(0.1, 5, 3), (0.05, 7, 4), (0.01, 10, 6), (0.001, 15, 10)])
def test_bloom_sizing(spark, rate, bits, k):
    got = spark.range(1).select(bloom.bits_per_key(F.lit(rate)).alias("b")).withColumn("k", bloom.hashes(F.col("b"))).first()
    assert (got.b, got.k) == (bits, k) and bloom.hash_count(bits) == k


def test_compare_is_by_bytes(spark):
    rows = spark.createDataFrame([("a", "a\0b"), ("\x7f", "é"), ("z", "é"), ("key10", "key2"), ("x", "x")], "a string, b string")
    assert [r[0] for r in rows.select(C.compare(F.col("a"), F.col("b"))).collect()] == [-1, -1, -1, -1, 0]
