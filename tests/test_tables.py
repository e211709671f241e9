"""Ordered operators over several buckets, block layout, the binary file, and the repaired defects."""

import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from keyloom.operators import blocks, bloom, cachesim, memtable, ordered
from keyloom.options import Options
from keyloom.sources import binary_table, sorted_table

STEM = [("abcdef" + s).encode() for s in ("", "1", "2", "3", "4", "7")]


@pytest.fixture(scope="module")
def kv(spark):
    return spark.createDataFrame([(f"key{i}", f"_value:key{i}_") for i in range(1900)], "key string, value string").repartition(5)


@pytest.mark.parametrize("rows", [100, 10**6])
def test_ordered_operators(spark, kv, rows):
    buckets = ordered.Buckets(kv, rows=rows)
    assert bool(buckets.bounds) == (rows == 100)
    keys = sorted(f"key{i}" for i in range(1900))
    assert keys[:4] == ["key0", "key1", "key10", "key100"] and keys[-1] == "key999"
    assert [(r.key, r.position) for r in ordered.numbered(kv, buckets=buckets).orderBy("position").collect()] == [(k, i + 1) for i, k in enumerate(keys)]
    assert [r.key for r in ordered.numbered(kv, True, buckets).orderBy("position").collect()] == keys[::-1]
    beside = {r.key: r for r in ordered.neighbours(kv, buckets).collect()}
    for i, k in enumerate(keys):
        assert beside[k].next_key == (keys[i + 1] if i + 1 < len(keys) else None) and beside[k].previous_key == (keys[i - 1] if i else None)
        assert beside[k].next_value == (f"_value:{keys[i + 1]}_" if i + 1 < len(keys) else None)
    r = random.Random(1)
    wanted = [f"key{i}" for i in range(0, 1900, 3)] + ["", "key", "zzz", "key1899x", "a"] + ["key" + "".join(r.choice("0123456789") for _ in range(r.randint(1, 5))) for _ in range(300)]
    targets = spark.createDataFrame([(t,) for t in wanted], "target string")
    for name, at in (("seek_ge_batch", lambda t: bisect_left(keys, t)), ("seek_lt_batch", lambda t: bisect_left(keys, t) - 1)):
        got = getattr(ordered, name)(kv, targets, buckets).collect()
        assert len(got) == len(wanted)
        for x in got:
            i = at(x.target)
            assert x.key == (keys[i] if 0 <= i < len(keys) else None) and x.value == (f"_value:{x.key}_" if x.key else None)
    assert {r.target: r.key for r in blocks.two_level_seek(blocks.pack(kv, buckets=buckets), targets).collect()} == {t: (keys[i] if (i := bisect_left(keys, t)) < len(keys) else None) for t in wanted}


def test_empty_tables(spark, kv):
    none = ordered.empty(kv)
    targets = spark.createDataFrame([("a",)], "target string")
    assert ordered.numbered(none).collect() == [] and ordered.neighbours(none).collect() == []
    assert [tuple(r) for r in ordered.seek_ge_batch(none, targets).collect()] == [("a", None, None)]
    assert ordered.seek_first(none).first().key is None and binary_table.pack(none).collect() == []


def test_memtable_first_wins(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 3, "x"), (None, 4, "n")], "key string, seq long, value string")
    assert {(r.key, r.value) for r in memtable.insert_if_absent(rows).collect()} == {("a", "first"), ("b", "x"), (None, "n")}
    found = memtable.contains(rows, spark.createDataFrame([("a",), ("c",), (None,)], "key string")).collect()
    assert {(r.key, r.found) for r in found} == {("a", True), ("c", False), (None, False)}


def test_greedy_layout_of_customers(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    got = blocks.layout(blocks.pack(df)).orderBy("block_id").collect()
    assert [(r.n_entries, r.size) for r in got] == [(285, 4099), (284, 4102), (282, 4101), (284, 4103), (284, 4106), (81, 1186)]


def test_one_block_of_1900(kv):
    block = binary_table.Block(16)
    for key in sorted(f"key{i}" for i in range(1900)):
        block.add(key.encode(), f"_value:{key}_".encode())
    assert len(block.bytes()) == block.size() == 36110 and len(block.restarts) == 119
    assert block.restarts[:4] == [0, 297, 606, 914] and block.restarts[-1] == 35410
    assert [k.decode() for k, _ in binary_table.read_block(block.bytes())] == sorted(f"key{i}" for i in range(1900))
    got = blocks.restart_points(kv).orderBy("restart_id").collect()
    assert [r.offset for r in got] == block.restarts


def test_file_layout():
    data = binary_table.encode([(k, k) for k in STEM], Options(bits_per_key=30))
    opened = binary_table.Table(data)
    assert len(data) == 245 and opened.index == [(STEM[-1], (0, 78))] and len(opened.filter) == 27
    assert list(opened) == [(k, k) for k in STEM] and all(opened.get(k) == k for k in STEM)
    assert opened.get(b"absent") is None and opened.seek(b"abcdef5") == (STEM[-1], STEM[-1]) and opened.seek(b"b") is None
    assert data[-40:].hex()[-16:] == "3349c227952b4504"


def test_last_block_is_reachable_and_none_is_empty():
    """Also where the last pair closes a block."""
    options = Options(block_size=64)
    for n in range(1, 60):
        pairs = [(f"k{i:04}".encode(), b"v" * (i % 9)) for i in range(n)]
        opened = binary_table.Table(binary_table.encode(pairs, options))
        assert list(opened) == pairs and all(opened.seek(k) == (k, v) for k, v in pairs)
        assert all(list(binary_table.read_block(opened.block(*h))) for _, h in opened.index)
    assert list(binary_table.Table(binary_table.encode([]))) == [] and list(binary_table.Table(binary_table.encode([(b"", b"x")]))) == []


def test_binary_search_in_blocks():
    r = random.Random(8)
    for n in (1, 2, 15, 16, 17, 33, 200):
        keys = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 6))).encode() for _ in range(n)})
        block = binary_table.Block(r.choice([1, 3, 16]))
        for k in keys:
            block.add(k, k + b"!")
        for t in [*keys, b"", b"b", b"zz", *(k + b"a" for k in keys)]:
            i = bisect_left(keys, t)
            assert binary_table.seek_block(block.bytes(), t) == ((keys[i], keys[i] + b"!") if i < len(keys) else None)
    assert binary_table.seek_block(binary_table.Block(16).bytes(), b"a") is None


def test_block_scan_through_a_cache():
    pairs = [(f"k{i:04}".encode(), b"v" * 20) for i in range(300)]
    opened, cache = binary_table.Table(binary_table.encode(pairs, Options(block_size=256))), cachesim.LruCache(3)
    read = []
    real = opened.block
    opened.block = lambda *h: read.append(h) or real(*h)
    for _, handle in opened.index[:3] * 2:
        assert list(opened.scan(handle, cache)) == list(opened.scan(handle))
    assert len(opened.index) > 3 and len(read) == 6 + 3


def test_lookup_in_files_of_several_ranges(spark, kv):
    buckets = ordered.Buckets(kv, rows=300)
    wanted = [f"key{i}" for i in range(0, 4000, 7)] + ["", "a", "zzz"]
    targets = spark.createDataFrame([(t,) for t in wanted] + [(None,), ("zzz",)], "target string")
    got = {r.target: r for r in binary_table.lookup(binary_table.pack(kv, buckets=buckets), targets, buckets).collect()}
    assert got.keys() == set(wanted)
    for t in wanted:
        there = t.startswith("key") and int(t[3:]) < 1900
        assert (bytes(got[t].value) == f"_value:{t}_".encode() and got[t].may_match) if there else got[t].value is None
    assert [tuple(r) for r in binary_table.lookup(binary_table.pack(ordered.empty(kv)), targets.limit(1), buckets).collect()] == [("key0", False, None)]


def test_damage_is_found():
    data = binary_table.encode([(k, k) for k in STEM])
    for at in (3, 80, len(data) - 1):
        with pytest.raises(ValueError):
            list(binary_table.Table(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))
    with pytest.raises(ValueError):
        binary_table.Table(b"short")
    with pytest.raises(ValueError):
        list(binary_table.read_block(b"\xff\xff\xff\xff"))


def test_binary_files_round_trip(spark, kv, tmp_path):
    files = binary_table.pack(kv, buckets=ordered.Buckets(kv, rows=300))
    assert files.count() > 3 and sorted(r.key.decode() for r in binary_table.unpack(files).collect()) == sorted(f"key{i}" for i in range(1900))
    for i, r in enumerate(files.collect()):
        (tmp_path / f"{i:06}.sst").write_bytes(bytes(r.content))
    back = binary_table.scan(spark, str(tmp_path)).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, kv.collect()))


def test_sorted_parquet(spark, kv, tmp_path):
    path = str(tmp_path / "table")
    sorted_table.write(kv.union(spark.createDataFrame([("", "dropped")], "key string, value string")), path, files=3)
    back = sorted_table.read(spark, path)
    assert back.count() == 1900 and len(back.inputFiles()) == 3
    ranges = [(min(k), max(k)) for f in back.inputFiles() for k in [[r.key for r in spark.read.parquet(f).collect()]] if k == sorted(k)]
    assert len(ranges) == 3 and all(a[1] < b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:]))
    plan = ordered.range_scan(back, "key10", "key2")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(key,key10)" in plan and "LessThan(key,key2)" in plan


def test_bloom(spark):
    keys = spark.createDataFrame([(k.decode(),) for k in STEM], "key string")
    set_bits, size, k = bloom.build(keys, 30)
    assert (size, k) == (184, 20)
    assert bytes.fromhex(bloom.as_hex(set_bits, size).first()["filter"]) == binary_table.bloom(STEM, 30)
    probes = keys.union(spark.createDataFrame([("hardcore",), ("",), (None,)], "key string"))
    got = {r.key: r.may_match for r in bloom.probe(probes, set_bits, size, k).collect()}
    assert all(got[x.decode()] for x in STEM) and not got[""] and not got[None]
    stored = binary_table.bloom(STEM, 30) + (20).to_bytes(4, "little")
    assert all(binary_table.may_match(x, stored) for x in STEM) and got["hardcore"] == binary_table.may_match(b"hardcore", stored)
    assert binary_table.may_match(b"any", stored[:-4] + (31).to_bytes(4, "little")) and not binary_table.may_match(b"", stored)


def test_filters_of_two_tables_are_apart(spark):
    """Each build starts afresh: no false negatives in a second table."""
    for keys in (STEM, [f"k{i}".encode() for i in range(500)]):
        df = spark.createDataFrame([(k.decode(),) for k in keys], "key string")
        assert all(r.may_match for r in bloom.probe(df, *bloom.build(df, 10)).collect())
