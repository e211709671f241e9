from keyloom.functions.codecs import now_millis
from keyloom.operators import blocks, bloom, cachesim
from keyloom.operators.cursor import Cursor
from keyloom.options import Options
from keyloom.sources.files import Files, log_path, table_path


def test_cursor(spark):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(5)], "key string, value int")
    closed = []
    with Cursor(df, cache=True) as c:
        c.register_cleanup(lambda: closed.append(1))
        assert not c.valid and c.key is None and not c.next() and not c.previous()
        assert c.seek("k1x") and (c.key, c.value) == ("k2", 2)
        assert c.next() and c.key == "k3" and c.previous() and c.previous() and c.key == "k1"
        assert c.seek_last() and c.key == "k4" and not c.next() and not c.valid
        assert c.seek_first() and c.key == "k0" and not c.previous()
        assert not c.seek("zzz") and c.value is None
        assert list(c.walk("k1", "k3")) == [("k1", 1), ("k2", 2)] and [k for k, _ in c.walk(descending=True)] == ["k4", "k3", "k2", "k1", "k0"]
    assert closed == [1]


def test_files(spark, tmp_path):
    files, folder = Files(spark), str(tmp_path / "db")
    assert table_path("db", 7) == "db/000007.sst" and log_path("db") == "db/MANIFEST"
    assert files.size(folder) == -1 and files.make_folder(folder) and files.exists(folder)
    (tmp_path / "db" / "a").write_bytes(b"abc")
    assert files.size(f"{folder}/a") == 3 and files.rename(f"{folder}/a", f"{folder}/b") and not files.rename(f"{folder}/a", f"{folder}/c")
    assert not files.remove(folder) and files.remove(f"{folder}/b") and not files.remove(f"{folder}/b") and files.remove_folder(folder) and not files.exists(folder)


def test_policies(spark):
    class Fifo(cachesim.LruCache):
        def get(self, key):
            return self.items.get(key)

    log = spark.createDataFrame(list(enumerate([0, 4, 0, 8, 0])), "seq long, key long")
    hits = lambda **k: [r.hit for r in cachesim.accesses(log, Options(cache_capacity=2), **k).orderBy("seq").collect()]
    assert hits() == [False, False, True, False, True] and hits(policy=Fifo) == [False, False, True, False, False]
    policy = bloom.BloomPolicy.of_rate(0.01)
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert policy.bits == 10 and all(r.may_match for r in policy.probe(keys, policy.build(keys)).collect())


def test_first_entries_and_clock(spark):
    df = spark.createDataFrame([(f"k{i:03}", "v") for i in range(50)], "key string, value string")
    packed = blocks.pack(df, Options(block_size=64))
    assert {(r.block_id, r.key) for r in blocks.first_entries(packed).collect()} == {(r.block_id, r.first_key) for r in blocks.layout(packed).collect()}
    assert spark.range(1).select(now_millis().alias("t")).first().t > 1_700_000_000_000
