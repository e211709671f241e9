"""Catalogue, cache and sketch, with a regression test for each behaviour that must not return."""

import random

from pyspark.sql import functions as F

from keyloom.operators import cachesim, manifest, ordered, sketch
from keyloom.options import Options
from keyloom.sources import change_log
from keyloom.sources.files import Files
from keyloom.streaming import live_catalogue

LOG = "seq long, id long, level int, op int"


def test_replay(spark):
    changes = [(1, 1, 0, 0), (2, 2, 3, 0), (3, 9, 0, 1), (4, 1, 2, 0), (5, 3, 3, 0), (6, 2, 3, 1), (7, 4, 0, 0)]
    log = spark.createDataFrame(changes, LOG).repartition(3)
    # 1 moved and is at one level; deleting the unknown 9 stops nothing; 2 is gone; level 0 of an empty catalogue works
    assert {tuple(r) for r in manifest.replay(log).collect()} == {(1, 2), (3, 3), (4, 0)}
    assert {(r.level, r.n_tables, r.ids) for r in manifest.levels(manifest.replay(log)).collect()} == {(0, 1, "4"), (2, 1, "1"), (3, 1, "3")}
    assert tuple(manifest.counters(log).first()) == (5, 1)
    snap = manifest.snapshot(log)
    assert snap.count() == 3 and {tuple(r) for r in manifest.replay(snap).collect()} == {(1, 2), (3, 3), (4, 0)}
    none = log.filter("false")
    assert manifest.replay(none).collect() == [] and tuple(manifest.counters(none).first()) == (0, 0)


def test_reconcile(spark):
    state = spark.createDataFrame([(1, 0), (2, 0)], "id long, level int")
    disk = spark.createDataFrame([(2,), (3,), (3,)], "id long")
    assert [r.id for r in manifest.missing(state, disk).collect()] == [1] and [r.id for r in manifest.orphans(state, disk).collect()] == [3]


def test_change_size(spark):
    assert manifest.encoded_size(spark.createDataFrame([(0, 1111, 1, 0)], LOG)).first().bytes == len(bytes.fromhex("01d7080100"))


def test_log_files(spark, tmp_path):
    path = str(tmp_path / "log")
    assert change_log.read(spark, path).collect() == []
    change_log.add_table(spark, path, 1, 1111)
    change_log.append(spark, path, [(2, 0, 0), (1111, 1, 1), (3, 0, 0)])
    change_log.append(spark, path, [(2, 5, 0)])
    state = {(2, 5), (3, 0)}
    assert {tuple(r) for r in manifest.replay(change_log.read(spark, path)).collect()} == state
    assert not change_log.maintain(spark, path)
    assert change_log.maintain(spark, path, threshold=0, ratio=0)
    assert change_log.read(spark, path).count() == 2 and {tuple(r) for r in manifest.replay(change_log.read(spark, path)).collect()} == state
    live = live_catalogue.run(live_catalogue.changes(spark, path), "live_catalogue", str(tmp_path / "checkpoint"))
    live.awaitTermination(60)
    assert {(r.id, r.level) for r in spark.table("live_catalogue").filter("op = 0").collect()} == state


def test_a_crash_in_a_rewrite_loses_nothing(spark, tmp_path, monkeypatch):
    """At each step at which it can stop: readers see the state, and the next write mends the folder."""
    state = {(1, 0), (3, 2)}
    seen = lambda path: {tuple(r) for r in manifest.replay(change_log.read(spark, path)).collect()}
    for stop in range(3):
        path = str(tmp_path / f"log{stop}")
        change_log.append(spark, path, [(1, 0, 0), (2, 0, 0), (2, 0, 1), (3, 2, 0)])
        calls = []

        def crash(name, real):
            def run(self, *a):
                calls.append(name)
                if len(calls) > stop:
                    raise KeyboardInterrupt
                return real(self, *a)

            return run

        with monkeypatch.context() as m:
            for name in ("rename", "remove_folder"):
                m.setattr(Files, name, crash(name, getattr(Files, name)))
            try:
                change_log.rewrite(spark, path)
            except KeyboardInterrupt:
                pass
        assert len(calls) == stop + 1 and seen(path) == state
        change_log.append(spark, path, [(3, 4, 0)])
        assert seen(path) == {(1, 0), (3, 4)} and not Files(spark).exists(f"{path}.old")
        change_log.rewrite(spark, path)
        assert seen(path) == {(1, 0), (3, 4)} and change_log.read(spark, path).count() == 2


def test_writers_share_no_seq(spark, tmp_path):
    """A number is claimed once, even by a writer that saw the folder before the other wrote."""
    path, files = str(tmp_path / "log"), Files(spark)
    change_log.append(spark, path, [(1, 0, 0)])
    assert change_log._claimed(spark, path) == 2  # another writer, still busy
    change_log.append(spark, path, [(1, 5, 0), (2, 5, 0)])
    assert not files.create(f"{path}.claims/{3:010d}") and files.names(f"{path}.claims") == [f"{i:010d}" for i in (1, 2, 3)]
    seqs = [r.seq for r in change_log.read(spark, path).orderBy("seq").collect()]
    assert seqs == [1 << 32, 3 << 32, (3 << 32) + 1]
    # a folder written before there were claims
    spark.createDataFrame([(7, 1, 0, 0)], LOG).write.parquet(str(tmp_path / "other"))
    change_log.append(spark, str(tmp_path / "other"), [(1, 3, 0)])
    assert {tuple(r) for r in manifest.replay(change_log.read(spark, str(tmp_path / "other"))).collect()} == {(1, 3)}


def test_batch_codec(spark):
    log = spark.createDataFrame([(0, 1111, 1, 0), (1, 5, 300, 1), (2, 2**40, 0, 0)], LOG)
    batches = manifest.encoded(log, F.lit(0)).collect()
    assert bytes(batches[0].bytes).hex() == "03d708010005ac020180808080802000" + "00"
    assert bytes(manifest.encoded(log.limit(1), F.lit(0)).first().bytes).hex() == "01d7080100"
    back = manifest.decoded(manifest.encoded(log, F.lit(9))).orderBy("at").collect()
    assert [tuple(r) for r in back] == [(9, 0, 1111, 1, 0), (9, 1, 5, 300, 1), (9, 2, 2**40, 0, 0)]
    # cut off inside a number, a change missing, a number too many, nothing; and a batch of no changes
    damaged = [(1, bytes.fromhex("01d7080180")), (2, bytes.fromhex("02d7080100")), (3, bytes.fromhex("01d708010000")), (4, b""), (5, None), (6, b"\0")]
    got = manifest.decoded(spark.createDataFrame(damaged, "batch_id int, bytes binary")).collect()
    assert [(r.batch_id, r["at"]) for r in got] == [(i, None) for i in range(1, 7)]


def test_lru_cache():
    c = cachesim.LruCache(2)
    c.insert("a", 1), c.insert("b", 2), c.insert("a", 3)
    assert c.get("a") == 3 and c.insert("c", 4) == "b" and c.get("b") is None and c.evicted == 1
    assert c.erase("a") and not c.erase("a")
    c.prune()
    assert c.get("c") is None


def test_lru_cache_tells_what_leaves():
    gone = []
    c = cachesim.LruCache(2, lambda *entry: gone.append(entry))
    for k in "abc":
        c.insert(k, k.upper())
    c.insert("c", "D"), c.erase("b"), c.erase("x"), c.prune()
    assert gone == [("a", "A"), ("c", "C"), ("b", "B"), ("c", "D")] and c.evicted == 1


def test_lru_log(spark):
    r = random.Random(1)
    keys = [r.randrange(40) for _ in range(3000)]
    log = spark.createDataFrame(list(enumerate(keys)), "seq long, key long").repartition(7)
    got = {x.seq: x for x in cachesim.accesses(log, Options(cache_capacity=5)).collect()}
    buckets = ordered.Buckets(log, "seq", rows=100)
    assert len(buckets.bounds) > 10
    assert {x.seq: x for x in cachesim.accesses(log, Options(cache_capacity=5), buckets=buckets).collect()} == got
    for seq, key in enumerate(keys):
        same = [s for s in range(seq) if keys[s] == key]
        between = {k for k in keys[same[-1] + 1 : seq] if k % 4 == key % 4} if same else set()
        assert got[seq].hit == (bool(same) and len(between) < 5)


def test_lru_on_events(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    log = e.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id", F.col("user_id").alias("key"))
    hits = cachesim.accesses(log, order=("micros", "event_id")).filter("hit").count()
    assert hits == 2647


def test_sketch(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(str(int(r.paretovariate(1))),) for _ in range(3000)], "key string")
    true = {x.key: x.freq for x in sketch.capped(rows).collect()}
    assert max(true.values()) == 15
    for width in (8, 4096):
        got = {x.key: x.estimate for x in sketch.estimate(sketch.count_min(rows, width), rows, width).collect()}
        assert got.keys() == true.keys() and all(true[k] <= got[k] <= 15 for k in got)
    assert got == true
    halves = {x.key: x.freq for x in sketch.aged(sketch.capped(rows)).collect()}
    assert halves == {k: v // 2 for k, v in true.items()}
