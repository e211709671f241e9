import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import jaccard


def brute(rows, percent=90, width=3):
    """(doc_id, n, component) by comparing all pairs of sets of word tuples."""
    def of(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    found = [(i, of(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    distinct = {}
    for i, s in found:
        distinct.setdefault((i, frozenset(s)), s)
    items = sorted(((i, s) for (i, _), s in distinct.items() if s), key=lambda x: len(x[1]))
    for k, (i, s) in enumerate(items):
        for j, r in items[k + 1 :]:
            if 100 * len(s) < percent * len(r):
                break
            common = len(s & r)
            if 100 * common >= percent * len(s | r) and (a := top(i)) != (b := top(j)):
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), top(i)) for i, s in found)


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = jaccard.link(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect())) == brute(rows)


@pytest.mark.parametrize("name", ["odd", "empty", "documents"])
def test_tables(request, name):
    check(request.getfixturevalue(name))


@pytest.mark.parametrize("short", [3, 64])
def test_families(spark, monkeypatch, short):
    """Copies with edits around the threshold, with a core and without, and lists longer than SHORT."""
    monkeypatch.setattr(jaccard, "SHORT", short)
    r = random.Random(short)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 3)))
    docs, common = [], [word() for _ in range(25)]
    for size in (4, 30, 90, 150):
        base = [word() for _ in range(size)]
        for _ in range(60):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(text))
                text[at : at + r.randint(0, 1)] = [word()] * r.randint(0, 1)
            docs.append(" ".join(text))
    docs += [" ".join(common + [word() for _ in range(r.randint(0, 5))]) for _ in range(40)]
    chain = [word() for _ in range(120)]
    for _ in range(30):
        chain[r.randrange(120)] = word()
        docs.append(" ".join(chain))
    docs += docs[:30] + ["", None, "A  b", "a B\n", "a b"]
    r.shuffle(docs)
    check(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3))


def test_long_lists_near_the_threshold(spark, monkeypatch):
    """Documents of one template that share its shingles and mostly don't link: lists of hundreds, dealt over small cells and salted."""
    monkeypatch.setattr(jaccard, "SHORT", 8)
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    monkeypatch.setattr(jaccard, "HEAVY", 2)
    r = random.Random(12)
    docs = []
    for family in range(3):
        template = [f"t{family}w{i}" for i in range(60)]
        for i in range(120):
            # 2 to 5 edits of one word spoil 3 shingles each: similarities from 0.6 to 0.95
            text = list(template)
            for _ in range(r.randint(1, 4)):
                text[r.randrange(60)] = f"x{r.randrange(40)}"
            docs.append(" ".join(text))
    docs += [docs[5]] * 200
    check(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4))


def test_dealt_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", 4)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}") for i in range(300)] + [(i, "absent") for i in range(3)]
    left = spark.createDataFrame(rows, "id long, key string")
    keyed = left.filter("key <> 'absent'").groupBy("key").count().withColumnRenamed("count", "many")
    many = {r.key: r.many for r in keyed.collect()}
    got = sorted((r.id, r.key, r.many) for r in jaccard.dealt(left, keyed, "key", "id").collect())
    assert got == sorted((i, k, many[k]) for i, k in rows if k in many)
    assert jaccard.dealt(left, keyed.filter("false"), "key", "id").collect() == []


def test_late_pairs_grow_with_what_can_link(spark):
    """20,000 documents of one template, no two of which link, and each with words of its own: no pair is made."""
    levels = np.zeros(jaccard.CELLS, np.uint8)
    base = " ".join(f"w{i}" for i in range(80))
    docs = spark.range(20000).selectExpr("id AS doc_id", f"concat('{base} a', id, ' b', id, ' c', id, ' d', id, ' {base.upper().replace('W', 'V')} e', id, ' f', id, ' g', id, ' h', id, ' i', id) AS text")
    levels, total = jaccard.sketch(docs)
    rows = jaccard.prefixes(docs, levels, total).cache()
    postings = rows.select(F.col("doc_id").alias("id"), "n", "l", F.posexplode("prefix").alias("at", "token"))
    lists = postings.groupBy("token").agg(F.count("*").alias("many"), F.min(F.struct("at", "n", "id", "l")).alias("pivot")).filter("many > 64")
    long = postings.join(lists, "token")
    found = spark.createDataFrame([], "id long, component long")
    assert rows.filter("n > 150").count() == 20000
    assert jaccard.late_pairs(long, found, 90).count() == 0
    rows.unpersist()


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(200, x) for x in range(201, 260)]
    got = {x.id: x.component for x in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges * 60:
        root[a] = root[b] = min(root.get(a, a), root.get(b, b))
    assert got == {k: v for k, v in root.items() if k != v}


def test_wanted_grows_with_cost():
    found = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64))
    rare, common = np.zeros(jaccard.CELLS, np.uint8), np.full(jaccard.CELLS, 9, np.uint8)
    assert jaccard.matches_wanted(found, rare, 1_000_000, 300_000_000, 90) < jaccard.matches_wanted(found, common, 1_000_000, 300_000_000, 90) <= jaccard.MOST


def test_keep_one(odd):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(x.doc_id for x in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11]


def test_parity_bounds_the_difference():
    r = np.random.default_rng(2)
    for n in (1, 60, 64, 65, 500, 1100):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for drop, add in ((0, 0), (n // 10, 0), (0, n // 9 + 1), (n // 2, n)):
            y = np.unique(np.concatenate([x[drop:], r.integers(0, 1 << 63, add).astype(np.uint64)]))
            if len(y):
                assert jaccard.differ(jaccard.parity(x), jaccard.parity(y)) <= len(np.setxor1d(x, y))
        assert jaccard.differ(jaccard.parity(x), jaccard.parity(x)) == 0


def test_query_equals_sql(spark):
    import duckdb

    from keyloom.llm import queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    name = "op10_ngram_jaccard_join"
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf).collect())) == sorted(map(tuple, con.execute(queries.ORACLE_SQL[name]).fetchall()))
