import random

import pytest

from keyloom.llm import decontaminate


def distance(p, x):
    """Least edit distance of p to a substring of x."""
    row = [0] * (len(x) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(x, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers():
    r = random.Random(3)
    for _ in range(500):
        p, x = ("".join(r.choice("abc") for _ in range(n)) for n in (r.randint(1, 20), r.randint(0, 60)))
        k, end = decontaminate.myers(decontaminate.masks(p), len(p), x)
        assert k == distance(p, x) and (k == len(p) or distance(p, x[:end]) == k)


def test_matches_equal_brute_force(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(8)] + [(8, None), (9, ""), (10, "short"), (10, "short")]
    docs = [(0, None), (1, ""), (2, "Short!"), (3, "a short text")]
    for i in range(4, 200):
        text = list(r.choice(items[:8])[1])
        for _ in range(r.randint(0, 9)):
            at = r.randrange(len(text))
            text[at : at + r.randint(0, 1)] = r.choice(["", "z", "qq", r.choice("abc")])
        docs.append((i, word() + " " + "".join(text).upper() + ",\n " + word()))
    docs.append((199, docs[-1][1]))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS distance"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id")
    want = []
    for i, t in docs:
        t = decontaminate.normalise(t)
        for j, p in items:
            p = decontaminate.normalise(p)
            budget = int(0.07 * len(p))
            if budget and t and (k := distance(p, t)) <= budget:
                want.append((i, j, k))
            elif p and not budget and f" {p} " in f" {t} ":
                want.append((i, j, 0))
    for block in (1 << 20, 100):
        got = decontaminate.matches(d, b, block_bytes=block).collect()
        assert sorted(tuple(x)[:3] for x in got) == sorted(want)
        text, item = {i: decontaminate.normalise(t) for i, t in docs}, dict(items)
        assert all(distance(decontaminate.normalise(item[x.item_id]), text[x.doc_id][x.match_start : x.match_end]) == x.distance for x in got)
        left = decontaminate.clean(d, b, block_bytes=block)
        assert left.columns == d.columns and sorted(x.doc_id for x in left.collect()) == sorted(i for i, _ in docs if i not in {w[0] for w in want})


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_odd_tables(request, spark, name):
    docs, none = request.getfixturevalue(name), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs, none).collect() == [] and decontaminate.clean(docs, none).count() == docs.count()
    items = spark.createDataFrame([(1, "word " * 20), (2, "x" * 300)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()}
    assert got == ({(7, 1), (8, 2)} if name == "odd" else set())


def test_short_items_are_found_inside_texts_at_word_edges(spark):
    items = [(1, "Cat"), (2, "the cat sat"), (3, "12"), (4, "É?"), (5, "..."), (6, "o")]
    docs = [(1, "My category: cats, concat"), (2, "(Cat)"), (3, "Is the  cat, sat?"), (4, "x12 123 12"), (5, "é"), (6, "née"), (7, "category cat"), (8, "o" * 50000 + " O")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(x) for x in decontaminate.matches(d, b).collect())
    assert got == [(2, 1, 0, 0, 3), (3, 1, 0, 7, 10), (3, 2, 0, 3, 14), (4, 3, 0, 8, 10), (5, 4, 0, 0, 1), (7, 1, 0, 9, 12), (8, 6, 0, 50001, 50002)]
    assert sorted({x.item_id for x in decontaminate.matches(d, b, min_chars=4).collect()}) == [2]


def test_blocks_come_one_at_a_time(spark):
    items = spark.createDataFrame([(i, f"item {i} " * 9) for i in range(40)], "item_id long, text string")
    parts = decontaminate.blocks(items, 500)
    assert iter(parts) is parts
    whole = list(parts)
    assert len(whole) > 2 and sorted(i for part in whole for i, _ in part) == list(range(40))


def test_items_of_few_wide_characters(spark):
    """A sentence of few characters is searched for inside texts; scripts without blanks have an edge everywhere."""
    items = [(1, "今天早上城里很冷但是孩子们去公园散步"), (2, "我的名字是花子です"), (3, "公园")]
    docs = [(1, "他说：今天早上城里很冷但是孩子们去公园散步。然后走了"), (2, "今天早上城里很冷但是孩于们去公园散步"), (3, "x 我的名字是花子です y"), (4, "我的名字是太郎です"), (5, "公园"), (6, "去公园散步")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(x)[:3] for x in decontaminate.matches(d, b).collect()) == [(1, 1, 0), (1, 3, 0), (2, 1, 1), (2, 3, 0), (3, 2, 0), (5, 3, 0), (6, 3, 0)]
    assert sorted(x.doc_id for x in decontaminate.clean(d, b).collect()) == [4]
