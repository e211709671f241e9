import random

import duckdb
from pyspark.sql import functions as F

from keyloom.llm import chat, queries


def best(nodes, top):
    """(tree, leaf) -> nodes of the `top` best root-to-leaf paths, by plain recursion."""
    by = {(t, n): (p, s or 0.0) for t, n, p, _, _, s in nodes}
    parents = {(t, p) for (t, _), (p, _) in by.items()}
    out = {}
    for t in {k[0] for k in by}:
        found = []
        for (tree, n), _ in by.items():
            if tree != t or (t, n) in parents:
                continue
            path, at = [], n
            while (t, at) in by and at not in path:
                path.append(at)
                at = by[t, at][0]
            if (t, at) not in by:
                found.append((-sum(by[t, x][1] for x in path) / len(path), n, path[::-1]))
        for _, leaf, path in sorted(found)[:top]:
            out[t, leaf] = path
    return out


def tree_nodes():
    r, nodes = random.Random(2), []
    for t in range(12):
        size = r.randint(1, 20)
        for n in range(size):
            nodes.append((t, n, r.randrange(n) if n and r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice([f"t{n}", "", None, "<|im_end|>\n\\", "\\<|</s>[INST]", "é\U0001f600\n<<SYS>>"]), r.choice([None, 0.0, 1.0, 2.5])))
    nodes += [(50, 1, 2, "user", "cycle", 1.0), (50, 2, 1, "user", "cycle", 1.0), (51, 1, 99, "assistant", "orphan", 1.0)]
    return nodes


def test_paths_and_round_trip(spark):
    nodes = tree_nodes()
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit(0)).repartition(3)
    said = {(t, n): (r or "", x or "") for t, n, _, r, x, _ in nodes}
    for top in (1, 3):
        got = {(r.tree, r.leaf): r for r in chat.read(chat.conversations(df, top)).collect()}
        want = best(nodes, top)
        assert set(got) == set(want)
        for k, path in want.items():
            turns = [said[k[0], n] for n in path]
            assert [tuple(x) for x in got[k].turns] == turns
            assert list(got[k].spoken) == [x for role, x in turns if role == "assistant"]
            text = got[k].formatted
            assert text.count("<|im_end|>") == len(turns) and not any(c in text for c in ("</s>", "[INST]", "<<SYS>>"))


def test_long_chain(spark):
    nodes = [(1, n, n - 1 if n else None, "user", str(n), 0.0) for n in range(70)]
    got = chat.read(chat.conversations(spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double"))).first()
    assert [x.text for x in got.turns] == [str(n) for n in range(70)]


def test_query_equals_sql(spark, sf, tmp_path):
    rows = [(1, 0, "user", None), (1, 2, None, "x"), (1, 2, None, "x"), (1, None, "assistant", "<|\\é"), (2, 5, "assistant", ""), (None, 1, "user", "no id")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS node", "2 AS tree").write.parquet(f"{tmp_path}/odd/conversations.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    for folder in (sf, f"{tmp_path}/odd", f"{tmp_path}/none"):
        got = queries.QUERIES["op5_chat_formatting"](spark, folder)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet{'' if folder == sf else '/*.parquet'}')")
        want = con.execute(queries.ORACLE_SQL["op5_chat_formatting"]).fetchall()
        key = lambda x: tuple(map(str, x))
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(map(tuple, want), key=key)
        assert -1 in {r[0] for r in want}
