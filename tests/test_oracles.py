"""Every registered query against its SQL oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(rows):
    def value(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(map(value, r)) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_oracle(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    assert plain(got) == plain(want)
    assert got or name in ("seek_ge",) or not want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["target", "key", "value"] and df.count() > 0
