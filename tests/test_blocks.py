"""Packing over several buckets gives the one layout of the whole table."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from keyloom.operators import blocks
from keyloom.operators.ordered import Buckets
from keyloom.options import Options
from keyloom.plans.catalogue import ORACLE_SQL


@pytest.mark.parametrize("name", ["block_layout", "block_index"])
def test_buckets_against_oracle(spark, name):
    path = "/root/testdata/sf0.01/customer.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    df = spark.read.parquet(path).select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    buckets = Buckets(df, rows=300)
    assert len(buckets.bounds) > 3
    packed = blocks.pack(df, buckets=buckets)
    got = (blocks.layout if name == "block_layout" else blocks.index)(packed).select(*(f"`{c}`" for c in columns))
    assert sorted(map(tuple, got.collect())) == sorted(result.fetchall())


@pytest.mark.parametrize("block_size", [1, 64, 300, 4096, 10**6])
def test_bounds_do_not_change_blocks(spark, block_size):
    r = random.Random(3)
    rows = [("k" * r.randint(0, 3) + str(r.randint(0, 900)), r.choice([None, "", "v" * r.randint(1, 200)])) for _ in range(1200)] + [("", "dropped"), (None, "dropped"), ("long" * 100, "x")]
    df = spark.createDataFrame(rows, "key string, value string").repartition(3)
    options = Options(block_size=block_size)
    ways = [blocks.pack(df, options, Buckets(df, rows=n)) for n in (10**6, 300, 20)]
    one, *others = [sorted(map(str, x.collect())) for x in ways]
    assert len(one) == 1201 and all(x == one for x in others)
