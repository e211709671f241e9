"""The queries of the engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import codecs as C
from ..operators import blocks, bloom, cachesim, manifest, memtable, ordered, sketch
from ..options import MAGIC, Options
from ..session import scratch, table
from ..sources import binary_table, sorted_table
from ..sources import change_log as change_log_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Tables as key-value pairs.


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.format_string("%012d", "o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.format_string("%012d", "p_partkey").alias("key"), F.col("p_name").alias("value"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_name").alias("target"))
    near = table(spark, sf, "customer").select(F.expr("left(c_name, length(c_name) - 1)").alias("target"))
    more = spark.createDataFrame([("Customer#00000007",), ("zzz",), ("",), ("Customer#000000001",)], "target string")
    return names.union(near).union(more).distinct()


TARGETS_SQL = "(SELECT p_name AS target FROM part UNION SELECT left(c_name, length(c_name) - 1) FROM customer UNION SELECT * FROM (VALUES ('Customer#00000007'), ('zzz'), (''), ('Customer#000000001')) t(target))"
CUSTOMERS_SQL = "(SELECT c_name AS key, c_mktsegment AS value FROM customer)"
ORDERS_SQL = "(SELECT printf('%012d', o_orderkey) AS key, o_orderstatus AS value FROM orders)"


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log made of events: user ids as table ids; clicks delete."""
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), (F.col("event_id") % 7).cast("int").alias("level"), (F.col("event_type") == "click").cast("int").alias("op"))


LOG_SQL = "(SELECT event_id AS seq, user_id AS id, CAST(event_id % 7 AS INTEGER) AS level, CAST(event_type = 'click' AS INTEGER) AS op FROM events)"
STATE_SQL = f"(SELECT id, level FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM {LOG_SQL}) WHERE r = 1 AND op = 0)"


# Memtable.


@query("SELECT key, seq, value FROM (SELECT user_id AS key, event_id AS seq, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def memtable_insert_dedupe(spark, sf):
    return memtable.insert_if_absent(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value")))


@query(f"SELECT row_number() OVER (ORDER BY key) AS position, key FROM {CUSTOMERS_SQL}")
def memtable_sorted(spark, sf):
    return ordered.numbered(customers(spark, sf)).select("position", "key")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey % 2000) AS found FROM orders")
def memtable_contains(spark, sf):
    probes = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 2000).alias("key"))
    return memtable.contains(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), probes).select("o_orderkey", "found")


@query(f"SELECT key, value FROM {CUSTOMERS_SQL} WHERE key >= 'Customer#00000004' ORDER BY key LIMIT 1")
def memtable_seek_ge(spark, sf):
    return ordered.seek_ge(customers(spark, sf), "Customer#00000004")


# Seeks and cursors.


@query(f"SELECT key, value FROM {ORDERS_SQL} WHERE key >= '0000000000995' ORDER BY key LIMIT 1")
def seek_ge(spark, sf):
    return ordered.seek_ge(orders(spark, sf), "0000000000995")


@query(f"SELECT t.target, kv.key, kv.value FROM {TARGETS_SQL} t ASOF LEFT JOIN {CUSTOMERS_SQL} kv ON t.target <= kv.key")
def seek_ge_batch(spark, sf):
    return ordered.seek_ge_batch(customers(spark, sf), targets(spark, sf))


@query(f"SELECT key, value FROM {CUSTOMERS_SQL} WHERE key < 'Customer#00000004' ORDER BY key DESC LIMIT 1")
def seek_lt(spark, sf):
    return ordered.seek_lt(customers(spark, sf), "Customer#00000004")


@query(f"SELECT t.target, kv.key, kv.value FROM {TARGETS_SQL} t ASOF LEFT JOIN {CUSTOMERS_SQL} kv ON t.target > kv.key")
def seek_lt_batch(spark, sf):
    return ordered.seek_lt_batch(customers(spark, sf), targets(spark, sf))


@query(f"SELECT min(key) AS key, arg_min(value, key) AS value FROM {CUSTOMERS_SQL}")
def seek_first(spark, sf):
    return ordered.seek_first(customers(spark, sf))


@query(f"SELECT max(key) AS key, arg_max(value, key) AS value FROM {CUSTOMERS_SQL}")
def seek_last(spark, sf):
    return ordered.seek_last(customers(spark, sf))


@query(f"SELECT key, lead(key) OVER (ORDER BY key) AS next_key, lead(value) OVER (ORDER BY key) AS next_value FROM {CUSTOMERS_SQL}")
def iter_next(spark, sf):
    return ordered.neighbours(customers(spark, sf)).select("key", "next_key", "next_value")


@query(f"SELECT key, lag(key) OVER (ORDER BY key) AS previous_key, lag(value) OVER (ORDER BY key) AS previous_value FROM {CUSTOMERS_SQL}")
def iter_prev(spark, sf):
    return ordered.neighbours(customers(spark, sf)).select("key", "previous_key", "previous_value")


@query(f"SELECT key, value, row_number() OVER (ORDER BY key) AS position FROM {CUSTOMERS_SQL}")
def full_scan_ordered(spark, sf):
    return ordered.numbered(customers(spark, sf))


@query(f"SELECT key, value, row_number() OVER (ORDER BY key DESC) AS position FROM {CUSTOMERS_SQL}")
def full_scan_reverse(spark, sf):
    return ordered.numbered(customers(spark, sf), descending=True)


@query("SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 9000")
def range_scan(spark, sf):
    return ordered.range_scan(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value")), 500, 9000)


@query(f"SELECT key, value FROM {CUSTOMERS_SQL}")
def project_kv(spark, sf):
    return customers(spark, sf)


@query("SELECT c_name, n_name, CASE WHEN c_name < n_name THEN -1 WHEN c_name > n_name THEN 1 ELSE 0 END AS sign FROM customer JOIN nation ON c_nationkey = n_nationkey")
def key_compare(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_name", "n_name", C.compare(F.col("c_name"), F.col("n_name")).alias("sign"))


@query("SELECT r_name, r_name = 'ASIA' AS same FROM region")
def key_equal(spark, sf):
    return table(spark, sf, "region").select("r_name", (F.col("r_name") == "ASIA").alias("same"))


@query("SELECT count(*) AS entries FROM customer WHERE false")
def empty_iterator(spark, sf):
    return ordered.empty(customers(spark, sf)).agg(F.count("*").alias("entries"))


# Block encoding.

_LCP = "(len(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: left({0}, i) = left({1}, i))))"
_ENTRIES = f"""
WITH p AS (SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS pos, lag(key) OVER (ORDER BY key) AS last FROM {CUSTOMERS_SQL}),
e AS (SELECT *, pos // 16 AS restart_id, CASE WHEN pos % 16 = 0 THEN 0 ELSE {_LCP.format('key', 'last')} END AS shared FROM p),
s AS (SELECT *, length(key) - shared AS non_shared, 3 + length(key) - shared + length(value) AS entry_size FROM e)
"""


@query(f"{_ENTRIES} SELECT key, CAST(shared AS INTEGER) AS shared FROM s")
def shared_prefix(spark, sf):
    return blocks.entries(customers(spark, sf)).select("key", F.col("shared").cast("int").alias("shared"))


@query(f"{_ENTRIES} SELECT restart_id, min(key) AS key, CAST(coalesce(sum(sum(entry_size)) OVER (ORDER BY restart_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM s GROUP BY restart_id")
def restart_points(spark, sf):
    return blocks.restart_points(customers(spark, sf))


@query(f"{_ENTRIES} SELECT key, CAST(non_shared AS INTEGER) AS non_shared, CAST(entry_size AS INTEGER) AS entry_size FROM s")
def entry_sizes(spark, sf):
    return blocks.entries(customers(spark, sf)).select("key", F.col("non_shared").cast("int").alias("non_shared"), F.col("entry_size").cast("int").alias("entry_size"))


@query(f"SELECT key, key AS rebuilt FROM {CUSTOMERS_SQL}")
def prefix_roundtrip(spark, sf):
    return blocks.prefix_rebuilt(customers(spark, sf))


#: Greedy packing as a recursion over entries in order: the state is the block, its entries and its bytes.
_PACKED = f"""
WITH RECURSIVE p AS (SELECT key, value, row_number() OVER (ORDER BY key) AS pos, coalesce(lag(key) OVER (ORDER BY key), '') AS last FROM {CUSTOMERS_SQL}),
e AS (SELECT *, {_LCP.format('key', 'last')} AS lcp, length(key) AS k, length(value) AS v FROM p),
w AS (
  SELECT pos, key, CAST(0 AS BIGINT) AS block_id, CAST(1 AS BIGINT) AS n, CAST(8 + 3 + k + v AS BIGINT) AS size FROM e WHERE pos = 1
  UNION ALL
  SELECT e.pos, e.key,
    CASE WHEN w.size >= 4096 THEN w.block_id + 1 ELSE w.block_id END,
    CASE WHEN w.size >= 4096 THEN 1 ELSE w.n + 1 END,
    CASE WHEN w.size >= 4096 THEN 8 + 3 + e.k + e.v WHEN w.n % 16 = 0 THEN w.size + 4 + 3 + e.k + e.v ELSE w.size + 3 + e.k - e.lcp + e.v END
  FROM w JOIN e ON e.pos = w.pos + 1
),
b AS (SELECT block_id, count(*) AS n_entries, max(size) AS size, min(key) AS first_key, max(key) AS last_key FROM w GROUP BY block_id)
"""


@query(f"{_PACKED} SELECT block_id, n_entries, CAST(ceil(n_entries / 16) AS BIGINT) AS n_restarts, size, first_key, last_key FROM b")
def block_layout(spark, sf):
    return blocks.layout(blocks.pack(customers(spark, sf)))


def _separator_sql(start: str, limit: str) -> str:
    lcp = _LCP.format(start, limit)
    at = f"{lcp} + 1"
    return f"""CASE WHEN {limit} IS NOT NULL AND {lcp} < least(length({start}), length({limit})) AND ascii(substr({start}, {at}, 1)) + 1 < ascii(substr({limit}, {at}, 1))
      THEN left({start}, {lcp}) || chr(ascii(substr({start}, {at}, 1)) + 1) ELSE {start} END"""


@query(f"""{_PACKED}, x AS (SELECT *, lead(first_key) OVER (ORDER BY block_id) AS nxt FROM b)
SELECT block_id, {_separator_sql('last_key', 'nxt')} AS sep_key, CAST(coalesce(sum(size + 5) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", size AS length FROM x""")
def block_index(spark, sf):
    return blocks.index(blocks.pack(customers(spark, sf)))


@query(f"SELECT t.target, kv.key, kv.value FROM {TARGETS_SQL} t ASOF LEFT JOIN {CUSTOMERS_SQL} kv ON t.target <= kv.key")
def two_level_seek(spark, sf):
    return blocks.two_level_seek(blocks.pack(customers(spark, sf)), targets(spark, sf))


@query(f"WITH d AS (SELECT DISTINCT p_name AS a FROM part), p AS (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM d) SELECT a AS start_key, b AS limit_key, {_separator_sql('a', 'b')} AS sep_key FROM p")
def separator_keys(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("key")).distinct().withColumn("value", F.lit(None).cast("string"))
    return ordered.neighbours(names).select(F.col("key").alias("start_key"), F.col("next_key").alias("limit_key"), C.separator(F.col("key"), F.col("next_key")).cast("string").alias("sep_key"))


# Tables on disk.


@query("SELECT printf('%012d', p_partkey) AS key, p_name AS value FROM part")
def sst_write_read_roundtrip(spark, sf):
    path = f"{scratch(spark, 'sst')}/table"
    sorted_table.write(parts(spark, sf), path)
    return sorted_table.read(spark, path)


@query("SELECT printf('%012d', p_partkey) AS key, p_name AS value FROM part")
def sst_binary_roundtrip(spark, sf):
    files = binary_table.pack(parts(spark, sf))
    return binary_table.unpack(files).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT count(*) AS entries, CAST(sum(12) AS BIGINT) AS key_bytes, CAST(sum(strlen(p_name)) AS BIGINT) AS value_bytes FROM part")
def table_stats(spark, sf):
    return sorted_table.stats(parts(spark, sf))


@query("SELECT s_suppkey, printf('db/%06d.sst', s_suppkey) AS name FROM supplier")
def sst_file_name(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", C.sst_file_name("db", F.col("s_suppkey")).alias("name"))


@query(f"{_PACKED} SELECT block_id, first_key AS key, value FROM b JOIN {CUSTOMERS_SQL} c ON c.key = first_key")
def block_first_entries(spark, sf):
    return blocks.first_entries(blocks.pack(customers(spark, sf)))


@query(f"SELECT t.target, kv.value FROM {TARGETS_SQL} t LEFT JOIN {CUSTOMERS_SQL} kv ON t.target = kv.key")
def sst_point_lookup(spark, sf):
    """Open a table file, probe its stored filter, search its index and block."""
    kv = customers(spark, sf)
    buckets = ordered.Buckets(kv)
    return binary_table.lookup(binary_table.pack(kv, buckets=buckets), targets(spark, sf), buckets).select("target", F.col("value").cast("string").alias("value"))


@query("SELECT p_partkey, 'checksum' AS damage FROM part")
def sst_damage_found(spark, sf):
    """A file of each part's entry, with one byte of its value changed: each is found by the checksum of its block."""
    ranges = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("table_id"), F.format_string("%012d", "p_partkey").alias("key"), F.lit("value").alias("value"))
    whole = binary_table.files_of(ranges)
    # the entry's header is three bytes, the key twelve: byte 16 is the first of the value
    cut = whole.select("table_id", F.concat(F.substring("content", 1, 15), F.unhex(F.lit("00")), F.expr("substring(content, 17)")).alias("content"))
    return binary_table.verified(cut).select(F.col("table_id").cast("long").alias("p_partkey"), F.substring_index("damage", " ", 1).alias("damage"))


# Checksums and hashes.

_TABLE_SQL = f"[{', '.join(map(str, B.CRC_TABLE))}]"
_BYTES_SQL = "list_transform(range(1, len(hex({0})) // 2 + 1), lambda i: CAST(('0x' || substr(hex({0}), 2 * i - 1, 2)) AS UBIGINT))"


def _crc_sql(x: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {_BYTES_SQL.format(x)}), lambda c, b: xor(c >> 8, CAST({_TABLE_SQL}[CAST(xor(c, b) & 255 AS INTEGER) + 1] AS UBIGINT))), CAST(4294967295 AS UBIGINT))"


def _mask_sql(crc: str) -> str:
    return f"((({crc} >> 15) | (({crc} << 17) & 4294967295)) + 2726488792) & 4294967295"


@query(f"SELECT key, CAST({_crc_sql('encode(key)')} AS BIGINT) AS crc FROM {CUSTOMERS_SQL}")
def crc32c(spark, sf):
    return customers(spark, sf).select("key", B.crc32c(F.col("key")).alias("crc"))


@query(f"WITH c AS (SELECT key, {_crc_sql('encode(key)')} AS crc FROM {CUSTOMERS_SQL}) SELECT key, CAST({_mask_sql('crc')} AS BIGINT) AS masked, CAST(crc AS BIGINT) AS unmasked FROM c")
def crc_mask_roundtrip(spark, sf):
    masked = customers(spark, sf).select("key", B.crc_mask(B.crc32c(F.col("key"))).alias("masked"))
    return masked.select("key", "masked", B.crc_unmask(F.col("masked")).alias("unmasked"))


@query(f"WITH c AS (SELECT key, {_crc_sql('encode(key || value || chr(1))')} AS crc FROM {CUSTOMERS_SQL}) SELECT key, CAST({_mask_sql('crc')} AS BIGINT) AS stored, true AS intact FROM c")
def block_crc(spark, sf):
    """Trailer of a block of one entry's bytes: the data's checksum, continued over the type tag, masked; and its verification."""
    tag = F.lit(chr(Options().compression_tag))
    stored = customers(spark, sf).select("key", F.concat("key", "value").alias("data")).withColumn("stored", B.crc_mask(B.crc32c(tag, B.crc32c(F.col("data")))))
    return stored.select("key", "stored", (B.crc_unmask(F.col("stored")) == B.crc32c(F.concat("data", tag))).alias("intact"))


def _hash_sql(x: str) -> str:
    """The key hash of `x` (a blob) over UHUGEINT-free arithmetic: products of 32-bit numbers fit UBIGINT."""
    b = _BYTES_SQL.format(x)
    word = f"({b})[4 * i + 1] + ({b})[4 * i + 2] * 256 + ({b})[4 * i + 3] * 65536 + ({b})[4 * i + 4] * 16777216"
    n = f"(len(hex({x})) // 2)"
    return f"""CASE WHEN {n} = 0 THEN CAST(0 AS UBIGINT) ELSE list_reduce(
      list_prepend({{'v': xor(CAST({B.HASH_SEED} AS UBIGINT), (CAST({n} AS UBIGINT) * CAST({B.HASH_FACTOR} AS UBIGINT)) & 4294967295), 's': CAST(0 AS UBIGINT)}},
        list_concat(list_transform(range(0, {n} // 4), lambda i: {{'v': CAST({word} AS UBIGINT), 's': CAST(16 AS UBIGINT)}}),
          CASE WHEN {n} % 4 = 0 THEN [] ELSE [{{'v': CAST(coalesce(({b})[4 * ({n} // 4) + 1], 0) + coalesce(({b})[4 * ({n} // 4) + 2], 0) * 256 + coalesce(({b})[4 * ({n} // 4) + 3], 0) * 65536 AS UBIGINT), 's': CAST(24 AS UBIGINT)}}] END)),
      lambda a, w: {{'v': xor((((a.v + w.v) & 4294967295) * CAST({B.HASH_FACTOR} AS UBIGINT)) & 4294967295, ((((a.v + w.v) & 4294967295) * CAST({B.HASH_FACTOR} AS UBIGINT)) & 4294967295) >> CAST(w.s AS BIGINT)), 's': w.s}}).v END"""


_ROTR_SQL = "((h >> 17) | ((h << 15) & 4294967295))"


@query(f"SELECT key, CAST({_hash_sql('encode(key)')} AS BIGINT) AS hash FROM {CUSTOMERS_SQL}")
def kv_hash32(spark, sf):
    return customers(spark, sf).select("key", B.hash32(F.col("key")).alias("hash"))


_BITS = 10
_BLOOM_SQL = f"""
WITH k AS (SELECT CAST({_hash_sql('encode(key)')} AS UBIGINT) AS h FROM {CUSTOMERS_SQL}),
z AS (SELECT (greatest(64, count(*) * {_BITS}) + 7) // 8 * 8 AS size FROM k),
bits AS (SELECT DISTINCT CAST(((h + j * {_ROTR_SQL}) & 4294967295) % size AS BIGINT) AS bit FROM k, z, range(0, {bloom.hash_count(_BITS)}) r(j))
"""


@query(f"{_BLOOM_SQL} SELECT bit FROM bits")
def bloom_bits(spark, sf):
    return bloom.build(customers(spark, sf), _BITS)[0].select("bit")


@query(f"""{_BLOOM_SQL}, t AS (SELECT target, CAST({_hash_sql('encode(target)')} AS UBIGINT) AS h FROM {TARGETS_SQL} WHERE target <> '')
SELECT target, bool_and(CAST(((h + j * {_ROTR_SQL}) & 4294967295) % size AS BIGINT) IN (SELECT bit FROM bits)) AS may_match FROM t, z, range(0, {bloom.hash_count(_BITS)}) r(j) GROUP BY target
UNION ALL SELECT '', false""")
def bloom_probe(spark, sf):
    set_bits, size, k = bloom.build(customers(spark, sf), _BITS)
    return bloom.probe(targets(spark, sf), set_bits, size, k, "target").select("target", "may_match")


@query(f"""{_BLOOM_SQL}, t AS (SELECT target, CAST({_hash_sql('encode(target)')} AS UBIGINT) AS h FROM {TARGETS_SQL} WHERE target <> '')
SELECT target, bool_and(CAST(((h + j * {_ROTR_SQL}) & 4294967295) % size AS BIGINT) IN (SELECT bit FROM bits)) AS may_match FROM t, z, range(0, {bloom.hash_count(_BITS)}) r(j) GROUP BY target
UNION ALL SELECT '', false""")
def stored_filter_probe(spark, sf):
    """As bloom_probe, through the bytes of the filter block of a table file."""
    kv = customers(spark, sf)
    buckets = ordered.Buckets(kv)
    return binary_table.lookup(binary_table.pack(kv, buckets=buckets), targets(spark, sf), buckets).select("target", "may_match")


_RATES = "(SELECT rate FROM (VALUES (0.1), (0.05), (0.01), (0.001), (0.5)) t(rate))"


@query(f"WITH b AS (SELECT r_name, CAST(rate AS DOUBLE) AS rate, CAST(ceil(-ln(CAST(rate AS DOUBLE)) / pow(0.69314718056, 2)) AS INTEGER) AS bits_per_key FROM region, {_RATES}) SELECT r_name, rate, bits_per_key, CAST(least(30, greatest(1, floor(bits_per_key * CAST(0.69314718056 AS DOUBLE)))) AS INTEGER) AS k FROM b")
def bloom_sizing(spark, sf):
    rates = F.explode(F.array(*map(F.lit, (0.1, 0.05, 0.01, 0.001, 0.5))))
    sized = table(spark, sf, "region").select("r_name", rates.alias("rate")).withColumn("bits_per_key", bloom.bits_per_key(F.col("rate")))
    return sized.withColumn("k", bloom.hashes(F.col("bits_per_key")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def bloom_semi_join(spark, sf):
    built = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").cast("string").alias("c_custkey"))
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("string").alias("text_key"))
    return bloom.prefiltered_semi_join(left, built, "text_key", "c_custkey").select("o_orderkey", "o_custkey")


# Codecs.


def _hex(x: Column) -> Column:
    return F.hex(x)


def _fixed_sql(x: str, size: int) -> str:
    return " || ".join(f"printf('%02X', ({x} >> {8 * i}) & 255)" for i in range(size))


@query(f"SELECT o_orderkey, {_fixed_sql('o_custkey', 4)} AS bytes FROM orders")
def fixed32_encode(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", _hex(C.fixed_encode(F.col("o_custkey"), 4)).alias("bytes"))


@query(f"WITH o AS (SELECT o_orderkey, o_orderkey * 1000003 + 7 AS v FROM orders) SELECT o_orderkey, {_fixed_sql('v', 8)} AS bytes FROM o")
def fixed64_encode(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", _hex(C.fixed_encode(F.col("o_orderkey") * 1000003 + 7, 8)).alias("bytes"))


@query("SELECT o_orderkey, o_custkey AS small, o_orderkey * 1000003 AS large FROM orders")
def fixed_roundtrip(spark, sf):
    o = table(spark, sf, "orders")
    small, large = C.fixed_encode(F.col("o_custkey"), 4), C.fixed_encode(F.col("o_orderkey") * 1000003, 8)
    return o.select("o_orderkey", C.fixed_decode(small).alias("small"), C.fixed_decode(large).alias("large"))


@query(f"SELECT o_orderkey, {_fixed_sql('o_orderkey', 8)} || {_fixed_sql('o_custkey', 8)} AS handle, o_orderkey AS \"offset\", o_custkey AS length FROM orders")
def handle_codec(spark, sf):
    coded = table(spark, sf, "orders").select("o_orderkey", F.concat(C.fixed_encode(F.col("o_orderkey"), 8), C.fixed_encode(F.col("o_custkey"), 8)).alias("h"))
    return coded.select("o_orderkey", _hex(F.col("h")).alias("handle"), C.fixed_decode(F.substring("h", 1, 8)).alias("offset"), C.fixed_decode(F.substring("h", 9, 8)).alias("length"))


_MAGIC_HEX = (MAGIC & 0xFFFFFFFF).to_bytes(4, "little").hex().upper() + (MAGIC >> 32).to_bytes(4, "little").hex().upper()


@query(f"SELECT o_orderkey, {' || '.join(_fixed_sql(x, 8) for x in ('o_orderkey', 'o_custkey', '(o_orderkey + 1)', '(o_custkey + 1)'))} || '{_MAGIC_HEX}' AS footer, true AS valid, o_orderkey + 1 AS index_offset FROM orders")
def footer_roundtrip(spark, sf):
    numbers = (F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") + 1, F.col("o_custkey") + 1)
    magic = F.concat(C.fixed_encode(F.lit(MAGIC & 0xFFFFFFFF), 4), C.fixed_encode(F.lit(MAGIC >> 32), 4))
    coded = table(spark, sf, "orders").select("o_orderkey", F.concat(*(C.fixed_encode(n, 8) for n in numbers), magic).alias("f"))
    return coded.select("o_orderkey", _hex(F.col("f")).alias("footer"), ((F.octet_length("f") == 40) & (F.substring("f", 33, 8) == magic)).alias("valid"), C.fixed_decode(F.substring("f", 17, 8)).alias("index_offset"))


def _varint_sql(x: str) -> str:
    size = f"greatest(1, (length(ltrim(bin({x}), '0')) + 6) // 7)"
    return f"array_to_string(list_transform(range(0, {size}), lambda i: printf('%02X', (({x} >> CAST(7 * i AS BIGINT)) & 127) + CASE WHEN i < {size} - 1 THEN 128 ELSE 0 END)), '')"


@query(f"WITH o AS (SELECT o_orderkey, o_orderkey * 7919 AS v FROM orders) SELECT o_orderkey, {_varint_sql('v')} AS bytes FROM o")
def varint_encode(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", _hex(C.varint_encode(F.col("o_orderkey") * 7919)).alias("bytes"))


@query("WITH o AS (SELECT o_orderkey, o_orderkey * 7919 AS v FROM orders) SELECT o_orderkey, CAST(greatest(1, (length(ltrim(bin(v), '0')) + 6) // 7) AS INTEGER) AS bytes FROM o")
def varint_length(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.varint_length(F.col("o_orderkey") * 7919).alias("bytes"))


@query("SELECT o_orderkey, o_orderkey * 7919 AS v, CAST(NULL AS BIGINT) AS cut FROM orders")
def varint_roundtrip(spark, sf):
    coded = table(spark, sf, "orders").select("o_orderkey", C.varint_encode(F.col("o_orderkey") * 7919).alias("b"))
    # without its last byte every varint is cut off
    return coded.select("o_orderkey", C.varint_decode(F.col("b")).alias("v"), C.varint_decode(F.substring(F.col("b"), F.lit(1), F.length("b") - 1)).alias("cut"))


@query("SELECT key, printf('%02X', length(key)) || hex(encode(key)) AS slice, key AS back FROM (SELECT c_name AS key FROM customer)")
def length_prefixed(spark, sf):
    coded = customers(spark, sf).select("key", C.length_prefixed(F.col("key")).alias("s"))
    return coded.select("key", _hex(F.col("s")).alias("slice"), C.length_prefixed_decode(F.col("s")).cast("string").alias("back"))


@query("""WITH d AS (SELECT doc_id, unnest([lang || '-' || source || '-', '', lang || '-' || source, lang || '--']) AS s FROM documents),
p AS (SELECT doc_id, s, string_split(s, '-') AS p FROM d)
SELECT doc_id, s, CAST(CASE WHEN s = '' THEN 0 WHEN s LIKE '%-' THEN len(p) - 1 ELSE len(p) END AS INTEGER) AS n, CASE WHEN s = '' THEN '' WHEN s LIKE '%-' THEN array_to_string(p[:len(p) - 1], '|') ELSE array_to_string(p, '|') END AS fields FROM p""")
def split_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.expr("array(lang || '-' || source || '-', '', lang || '-' || source, lang || '--')")).alias("s"))
    fields = C.split_fields(F.col("s"), "-")
    return d.select("doc_id", "s", F.size(fields).alias("n"), F.array_join(fields, "|").alias("fields"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size <= 1 THEN p_size ELSE 1 << CAST(ceil(log2(p_size)) AS INTEGER) END AS BIGINT) AS pow2 FROM part")
def next_pow2(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.next_pow2(F.col("p_size")).alias("pow2"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events")
def epoch_millis(spark, sf):
    return table(spark, sf, "events").select("event_id", C.epoch_millis(F.col("ts")).alias("millis"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d-%H%M%S') AS time FROM events")
def time_string(spark, sf):
    return table(spark, sf, "events").select("event_id", C.time_string(F.col("ts")).alias("time"))


# The catalogue.


@query(f"SELECT id, level FROM {STATE_SQL}")
def manifest_replay(spark, sf):
    return manifest.replay(change_log(spark, sf))


@query(f"SELECT level, count(*) AS n_tables, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM {STATE_SQL} GROUP BY level")
def manifest_levels(spark, sf):
    return manifest.levels(manifest.replay(change_log(spark, sf)))


@query(f"SELECT c_custkey AS id, s.level FROM customer LEFT JOIN {STATE_SQL} s ON s.id = c_custkey")
def manifest_lookup(spark, sf):
    return manifest.lookup(manifest.replay(change_log(spark, sf)), table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


_COUNTERS_SQL = f"(SELECT CAST(coalesce(sum(CASE WHEN op = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS creations, CAST(coalesce(sum(CASE WHEN op = 1 AND before = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS deletions FROM (SELECT op, lag(op) OVER (PARTITION BY id ORDER BY seq) AS before FROM {LOG_SQL}))"


@query(f"SELECT creations, deletions FROM {_COUNTERS_SQL}")
def manifest_counters(spark, sf):
    return manifest.counters(change_log(spark, sf))


@query(f"SELECT creations, deletions, deletions > 100 AND deletions > 0.1 * (creations - deletions) AS due, deletions > 10000 AND deletions > 10 * (creations - deletions) AS due_by_default FROM {_COUNTERS_SQL}")
def manifest_rewrite_trigger(spark, sf):
    c = manifest.counters(change_log(spark, sf))
    due = lambda *a: manifest.rewrite_due(F.col("creations"), F.col("deletions"), *a)
    return c.select("creations", "deletions", due(100, 0.1).alias("due"), due().alias("due_by_default"))


@query(f"SELECT id AS seq, id, level, 0 AS op FROM {STATE_SQL}")
def manifest_snapshot(spark, sf):
    return manifest.snapshot(change_log(spark, sf))


@query(f"SELECT seq, CAST(3 + greatest(1, (length(ltrim(bin(id), '0')) + 6) // 7) AS BIGINT) AS bytes FROM {LOG_SQL}")
def manifest_codec_size(spark, sf):
    return manifest.encoded_size(change_log(spark, sf))


@query(f"""WITH v AS (SELECT seq // 16 AS batch_id, seq, {_varint_sql('id')} || {_varint_sql('level')} || {_varint_sql('op')} AS one FROM (SELECT seq, id, CAST(level AS BIGINT) AS level, CAST(op AS BIGINT) AS op FROM {LOG_SQL}))
SELECT batch_id, printf('%02X', count(*)) || string_agg(one, '' ORDER BY seq) AS bytes FROM v GROUP BY batch_id""")
def manifest_encode(spark, sf):
    return manifest.encoded(change_log(spark, sf), F.expr("seq div 16")).select("batch_id", F.hex("bytes").alias("bytes"))


@query(f"SELECT seq // 16 AS batch_id, row_number() OVER (PARTITION BY seq // 16 ORDER BY seq) - 1 AS at, id, level, op FROM {LOG_SQL}")
def manifest_codec_roundtrip(spark, sf):
    return manifest.decoded(manifest.encoded(change_log(spark, sf), F.expr("seq div 16")))


@query(f"SELECT id, level FROM {STATE_SQL}")
def manifest_open(spark, sf):
    """The log appended to a new folder in two batches, rewritten after the first, opened and replayed."""
    path, log = f"{scratch(spark, 'log')}/log", change_log(spark, sf)
    middle = log.agg(F.expr("percentile_approx(seq, 0.5)").alias("m")).first()["m"] or 0
    change_log_files.append_frame(spark, path, log.filter(F.col("seq") <= middle))
    change_log_files.rewrite(spark, path)
    change_log_files.append_frame(spark, path, log.filter(F.col("seq") > middle))
    return manifest.replay(change_log_files.read(spark, path))


_DISK_SQL = "(SELECT c_custkey AS id FROM customer WHERE c_custkey BETWEEN 50 AND 220)"


def _on_disk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").filter(F.col("c_custkey").between(50, 220)).select(F.col("c_custkey").alias("id"))


@query(f"SELECT id FROM {STATE_SQL} s WHERE NOT EXISTS (SELECT 1 FROM {_DISK_SQL} d WHERE d.id = s.id)")
def reconcile_missing(spark, sf):
    return manifest.missing(manifest.replay(change_log(spark, sf)), _on_disk(spark, sf))


@query(f"SELECT id FROM {_DISK_SQL} d WHERE NOT EXISTS (SELECT 1 FROM {STATE_SQL} s WHERE d.id = s.id)")
def reconcile_orphans(spark, sf):
    return manifest.orphans(manifest.replay(change_log(spark, sf)), _on_disk(spark, sf))


# Caches and frequencies.


def _accesses(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the order of (ts, event_id)."""
    log = table(spark, sf, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id", F.col("user_id").alias("key"))
    return cachesim.accesses(log, order=("micros", "event_id"))


_REUSE_SQL = """
WITH a AS (SELECT user_id AS key, CAST(user_id % 4 AS INTEGER) AS shard, ts, event_id FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ts, event_id) AS pos FROM a),
p AS (SELECT *, lag(pos) OVER (PARTITION BY shard, key ORDER BY pos) AS before FROM r),
h AS (SELECT p.event_id, p.shard, p.key, p.before IS NOT NULL AND (SELECT count(DISTINCT o.key) FROM r o WHERE o.shard = p.shard AND o.pos > p.before AND o.pos < p.pos) < 10 AS hit FROM p)
"""


@query(f"{_REUSE_SQL} SELECT event_id, key, shard, hit FROM h")
def lru_hits(spark, sf):
    return _accesses(spark, sf).select("event_id", "key", "shard", "hit")


@query(f"{_REUSE_SQL} SELECT shard, count(*) AS accesses, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN hit THEN 0 ELSE 1 END) - least(10, count(DISTINCT key)) AS BIGINT) AS evictions FROM h GROUP BY shard")
def lru_evictions(spark, sf):
    return _accesses(spark, sf).groupBy("shard").agg(F.count("*").alias("accesses"), F.sum(F.col("hit").cast("long")).alias("hits"), F.count("evicted").alias("evictions"))


@query("SELECT CAST(user_id % 4 AS INTEGER) AS shard, count(*) AS accesses FROM events GROUP BY 1")
def shard_distribution(spark, sf):
    return table(spark, sf, "events").groupBy(cachesim.shard(F.col("user_id"), 4).alias("shard")).agg(F.count("*").alias("accesses"))


@query("SELECT o_custkey AS key, CAST(least(count(*), 15) AS INTEGER) AS freq FROM orders GROUP BY 1")
def freq_capped(spark, sf):
    return sketch.capped(table(spark, sf, "orders"), "o_custkey")


@query("SELECT o_custkey AS key, CAST(least(count(*), 15) >> 1 AS INTEGER) AS freq FROM orders GROUP BY 1")
def freq_aged(spark, sf):
    return sketch.aged(sketch.capped(table(spark, sf, "orders"), "o_custkey"))


_WIDTH = 4096


@query(f"""WITH k AS (SELECT o_custkey AS key, count(*) AS n, CAST({_hash_sql('encode(CAST(o_custkey AS VARCHAR))')} AS UBIGINT) AS h FROM orders GROUP BY o_custkey),
c AS (SELECT key, n, r, ((h + r * {_ROTR_SQL}) & 4294967295) % {_WIDTH} AS cell FROM k, range(0, {sketch.ROWS}) t(r)),
s AS (SELECT r, cell, least(sum(n), {sketch.MOST}) AS n FROM c GROUP BY r, cell)
SELECT key, CAST(min(s.n) AS INTEGER) AS estimate FROM c JOIN s USING (r, cell) GROUP BY key""")
def freq_estimate(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("key"))
    return sketch.estimate(sketch.count_min(keys, _WIDTH), keys, _WIDTH).select(F.col("key").cast("long").alias("key"), "estimate")
