"""Documents whose sets of word shingles are alike, by adaptive multi-match prefixes.

A text is lower-cased (A-Z) and cut at ASCII white space; its set holds the distinct shingles of
`width` words, or the whole sequence if it is shorter, each as a 64-bit hash. Two documents link
when percent of their union or more is shared; result rows carry the component of these links.

 1. Sketch: each task counts hashed shingles in a table of CELLS cells; summed by blocks, these
    tell common shingles from the rest. Its size is fixed. It sets only the order of shingles
    (rare ones first) and the estimates of step 2, so it can't change a result.
 2. Prefixes: with t the least overlap that n shingles need, the first n - t + l shingles of two
    documents that link share l or more. Each document takes the l from 1 to MOST (which costs at
    most MOST more postings, and only lets more candidates through) whose estimated
    cost (postings read, and candidates that share l of them by chance, times their size) is
    least. Equal sets are one class from here on.
 3. Candidates: in lists of up to SHORT postings all pairs of fitting sizes, counted by pair; a
    pair needs min(l, l') shared shingles, of which each long list that both stand in may be one.
    Longer lists give each member's pair with one pivot, the member nearest the list's core.
 4. Verification: first by parity bitmaps of about n bits, of which two sets differ in no more bits
    than in shingles; then both whole sets are compared. They come from one more pass over the texts,
    which drops those outside a bitmap (of fixed size) of the candidates before anything is shuffled.
 5. Components by alternating large and small stars.
 6. Pairs that share shingles of long lists only, and that step 3 didn't give: at least one of the two is
    outside its list's pivot's component, as a pair inside one component can't add to it. Of a pair's shared
    shingles the first lies early in both prefixes (the rest of either set must hold the overlap), and the
    document of the lesser l (ties: the lesser id) shares l of its p long lists, so it is looked for in the
    first p - l + 1 of them only: the commonest lists are never read by those that want many matches. The
    list's members are dealt over cells of CHUNK by CHUNK, so no task holds a list. These pairs are
    verified likewise, so no link between components is missed.

Joins on a shingle or on a set's digest, where one key may hold a third of all rows, deal the rows of the
keys above a share of 1 / HEAVY over SALTS tasks.

Null texts and texts without words have an empty set and link with nothing. Repeated rows and
equal texts are in one component; every input row gives a row. A row without an id is in the
component of the rows of its set that have one; its component is null where there is none, and it
links with no other set. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_written, ship, written
from .common import map_rows, small_batches, texts

WIDTH, PERCENT = 3, 90
CELLS, BLOCKS = 1 << 20, 64
#: Greatest l; postings of a short list; what one more posting of one's own costs, in postings read.
MOST, SHORT, OWN = 64, 64, 8
#: Members of a long list in a task, from each side; keys above 1 / HEAVY of the rows are dealt over SALTS tasks.
CHUNK, HEAVY, SALTS = 2048, 1024, 32
BITMAP = 1 << 23
_WORDS = 1 << 17  # of a worker's cache


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the shingles in order, with repeats."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(one) - width + 1)
    size = min(width, len(one))
    # the hash so far is mixed before each further word, so that order counts
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = _mixed(out * _ODD[0] + one[i : i + n])
    return out


def _cell(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def sketch(docs: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """By cell, 0 or the binary logarithm of a count that stands out; and the sum of all counts."""
    spark = docs.sparkSession
    small_batches(spark)
    ship(spark)
    size = CELLS // BLOCKS
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])

    def emit(counts):
        for b in range(BLOCKS):
            part = counts[b * size : (b + 1) * size]
            yield b, zlib.compress(part.astype(np.int64).tobytes(), 1)

    def count(batches):
        counts, held, n = np.zeros(CELLS, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(_cell(shingles(text, width)))
                n += len(held[-1])
            if n >= CELLS:
                counts += np.bincount(np.concatenate(held), minlength=CELLS)
                held, n = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=CELLS)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*emit(counts)), schema)], schema=schema)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(data), np.int64)
                sums[b] = sums[b] + part if b in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], schema=schema)

    rows = docs.select("text").mapInArrow(count, "block int, counts binary").repartition(BLOCKS, "block").mapInArrow(total, "block int, counts binary").collect()
    counts = np.zeros(CELLS, np.int64)
    for r in rows:
        counts[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    usual = counts.mean()
    return np.where(counts > usual + 6 * math.sqrt(usual) + 4, np.log2(np.maximum(counts, 1)).astype(np.int64), 0).astype(np.uint8), int(counts.sum())


def ordered(text: str | None, levels: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The set, rare shingles first; one order for all documents."""
    found = np.unique(shingles(text, width))
    return found[np.argsort(levels[_cell(found)], kind="stable")]


def least(n, percent: int):
    """Shared shingles that a document of n needs with any that it links with."""
    return -(-percent * n // 100)


def matches_wanted(found: np.ndarray, levels: np.ndarray, documents: int, total: int, percent: int) -> int:
    """The l of least estimated cost for this document, among `documents` with `total` shingles."""
    n = len(found)
    first = n - least(n, percent)
    lists = np.cumsum(np.exp2(np.maximum(levels[_cell(found[: first + MOST])], 1).astype(float)))
    best, chosen = math.inf, 1
    for want in range(1, min(MOST, n - first) + 1):
        read = lists[first + want - 1]
        # a posting read falls to each document of this size by its share of all shingles
        mean = read * n / max(total, 1)
        # others that hold `want` of this prefix by chance: the tail of a Poisson count, by its first terms
        term = math.exp(-mean + want * math.log(mean) - math.lgamma(want + 1))
        chance = min(1.0, term / (1 - mean / (want + 1)) if mean < want else 1.0)
        if (cost := OWN * want + read + n * documents * chance) < best:
            best, chosen = cost, want
        elif cost > 2 * best:
            break
    return chosen


def parity(found: np.ndarray) -> np.ndarray:
    """Which of the slots 0 .. 2^k - 1, k least with 2^k >= n (64 at least), hold an odd number of the set's hashes; as bytes."""
    size = max(64, 1 << (len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little")


def differ(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the size of the symmetric difference of two sets, by their parities; the longer one is folded."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefixes(docs: DataFrame, levels: np.ndarray, total: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark (a digest of the text), n, digest of the set, its parity bits, l and the prefix for it."""
    shared = docs.sparkSession.sparkContext.broadcast((levels, docs.count(), total))

    def make():
        levels, documents, total = shared.value

        def step(rows):
            out = {k: [] for k in ("doc_id", "n", "digest", "bits", "l", "prefix")} | {"mark": rows["mark"]}
            for i, text in zip(rows["doc_id"], rows["text"]):
                found = ordered(text, levels, width)
                want = matches_wanted(found, levels, documents, total, percent) if len(found) else 0
                out["doc_id"].append(i)
                out["n"].append(len(found))
                out["digest"].append(xxhash.xxh3_128_digest(found.tobytes()))
                out["bits"].append(parity(found).tobytes() if want else None)
                out["l"].append(want)
                out["prefix"].append(found[: len(found) - least(len(found), percent) + want].view(np.int64) if want else [])
            return out

        return step

    return map_rows(docs.withColumn("mark", F.unhex(F.md5("text"))), "doc_id long, mark binary, n int, digest binary, bits binary, l int, prefix array<long>", make)


def sets(docs: DataFrame, wanted: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """id and whole set of the documents in wanted (column id), and maybe of a few others."""
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64(F.lit("slot"), F.col("id")), F.lit(BITMAP))
    marked = wanted.select(slot.alias("slot")).select(F.expr("slot div 64 AS word"), F.expr("shiftleft(1L, cast(slot % 64 AS int)) AS bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = marked.toPandas()  # BITMAP bits at most
    bits = np.zeros(BITMAP // 64, np.int64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((levels, bits))

    def make():
        levels, bits = shared.value

        def step(rows):
            slots = np.array(rows["slot"], np.int64)
            keep = np.flatnonzero((bits[slots // 64] >> (slots % 64)) & 1).tolist() if len(slots) else []
            return {"id": [rows["id"][i] for i in keep], "members": [ordered(rows["text"][i], levels, width).tobytes() for i in keep]}

        return step

    return map_rows(docs.withColumnRenamed("doc_id", "id").withColumn("slot", slot), "id long, members binary", make)


def hopeful(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, l) whose parity bits (id, n, bits) let them link."""
    left = pairs.join(bits.withColumnsRenamed({"id": "a", "n": "m", "bits": "x"}), "a")
    both = left.join(bits.withColumnsRenamed({"id": "b", "bits": "y"}), "b").select("a", "b", "l", "m", "n", "x", "y")

    def make():
        def step(rows):
            keep = [
                i
                for i, (m, n, x, y) in enumerate(zip(rows["m"], rows["n"], rows["x"], rows["y"]))
                if differ(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) * (100 + percent) <= (m + n) * (100 - percent)
            ]
            return {k: [rows[k][i] for i in keep] for k in ("a", "b", "l")}

        return step

    return map_rows(both, "a long, b long, l int", make).distinct()


def verified(pairs: DataFrame, bits: DataFrame, docs: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, l) that link: by their bits, by l shared shingles in the prefixes, then by the whole sets."""
    pairs = written(hopeful(pairs, bits, percent), "hopeful")
    members = written(sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), levels, width, percent), "sets")
    left = pairs.join(members.withColumnsRenamed({"id": "a", "members": "x"}), "a")
    both = left.join(members.withColumnsRenamed({"id": "b", "members": "y"}), "b").select("a", "b", "l", "x", "y")

    def make():
        def step(rows):
            out = {"a": [], "b": []}
            for a, b, want, x, y in zip(rows["a"], rows["b"], rows["l"], rows["x"], rows["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                heads = [v[: len(v) - least(len(v), percent) + want] for v in (x, y)]
                if len(np.intersect1d(*heads, assume_unique=True)) < want:
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return step

    links = written(map_rows(both, "a long, b long", make).distinct(), "links")
    drop_written(docs.sparkSession, members, pairs)
    return links


def components(edges: DataFrame) -> DataFrame:
    """id and component (least id reachable) of the ids that edges (a, b) name: alternating large and small stars."""
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    mark, last = None, None
    while True:
        ways = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        stars = written(small, "stars")
        if last is not None:
            drop_written(edges.sparkSession, last)
        last, was = stars, mark
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == was:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _sizes_fit(x: str, y: str, percent: int):
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def dealt(rows: DataFrame, keyed: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined on key with keyed, which has one row a key and in `many` how many rows hold it; the rows of heavy keys are dealt by a hash of `by`."""
    total = keyed.agg(F.sum("many").alias("n")).first()["n"] or 0
    heavy = [r[0] for r in keyed.filter(F.col("many") > F.lit(total / HEAVY)).select(key).collect()]  # HEAVY keys at most
    if not heavy:
        return rows.join(keyed, key)
    hot = F.col(key).isin([F.lit(bytes(k)) if isinstance(k, bytearray) else k for k in heavy])
    left = rows.withColumn("salt", F.when(hot, F.pmod(F.xxhash64(F.lit("salt"), by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    right = keyed.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "salt"]).drop("salt")


def late_pairs(long: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, l) of step 6, from the members of long lists (token, id, n, l, at, many, pivot) and the components so far."""
    row = Window.partitionBy("id")
    ranked = long.withColumn("rank", F.row_number().over(row.orderBy("at"))).withColumn("lists", F.count("*").over(row))
    # the first shared shingle leaves enough of either set
    near = ranked.filter(F.col("at") <= F.col("n") - F.expr(f"(cast(n AS bigint) * {percent} + 99) div 100"))
    placed = near.filter("id != pivot.id").withColumn("early", F.col("rank") <= F.col("lists") - F.col("l") + 1).select("token", "id", "n", "l", "at", "early")
    placed = written(placed.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    # most lists are of one component and have no pair to give
    mixed = placed.groupBy("token").agg(F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token", "many")
    core = long.filter(F.col("id") == F.col("pivot.id")).select("token", "id").join(mixed, "token").join(found, "id", "left").select("token", "many", F.coalesce("component", "id").alias("core"))
    own = written(dealt(placed, written(core, "core"), "token", "id").withColumn("outside", F.col("component") != F.col("core")).drop("many", "core"), "own")
    # early ones outside the core meet all, early ones in it those outside
    tally = own.groupBy("token").agg(F.count("*").alias("many"), F.count_if(F.expr("early AND outside")).alias("early_out"), F.count_if(F.expr("early AND NOT outside")).alias("early_in"), F.count_if("outside").alias("out"))
    tally = written(tally.filter("early_out > 0 AND many > 1 OR early_in > 0 AND out > 0"), "tally")
    own = dealt(own, tally, "token", "id")
    columns = ["id", "n", "l", "at", "component"]

    def side(df, s, i, j, mine, others):
        """Dealt over the chunks of its side, and copied to each chunk of the other: a cell has at most about CHUNK of both."""
        chunks = lambda c: F.ceil(F.col(c) / F.lit(CHUNK)).cast("int")
        at = F.pmod(F.xxhash64(F.lit("chunk"), "id"), chunks(mine).cast("long")).cast("int")
        return df.withColumn(i, at).withColumn(j, F.explode(F.sequence(F.lit(0), chunks(others) - 1))).select("token", "i", "j", *(F.col(c).alias(f"{c}_{s}") for c in columns))

    need = F.ceil((F.col("n_x") + F.col("n_y")) * percent / F.lit(100 + percent))
    pairs = None
    for first, mine, then, others in (("early AND outside", "early_out", "true", "many"), ("early AND NOT outside", "early_in", "outside", "out")):
        some = own.filter(F.col(mine) > 0).filter(F.col(others) > 0)
        x, y = side(some.filter(first), "x", "i", "j", mine, others), side(some.filter(then), "y", "j", "i", others, mine)
        met = x.join(y, ["token", "i", "j"]).filter(
            ((F.col("l_x") < F.col("l_y")) | ((F.col("l_x") == F.col("l_y")) & (F.col("id_x") < F.col("id_y"))))
            & (F.col("component_x") != F.col("component_y")) & _sizes_fit("n_x", "n_y", percent) & (F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= need)
        )
        met = met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), F.col("l_x").alias("l"))
        pairs = met if pairs is None else pairs.union(met)
    return pairs.distinct()


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs. Writes to the shared folder and runs several jobs."""
    return linked(docs, width, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark (a digest of the text), n, digest of the set and component for each row of docs."""
    spark: SparkSession = docs.sparkSession
    docs = texts(docs)
    levels, total = sketch(docs, width)
    rows = written(prefixes(docs, levels, total, width, percent), "prefixes")
    classes = written(rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("many")), "classes")
    first = classes.select(F.col("digest").alias("d"), "id")
    each = rows.filter("n > 0").join(first, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("id"))).dropDuplicates(["id", "digest"])
    postings = each.select("id", "n", "l", F.posexplode("prefix").alias("at", "token"))
    lists = written(postings.groupBy("token").agg(F.count("*").alias("many"), F.min(F.struct("at", "n", "id", "l")).alias("pivot")).filter("many > 1"), "lists")
    shared = written(dealt(postings, lists, "token", "id").select("token", "id", "n", "l", "at", "many", "pivot"), "postings")

    short, long = shared.filter(F.col("many") <= SHORT), shared.filter(F.col("many") > SHORT)
    stands = long.groupBy("id").agg(F.count("*").alias("longs"))
    side = lambda s: short.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "l")))
    met = side("x").join(side("y"), "token").filter((F.col("id_x") < F.col("id_y")) & _sizes_fit("n_x", "n_y", percent))
    counted = met.groupBy(F.col("id_x").alias("a"), F.col("id_y").alias("b")).agg(F.count("*").alias("met"), F.min(F.least("l_x", "l_y")).alias("l"))
    enough = counted.filter("met >= l")
    # where long lists may hold what is missing, those that both stand in count
    rest = counted.filter("met < l").join(stands.withColumnsRenamed({"id": "a", "longs": "p"}), "a").join(stands.withColumnsRenamed({"id": "b", "longs": "q"}), "b").filter(F.col("met") + F.least("p", "q") >= F.col("l"))
    star = long.filter((F.col("id") != F.col("pivot.id")) & _sizes_fit("n", "pivot.n", percent)).select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b"), F.least("l", "pivot.l").alias("l"))
    pairs = written(enough.select("a", "b", "l").union(rest.select("a", "b", "l")).union(star).groupBy("a", "b").agg(F.min("l").alias("l")), "pairs")
    bits = each.select("id", "n", "bits")
    links = verified(pairs, bits, docs, levels, width, percent)
    found = components(links)

    late = written(late_pairs(long, found, percent).join(pairs, ["a", "b"], "left_anti"), "late")
    if late.take(1):
        more = verified(late, bits, docs, levels, width, percent)
        if more.take(1):
            found = components(links.union(more))
    drop_written(spark, shared, pairs, lists, late)

    named = dealt(rows.filter("n > 0").select("doc_id", "mark", "n", "digest"), classes, "digest", "doc_id").join(found, "id", "left")
    whole = named.select("doc_id", "mark", "n", "digest", F.coalesce("component", "id").alias("component"))
    return whole.union(rows.filter("n = 0").select("doc_id", "mark", "n", "digest", F.col("doc_id")))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of its least id (ids before nulls; of one id with several texts, the least digest of the text; of rows
    repeated with equal id and text, one). Rows without ids whose sets no row with an id has are grouped by their set. Rows without words all stay. All columns stay."""
    rows = written(linked(docs, width, percent).filter("n > 0").select("doc_id", "mark", F.coalesce(F.col("component").cast("string"), F.hex("digest")).alias("group")), "linked")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    firsts = written(rows.groupBy("group").agg(F.count("*").alias("many"), F.min(row).alias("first")), "firsts")
    own = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    same = lambda other: docs["doc_id"].eqNullSafe(other["__id"]) & (F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))) == other["__mark"])
    gone = own(dealt(rows, firsts.filter("many > 1"), "group", "mark").filter(~row.eqNullSafe(F.col("first"))))
    kept = docs.join(gone, same(gone), "left_anti")
    repeated = rows.groupBy("doc_id", "mark").count().filter("count > 1")
    if not repeated.take(1):
        return kept
    # ids and texts that stand there more than once: the row of the least hash of all columns
    repeated = own(repeated)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    several = kept.join(repeated, same(repeated), "left_semi")
    one = several.groupBy("doc_id", "text").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return kept.join(repeated, same(repeated), "left_anti").union(one.select(*(F.col("row")[c].alias(c) for c in docs.columns)))
